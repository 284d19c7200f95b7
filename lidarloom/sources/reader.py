"""Verified reads of byte ranges: of local or mounted paths, and over HTTP with deadlines, retries and counters."""

from __future__ import annotations

import http.client
import importlib
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from ..errors import LoomError, error
from ..functions.ranges import BASE_MS, LARGEST, PER_MIB_MS, RETRY_MS

#: A fetch takes url, headers and seconds for each wait; it gives status, headers (get by name) and a readable body.
Fetch = Callable[[str, dict[str, str], float], tuple]
PIECE = 1 << 18


def named(name: str, known: dict[str, Callable]) -> Callable:
    """A callable by its name in known or as module:attribute, which workers can import too."""
    if name in known:
        return known[name]
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def fetch_http(url: str, headers: dict[str, str], seconds: float) -> tuple:
    try:
        answer = urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=seconds)  # noqa: S310
    except urllib.error.HTTPError as refused:  # an answer too
        answer = refused
    return answer.status, answer.headers, answer


FETCHES: dict[str, Fetch] = {"http": fetch_http}


def content_range(header: str) -> tuple[int, int, int | None] | None:
    """start, last and total (None for *), or None if the header is unreadable or contradicts itself."""
    found = re.fullmatch(r"bytes ([0-9]+)-([0-9]+)/([0-9]+|\*)", header.strip())
    if not found:
        return None
    start, last = int(found[1]), int(found[2])
    total = None if found[3] == "*" else int(found[3])
    if max(last, total or 0) > LARGEST or last < start or total is not None and last >= total:
        return None
    return start, last, total


def deadline_s(length: int) -> float:
    return (BASE_MS + -(-length // (1 << 20)) * PER_MIB_MS) / 1000


def worth_retrying(e: LoomError) -> bool:
    return e.code in ("range-timeout", "range-network") or e.code == "range-request-failed" and e.details.get("status", 0) >= 500


class Reader:
    """Ranges of one file. Only an answer of exactly the bytes asked for counts; stats() is a copy of the counters of attempts."""

    def __init__(self, url: str, fetch: str | Fetch = "http", retry_ms: Iterable[int] = RETRY_MS, sleep: Callable[[float], None] = time.sleep):
        self.url, self.total_bytes = url, None
        self._fetch = named(fetch, FETCHES) if isinstance(fetch, str) else fetch
        self._retry_ms, self._sleep = tuple(retry_ms), sleep
        self._counts = {"requests": 0, "retries": 0, "bytes_requested": 0, "bytes_wasted": 0}

    def stats(self) -> dict[str, int]:
        return dict(self._counts)

    def read(self, offset: int, length: int, wanted: int | None = None) -> bytes:
        """Exactly the range; wanted: how many of its bytes a caller asked for, the rest counts as wasted in each attempt."""
        if offset < 0 or length < 1 or offset + length - 1 > LARGEST:
            raise error("invalid-byte-range", f"{self.url}: {offset}+{length}")
        once = self._once if self.url.lower().startswith(("http://", "https://")) else self._local
        for wait in (*self._retry_ms, None):
            self._counts["requests"] += 1
            self._counts["bytes_requested"] += length
            self._counts["bytes_wasted"] += length - (length if wanted is None else wanted)
            try:
                return once(offset, length)
            except LoomError as e:
                if wait is None or not worth_retrying(e):
                    raise
            self._sleep(wait / 1000)
            self._counts["retries"] += 1
        raise AssertionError("unreachable")

    def read_many(self, ranges: list[tuple[int, int]], groups: Callable, at_once: int = 6) -> list[bytes]:
        """The bytes of each range in the caller's order; groups deals (offset, length, what) into reads, which run at_once."""
        out = [b""] * len(ranges)

        def fill(group: list) -> None:
            start = group[0][0]
            raw = self.read(start, group[-1][0] + group[-1][1] - start, sum(r[1] for r in group))
            for offset, length, (i,) in group:
                out[i] = raw[offset - start : offset - start + length]

        with ThreadPoolExecutor(at_once) as pool:
            list(pool.map(fill, groups([(offset, length, (i,)) for i, (offset, length) in enumerate(ranges)])))
        return out

    def _local(self, offset: int, length: int) -> bytes:
        with open(self.url, "rb") as f:
            self.total_bytes = os.fstat(f.fileno()).st_size
            f.seek(offset)
            out = f.read(length)
        if len(out) < length:
            raise error("content-range-mismatch", f"{self.url}: {len(out)} of {length} bytes", expected=length, received=len(out))
        return out

    def _once(self, offset: int, length: int) -> bytes:
        asked, last = f"bytes={offset}-{offset + length - 1}", offset + length - 1
        ends = time.monotonic() + deadline_s(length)
        late = error("range-timeout", f"{self.url}: {asked} took over {deadline_s(length)} s", url=self.url)
        answer = None
        try:
            status, headers, answer = self._fetch(self.url, {"Range": asked, "Accept-Encoding": "identity"}, deadline_s(length))
            if status >= 400:
                raise error("range-request-failed", f"{self.url}: status {status}", url=self.url, status=status)
            if status != 206:
                raise error("range-unsupported", f"{self.url}: status {status} for a range", url=self.url, status=status)
            header = headers.get("Content-Range")
            if header is None:
                raise error("content-range-unreadable", f"{self.url}: no Content-Range", url=self.url)
            got = content_range(header)
            if got is None or got[:2] != (offset, last):
                raise error("content-range-mismatch", f"{self.url}: {asked} gave {header}", url=self.url, expected=asked, received=header)
            body = bytearray()
            while len(body) <= length and (piece := answer.read(min(PIECE, length + 1 - len(body)))):
                body += piece
                if time.monotonic() > ends:
                    raise late
            if len(body) != length:
                raise error("content-range-mismatch", f"{self.url}: {len(body)} of {length} bytes", url=self.url, expected=length, received=len(body))
            self.total_bytes = got[2]
            return bytes(body)
        except (OSError, http.client.HTTPException) as e:
            if isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError) or time.monotonic() > ends:
                raise late from e
            raise error("range-network", f"{self.url}: {e}", url=self.url) from e
        finally:
            if answer is not None:
                answer.close()
