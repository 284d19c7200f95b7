"""Byte ranges over HTTP: what answers count, what is tried again, and the source on top of it."""

from __future__ import annotations

import io
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from lidarloom import errors
from lidarloom.sources import layout, reader
from lidarloom.sources.copc import CopcSource, groups

DATA = bytes(range(200)) * 5


def answers(*given):
    """A fetch that gives these answers, one after the other: (status, header, body), or an exception."""
    left = list(given)

    def fetch(url, headers, seconds):
        status = left.pop(0)
        if isinstance(status, Exception):
            raise status
        code, header, body = status
        return code, {} if header is None else {"Content-Range": header}, io.BytesIO(body)

    return fetch


GOOD = (206, "bytes 10-14/1000", DATA[10:15])


def test_verified_and_counted():
    waits = []
    r = reader.Reader("http://h/f", answers((503, None, b""), TimeoutError(), GOOD), sleep=waits.append)
    assert r.read(10, 5, 3) == DATA[10:15] and waits == [0.5, 2.0] and r.total_bytes == 1000
    seen = r.stats()
    assert seen == {"requests": 3, "retries": 2, "bytes_requested": 15, "bytes_wasted": 6}
    seen["requests"] = 99
    assert r.stats()["requests"] == 3


@pytest.mark.parametrize(
    ("answer", "code", "tries"),
    [
        ((200, None, DATA), "range-unsupported", 1),
        ((304, None, b""), "range-unsupported", 1),
        ((404, None, b""), "range-request-failed", 1),
        ((500, None, b""), "range-request-failed", 3),
        ((206, None, DATA[10:15]), "content-range-unreadable", 1),
        ((206, "bytes 10-15/1000", DATA[10:16]), "content-range-mismatch", 1),
        ((206, "bytes 10-14/12", DATA[10:15]), "content-range-mismatch", 1),
        ((206, "bytes 10-14/1000", DATA[10:14]), "content-range-mismatch", 1),
        ((206, "bytes 10-14/1000", DATA[10:16]), "content-range-mismatch", 1),
        (ConnectionResetError(), "range-network", 3),
        (TimeoutError(), "range-timeout", 3),
    ],
)
def test_refused(answer, code, tries):
    r = reader.Reader("http://h/f", answers(*[answer] * 3), sleep=lambda s: None)
    with pytest.raises(errors.BY_CODE[code]):
        r.read(10, 5)
    assert r.stats()["requests"] == tries == r.stats()["retries"] + 1


def test_edges():
    assert reader.content_range("\tbytes 0-4/* ") == (0, 4, None) and reader.content_range("bytes 0-4/" + "9" * 20) is None
    assert reader.deadline_s(1) == 10.0 and reader.deadline_s((1 << 20) + 1) == 12.0
    for bad in ((-1, 5), (0, 0), (1 << 53, 1)):
        r = reader.Reader("http://h/f", answers())
        with pytest.raises(errors.BY_CODE["invalid-byte-range"]):
            r.read(*bad)
        assert r.stats()["requests"] == 0
    assert reader.named("json:loads", {})("1") == 1


class Server(BaseHTTPRequestHandler):
    files: dict[str, bytes] = {}

    def do_GET(self):  # noqa: N802
        body = self.files[self.path]
        low, high = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
        part = body[low : high + 1]
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {low}-{low + len(part) - 1}/{len(body)}")
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *args):
        pass


@pytest.fixture
def served():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_source_over_http(spark, served):
    p = np.zeros(6, layout.POINT7)
    p["x"] = np.arange(6) * 100
    Server.files = {f"/{n}.copc": layout.build_file(p, [(0, 0, 0, 0)] * 2 + [(1, 1, 0, 0)] * 4, [0, 0, 0, 8, 8, 8]) for n in "ab"}
    spark.dataSource.register(CopcSource)
    load = lambda table, **o: spark.read.format("copc").options(table=table, **o).load(f"{served}/a.copc {served}/b.copc")
    assert sorted(r.total_bytes for r in load("files").collect()) == [len(Server.files["/a.copc"])] * 2
    assert sorted(r.x for r in load("points", maxDepth="1").collect()) == sorted([float(i) for i in range(6)] * 2)
    named = load("points", decoder="lidarloom.sources.layout:decode_plain", fetch="lidarloom.sources.reader:fetch_http")
    assert named.where("key = '1-1-0-0'").count() == 8
    r = reader.Reader(f"{served}/a.copc")
    body, asked = Server.files["/a.copc"], [(300, 50), (0, 100), (350, 7)]
    assert r.read_many(asked, groups) == [body[o : o + n] for o, n in asked] and r.stats()["requests"] == 2 and r.stats()["bytes_wasted"] == 0


def test_pushdown(spark, tmp_path):
    p = np.zeros(3, layout.POINT7)
    for n in "ab":
        (tmp_path / f"{n}.copc").write_bytes(layout.build_file(p, [(0, 0, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0)], [0, 0, 0, 8, 8, 8]))
    (tmp_path / "c.copc").write_bytes(b"no file of this kind")
    spark.dataSource.register(CopcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = spark.read.format("copc").options(table="hierarchy", pushdown="true").load(str(tmp_path))
        one = str(tmp_path / "a.copc")
        # The third file is refused if it is opened: the filter on url reaches the source.
        assert sorted(r.depth for r in rows.where(rows.url == one).where("depth <= 1").collect()) == [0, 1]
        assert rows.where("url = 'elsewhere'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
