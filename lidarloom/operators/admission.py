"""Admission accounting: byte and host-slot budgets, leases, and their counters.

One ledger class serves the batch query (events of a provider in order) and the streaming one (the same events as state).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import error

#: Bytes in flight, slots per origin, decode jobs, hierarchy pages.
RANGE_BYTES, SLOTS, DECODE_JOBS, HIERARCHY_PAGES = 32 * 1024 * 1024, 6, 8, 64


class Counter:
    def __init__(self, capacity: int):
        self.capacity, self.in_use, self.peak, self.tally = capacity, 0, 0, {"admitted": 0, "deferred": 0, "rejected": 0}

    def verdict(self, n: int) -> str:
        return "rejected" if n > self.capacity else "deferred" if self.in_use + n > self.capacity else "admitted"

    def take(self, n: int) -> None:
        self.in_use += n
        self.peak = max(self.peak, self.in_use)


class Ledger:
    """acquire() takes bytes and a slot of the origin together or neither; a refusal counts on the side that is at fault."""

    def __init__(self, range_bytes: int = RANGE_BYTES, slots: int = SLOTS, hosts: dict[str, Counter] | None = None):
        self.bytes, self.slots, self.hosts = Counter(range_bytes), slots, {} if hosts is None else hosts
        self.leases: dict[int, tuple[Counter, int] | None] = {}
        self.destroyed = False

    def host(self, origin: str) -> Counter:
        return self.hosts.setdefault(origin, Counter(self.slots))  # whoever comes first fixes the capacity

    def acquire(self, lease: int, origin: str, n: int) -> tuple[str, str | None]:
        host = self.host(origin)
        sides = [(self.bytes, n), (host, 1)]
        if self.destroyed:
            for c, _ in sides:
                c.tally["rejected"] += 1
            return "rejected", "destroyed"
        for verdict, reason in (("rejected", "over-capacity"), ("deferred", "no-room")):
            fault = [c for c, k in sides if c.verdict(k) == verdict]
            if fault:
                for c in fault:
                    c.tally[verdict] += 1
                return verdict, reason if verdict == "rejected" else None
        for c, k in sides:
            c.take(k)
            c.tally["admitted"] += 1
        self.leases[lease] = (host, n)
        return "admitted", None

    def release(self, lease: int) -> None:
        """Once for each lease; the first release after destroy() frees nothing more."""
        if lease not in self.leases:
            raise error("lease-already-released", f"lease {lease} was released before")
        held = self.leases.pop(lease)
        if held:
            held[0].in_use -= 1
            self.bytes.in_use -= held[1]

    def destroy(self) -> None:
        for lease, held in list(self.leases.items()):
            if held:
                held[0].in_use -= 1
                self.bytes.in_use -= held[1]
            self.leases[lease] = None
        self.destroyed = True

    def apply(self, op: str, lease: int, origin: str, n: int) -> tuple[str, str | None]:
        if op == "acquire":
            return self.acquire(lease, origin, n)
        if op == "destroy":
            self.destroy()
            return "destroyed", None
        try:
            self.release(lease)
            return "released", None
        except Exception as e:
            return "refused", getattr(e, "code", None)


LEDGER = "provider string, seq long, op string, origin string, bytes long, verdict string, reason string, bytes_in_use long, bytes_peak long, host_in_use long, host_peak long"


def row(ledger: Ledger, provider: str, seq: int, op: str, lease: int, origin: str, n: int) -> tuple:
    verdict, reason = ledger.apply(op, int(lease), origin, int(n))
    host = ledger.host(origin)
    return provider, int(seq), op, origin, int(n), verdict, reason, ledger.bytes.in_use, ledger.bytes.peak, host.in_use, host.peak


def rows(ledger: Ledger, provider: str, events: pd.DataFrame) -> Iterator[tuple]:
    for e in events[["seq", "op", "lease", "origin", "bytes"]].itertuples(index=False):
        yield row(ledger, provider, *e)


def ledger(events: DataFrame, range_bytes: int = RANGE_BYTES, slots: int = SLOTS, process: str = "provider") -> DataFrame:
    """events: provider, seq, op (acquire, release, destroy), lease, origin, bytes. One ordered fold for each process.

    process names the column that tells which providers live in one process: these have bytes of their own, but share the slots of an
    origin. By default each provider is a process.
    """
    names = [x.split()[0] for x in LEDGER.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        hosts: dict[str, Counter] = {}
        ledgers = {p: Ledger(range_bytes, slots, hosts) for p in pdf["provider"].unique()}
        events = pdf.sort_values("seq")[["provider", "seq", "op", "lease", "origin", "bytes"]]
        out = [row(ledgers[p], p, *rest) for p, *rest in events.itertuples(index=False)]
        return pd.DataFrame(out, columns=names)

    return events.groupBy(process).applyInPandas(run, LEDGER)


def totals(ledger_rows: DataFrame) -> DataFrame:
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return ledger_rows.groupBy("provider", "origin").agg(count("admitted"), count("deferred"), count("rejected"), F.max("host_peak").alias("host_peak"))
