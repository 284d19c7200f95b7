"""Exact substring dedup: every byte covered by a 100-byte string that also starts earlier is removed.

1. Anchors. In each 100-byte window the 32-gram of smallest hash (the rightmost of equals) is the anchor; equal windows have
   equal anchors at equal places. Neighbouring windows with one anchor make a record: (hash of the anchor, hash of the record's bytes,
   document, first and last window). Records that a task has seen before are flagged on the spot, so that a
   frequent passage sends one row from each task, not one from each place.
2. Records meet by anchor. Records with equal bytes are flagged but for the first; an anchor with one content is settled.
3. Anchors with several contents (the borders of repeated passages) fetch their bytes and are dealt out into shards; a shard is put
   into suffix order by induced sorting, and windows that neighbour in that order with 100 common bytes are equal: all but
   the first are flagged. Shards hold only such bytes, and the queues of the induction spill to disk.
   An anchor with more bytes than a shard may have is split, again and again: windows are told apart by where they hold the anchor, half by
   half, and by all bytes that windows of a half share, so that equal windows stay together. After seven halvings the windows of a
   group hold the same 100 bytes and are settled by an aggregate. So no task holds more than a shard and an anchor, however
   many contexts a line comes in.
Order is by doc_id (null first), then by place; rows that repeat an id are documents of their own that aren't earlier than each other at the same
place. A null text is empty. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, cut_table, release, ship, table

LENGTH, GRAM = 100, 32
#: Bytes of text worked on at once; a longer text is worked on in parts that overlap by a window less one byte.
CHUNK = 1 << 21
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + (1 << 16))
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.ones(size, np.uint64)
            p[1:] = base
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-gram of bytes: polynomial prefix sums modulo 2**64, mixed."""
    up, down = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(b) - k + 1]
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def anchors(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """b: texts end to end; starts, ends of each. Records as (hash of anchor, first window, last window), windows inside one text only."""
    if len(b) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(b, k)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    width, done = length - k + 1, 1
    while 2 * done <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if done < width:
        low = np.minimum(low[: len(low) - (width - done)], low[width - done :])
    at = (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)
    ok = np.zeros(len(b) + 1, np.int8)
    long = ends - starts >= length
    np.add.at(ok, starts[long], 1)
    np.add.at(ok, ends[long] - length + 1, -1)
    place = np.flatnonzero(np.cumsum(ok)[: len(at)])
    if not len(place):
        return np.zeros(0, np.uint64), place, place
    own = at[place]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)]))
    last = np.append(new[1:], len(place)) - 1
    return h[own[new]], place[new], place[last]


RECORD = "h long, c long, doc long, twin long, lo long, hi long, done boolean"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(texts: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch | None:
        """texts: document, twin, place of the part in it, bytes."""
        sizes = np.array([len(t[3]) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        whole = b"".join([t[3] for t in texts])
        h, lo, hi = anchors(np.frombuffer(whole, np.uint8), starts, ends)
        if not len(h):
            return None
        digest = xxhash.xxh3_64_intdigest
        c = np.array([digest(whole[s:e]) for s, e in zip(lo.tolist(), (hi + LENGTH).tolist(), strict=True)], np.uint64)
        part = np.searchsorted(ends, lo, side="right")
        doc, twin, shift = (np.array([t[i] for t in texts], np.int64)[part] for i in range(3))
        lo, hi = lo - starts[part] + shift, hi - starts[part] + shift
        order = np.lexsort((lo, doc, c, h))
        h, c, doc, twin, lo, hi = (x[order] for x in (h, c, doc, twin, lo, hi))
        same = np.zeros(len(h), bool)
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
        head = np.repeat(first, np.diff(np.append(first, len(h))))
        same = (doc != doc[head]) | (lo != lo[head])
        h = h.view(np.int64).copy()
        h[same] = np.flatnonzero(same) * 0x9E3779B1 ^ doc[same]  # settled: goes anywhere
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.view(np.int64)), pa.array(doc), pa.array(twin), pa.array(lo), pa.array(hi), pa.array(same)], names=[x.split()[0] for x in RECORD.split(", ")])

    held, size = [], 0
    for batch in batches:
        for doc, twin, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
            for at in range(0, max(len(raw) - LENGTH + 1, 1), CHUNK):
                part = bytes(raw[at : at + CHUNK + LENGTH - 1])
                if len(part) >= LENGTH:
                    held.append((doc, twin, at, part))
                    size += len(part)
                if size >= CHUNK:
                    if out := flush(held):
                        yield out
                    held, size = [], 0
    if held and (out := flush(held)):
        yield out


FOUND = "h long, doc long, twin long, lo long, hi long, open boolean"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by h, c, doc, lo. Gives flagged windows, and the first record of each content of anchors with several.

    One row is carried from batch to batch: the first of the last content, and whether it has been given already.
    """
    names = [x.split()[0] for x in FOUND.split(", ")]
    keys = ("h", "c", "doc", "twin", "lo", "hi")
    carry, given = None, False

    def made(x: dict, pick: np.ndarray, is_open: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(x[n][pick]) for n in ("h", "doc", "twin", "lo", "hi")], pa.array(np.full(int(pick.sum()), is_open))], names=names)

    for batch in batches:
        done = batch.column(6).to_numpy(zero_copy_only=False)
        x = {n: batch.column(i).to_numpy() for i, n in enumerate(keys)}
        if done.any():
            yield made(x, done, False)
        x = {n: v[~done] for n, v in x.items()}
        if not len(x["h"]):
            continue
        carried = carry is not None
        if carried:
            x = {n: np.concatenate([carry[n], v]) for n, v in x.items()}
        first = np.flatnonzero(np.concatenate([[True], (x["h"][1:] != x["h"][:-1]) | (x["c"][1:] != x["c"][:-1])]))
        head = np.repeat(first, np.diff(np.append(first, len(x["h"]))))
        later = (x["doc"] != x["doc"][head]) | (x["lo"] != x["lo"][head])
        if later.any():
            yield made(x, later, False)
        x = {n: v[~later] for n, v in x.items()}
        h, c = x["h"], x["c"]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.append(starts, len(h)))
        mixed = np.add.reduceat(c != c[np.repeat(starts, sizes)], starts) > 0
        if carried and given:
            mixed[0] = True
        keep = np.repeat(mixed, sizes)
        if carried and given:
            keep[0] = False
        if keep.any():
            yield made(x, keep, True)
        carry, given = {n: v[-1:] for n, v in x.items()}, bool(mixed[-1])


class Queue:
    """A priority queue for induction: entries leave by byte value, then in the order of arrival. Chunks beyond the memory bound lie on disk."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file = memory, 0, None
        self.chunks: list[list] = [[] for _ in range(257)]

    def push(self, value: int, rows: np.ndarray) -> None:
        if self.held + rows.nbytes > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(rows.tobytes())
            self.chunks[value].append((at, len(rows)))
        else:
            self.held += rows.nbytes
            self.chunks[value].append(rows)

    def pop(self, value: int) -> Iterator[np.ndarray]:
        """All entries of a value, those pushed meanwhile included."""
        while mine := self.chunks[value]:
            self.chunks[value], parts = [], []
            for x in mine:
                if isinstance(x, tuple):
                    self.file.seek(x[0])
                    x = np.frombuffer(self.file.read(8 * x[1]), np.int64)
                    yield from [np.concatenate(parts)] if parts else []
                    parts = []
                    yield x
                else:
                    self.held -= x.nbytes
                    parts.append(x)
            yield from [np.concatenate(parts)] if parts else []

    def close(self) -> None:
        if self.file:
            self.file.close()


def suffix_order(t: np.ndarray, depth: int, memory: int = 256 << 20) -> np.ndarray:
    """Places of t (values 0 to 256) in the order of their suffixes, as far as their first depth values tell.

    Left-most S suffixes are ordered first: their substrings get names, and the shorter string of names is ordered by doubling of the
    named length, which ends once depth values are told apart. All other suffixes are induced from them through the queues.
    """
    n = len(t)
    if n < 2:
        return np.arange(n)
    diff = np.flatnonzero(t[1:] != t[:-1])
    small = np.zeros(n, bool)  # S: smaller than the suffix after it; the end counts as smaller than any value
    if len(diff):
        small[: diff[-1] + 1] = np.repeat(t[diff] < t[diff + 1], np.diff(np.append(-1, diff)))
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = _name_order(2 * t.astype(np.int64) + small, lms, depth)
    seeds = lms[order]
    head = t[seeds]
    bounds = np.searchsorted(head, np.arange(258))
    queue = Queue(memory)
    larges: list[list[np.ndarray]] = [[] for _ in range(257)]

    def induce(rows: np.ndarray, want: bool) -> None:
        before = rows[rows > 0] - 1
        before = before[small[before] == want]
        if not len(before):
            return
        value = t[before]
        by = np.argsort(value, kind="stable")
        before, value = before[by], value[by]
        cuts = np.flatnonzero(value[1:] != value[:-1]) + 1
        for part, v in zip(np.split(before, cuts), value[np.concatenate([[0], cuts])].tolist(), strict=True):
            queue.push(v, part)

    if not small[n - 1]:
        queue.push(int(t[n - 1]), np.array([n - 1]))
    for v in range(257):
        for rows in queue.pop(v):
            larges[v].append(rows)
            induce(rows, False)
        induce(seeds[bounds[v] : bounds[v + 1]], False)
    out: list[np.ndarray] = []
    for v in range(256, -1, -1):
        for rows in queue.pop(v):
            out.append(rows[::1])
            induce(rows, True)
        for rows in reversed(larges[v]):
            out.append(rows[::-1])
            induce(rows[::-1], True)
    queue.close()
    return np.concatenate(out)[::-1] if out else np.zeros(0, np.int64)


def _name_order(t: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes at lms: names of what lies between two of them (values with their type), then doubling."""
    m = len(lms)
    if m < 2:
        return np.arange(m)
    sizes = np.minimum(np.append(lms[1:] + 1, len(t)) - lms, depth + 1)
    rank, live, at = np.zeros(m, np.int64), np.arange(m), 0
    while len(live):  # six values at a time
        key = np.zeros(len(live), np.int64)
        for k in range(at, at + 6):
            inside = k < sizes[live]
            key = key << 10 | np.where(inside, t[np.minimum(lms[live] + k, len(t) - 1)] + 1, 0)
        part = np.zeros(m, np.int64)
        part[live] = _dense(key) + 1
        rank = _dense(rank * (len(live) + 2) + part)
        at += 6
        live = live[sizes[live] > at]
    step = 1
    while step < m and step <= depth and rank.max() + 1 < m:
        second = np.zeros(m, np.int64)
        second[:-step] = rank[step:] + 1
        new = _dense(rank * (m + 1) + second)
        if new.max() == rank.max():
            break
        rank = new
        step *= 2
    return np.argsort(rank, kind="stable")


def _dense(key: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct keys."""
    order = np.argsort(key)
    sorted_ = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
    return out


def equal_windows(rows: list[tuple[int, int, int, int, bytes]], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """rows: document, twin, first and last window, bytes of a record. Windows that equal an earlier one: document, twin, first, last."""
    sizes = np.array([len(r[4]) + 1 for r in rows], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"\0".join([r[4] for r in rows]) + b"\0", np.uint8)
    t = flat.astype(np.int16) + np.int16(1)  # records end in value 0, bytes are one more
    t[starts + sizes - 1] = 0
    counts = np.array([r[3] - r[2] + 1 for r in rows], np.int64)
    edge = np.zeros(len(t) + 1, np.int8)
    edge[starts] += 1
    edge[starts + counts] -= 1
    order = suffix_order(t, length)
    order = order[np.cumsum(edge[:-1]).astype(bool)[order]]
    same = np.zeros(len(order), bool)
    if length >= 8:
        word = np.zeros(max(len(flat) - 7, 0), np.uint64)
        for k in range(8):
            word |= flat[k : k + len(word)].astype(np.uint64) << np.uint64(8 * k)
        steps, value = [*range(0, length - 8, 8), length - 8], word
    else:
        steps, value = range(length), flat
    for at in range(1, len(order), 1 << 17):
        b = order[at : at + (1 << 17)]
        a = order[at - 1 : at - 1 + len(b)]
        alive = np.arange(len(b))
        for k in steps:
            alive = alive[value[a[alive] + k] == value[b[alive] + k]]
        same[at + alive] = True
    row = np.searchsorted(starts, order, side="right") - 1
    doc = np.array([r[0] for r in rows], np.int64)[row]
    place = np.array([r[2] for r in rows], np.int64)[row] + order - starts[row]
    group = np.cumsum(~same)
    by = np.lexsort((place, doc, group))
    g, doc, place, row = group[by], doc[by], place[by], row[by]
    if not len(g):
        return []
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    head = np.repeat(first, np.diff(np.append(first, len(g))))
    later = np.flatnonzero((doc != doc[head]) | (place != place[head]))
    row, place = row[later], place[later]
    by = np.lexsort((place, row))
    row, place = row[by], place[by]
    if not len(row):
        return []
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)]))
    last = np.append(new[1:], len(row)) - 1
    return [(*rows[r][:2], lo, hi) for r, lo, hi in zip(row[new].tolist(), place[new].tolist(), place[last].tolist(), strict=True)]


PIECE = "h long, doc long, twin long, lo long, hi long, raw binary, spot int"
PIECE_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(PIECE_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, PIECE_KINDS, strict=True)], names=[x.split()[0] for x in PIECE.split(", ")])


def anchor_spots(raws: list[bytes], length: int = LENGTH, k: int = GRAM) -> list[int]:
    """Where the anchor begins in each record: in its first window as in all others."""
    h = gram_hashes(np.frombuffer(b"".join([r[:length] for r in raws]), np.uint8), k)
    h = np.lib.stride_tricks.sliding_window_view(np.append(h, np.zeros(k - 1, np.uint64)), length)[::length, : length - k + 1] >> np.uint64(32)
    return (h.shape[1] - 1 - h[:, ::-1].argmin(1)).tolist()


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, twin, text, spans (h, lo, hi): the bytes of each record, and where in them its anchor is."""
    for batch in batches:
        for doc, twin, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            raw = memoryview(text.as_buffer())
            for i in range(0, len(spans), 5000):
                some = [(s["h"], s["lo"], s["hi"], bytes(raw[s["lo"] : s["hi"] + LENGTH])) for s in spans[i : i + 5000]]
                yield _pieces([(h, doc, twin, lo, hi, part, spot) for (h, lo, hi, part), spot in zip(some, anchor_spots([r[3] for r in some]), strict=True)])


#: Ways in which a window can hold its anchor.
SPOTS = LENGTH - GRAM + 1


def halves(level: int) -> list[tuple[int, int]]:
    """First and last spot of the anchor in the windows of each part, after so many halvings."""
    out = [(0, SPOTS - 1)]
    for _ in range(level):
        out = [p for a, b in out for p in (((a, (a + b) // 2), ((a + b) // 2 + 1, b)) if a < b else ((a, b),))]
    return out


def _split(level: int):
    """Records of anchors that are too large, cut by the parts of a level; a part's name includes all bytes that its windows share."""
    parts = halves(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for h, doc, twin, lo, hi, raw, spot in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for a, b in parts:
                    s, e = max(0, spot - b), min(hi - lo, spot - a)  # windows, counted from the record's first
                    if s <= e:
                        name = xxhash.xxh3_64_intdigest(raw[spot - a : spot - b + LENGTH], (h ^ (a * 0x9E3779B97F4A7C15)) % (1 << 64))
                        out.append((name - (1 << 64) if name >> 63 else name, doc, twin, lo + s, lo + e, raw[s : e + LENGTH], spot - s))
                        size += e - s + LENGTH
                if size > 8 << 20:
                    yield _pieces(out)
                    out, size = [], 0
            yield _pieces(out)

    return run


def _sort_shards(shard_bytes: int):
    """Rows come sorted by h; whole anchors are gathered into a shard of about shard_bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def done():
            found = equal_windows(held)
            columns = list(zip(*found, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(),) * 4, strict=True)], names=["doc", "twin", "lo", "hi"])

        for batch in batches:
            for h, *row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if h != last and size >= shard_bytes:
                    yield done()
                    held, size = [], 0
                last = h
                held.append(tuple(row))
                size += len(row[4])
        if held:
            yield done()

    return run


def shard_windows(raw: DataFrame, shard_bytes: int) -> DataFrame:
    """raw: the columns of PIECE. Windows that equal an earlier one: doc, twin, lo, hi. Anchors of more than shard_bytes are split first."""
    out, level = [], 0
    while True:
        sizes = raw.groupBy("h").agg(F.sum(F.octet_length("raw")).alias("n")).where(F.col("n") > shard_bytes)
        hot = cut(sizes.select("h"))
        small = raw if hot.isEmpty() else raw.join(hot, "h", "left_anti")
        out.append(small.repartition("h").sortWithinPartitions("h").mapInArrow(_sort_shards(shard_bytes), "doc long, twin long, lo long, hi long"))
        if hot.isEmpty():
            break
        level += 1
        # Each level begins from what is left of the records of the level before; the anchor's own name is part of the new one.
        raw = cut_table(raw.join(hot, "h", "left_semi").select(*[x.split()[0] for x in PIECE.split(", ")]).mapInArrow(_split(level), PIECE))
        if all(a == b for a, b in halves(level)):
            firsts = raw.groupBy("h", "raw").agg(F.min(F.struct("doc", "lo")).alias("first"))
            both = raw.join(firsts, ["h", "raw"]).where((F.col("doc") != F.col("first.doc")) | (F.col("lo") != F.col("first.lo")))
            out.append(both.select("doc", "twin", "lo", "hi"))
            break
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def flagged(docs: DataFrame, shard_bytes: int = 1 << 20) -> DataFrame:
    """docs: doc, twin, text. Windows to remove: doc, twin, lo, hi (first and last start of 100-byte strings that start earlier elsewhere)."""
    found = cut_table(docs.where(F.octet_length("text") >= LENGTH).mapInArrow(_records, RECORD).repartition("h").sortWithinPartitions("h", "c", "doc", "lo").mapInArrow(_settle, FOUND))
    release(docs.sparkSession)
    spans = found.where("open").groupBy("doc", "twin").agg(F.collect_set(F.struct("h", "lo", "hi")).alias("spans"))
    raw = cut_table(docs.join(spans, ["doc", "twin"]).select("doc", "twin", "text", "spans").mapInArrow(_bytes, PIECE))
    release(docs.sparkSession)
    return found.where("not open").select("doc", "twin", "lo", "hi").unionByName(shard_windows(raw, shard_bytes))


def removed_runs(spans: list[dict] | None, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs [start, end) that the windows cover."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi + length))
        else:
            out.append((lo, hi + length))
    return out


def _finish(full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                runs = removed_runs(spans.as_py())
                kept, at, digest = [], 0, hashlib.sha256()
                for s, e in [*runs, (len(raw), len(raw))]:
                    digest.update(raw[at:s])
                    if full:
                        kept.append(bytes(raw[at:s]))
                    at = e
                out.append((doc, len(raw), sum(e - s for s, e in runs), len(runs), digest.hexdigest(), *([b"".join(kept)] if full else [])))
            if out:
                kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())][: 5 + full]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = True, shard_bytes: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with full the bytes that stay (they may split a character)."""
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    keyed = given.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("twin"), "text")
    found = flagged(keyed.select("doc", "twin", "text"), shard_bytes)
    spans = found.groupBy("doc", "twin").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    whole = keyed.join(spans, ["doc", "twin"], "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(_finish(full), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * full)


#: DuckDB SQL for the rows of op6_suffixes; doc_id must be unique and not null.
ORACLE_SQL = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), blocks AS (
  SELECT doc_id, n, b, substr(h, (2 * b + 1)::BIGINT, 1398) AS part FROM (SELECT *, unnest(range(0, greatest(n - 99, 0), 600)) AS b FROM texts)
), windows AS (
  SELECT doc_id, b + i AS spot, md5_number(substr(part, (2 * i + 1)::BIGINT, 200)) AS k
  FROM (SELECT *, unnest(range(0, least(600, n - 99 - b))) AS i FROM blocks)
), firsts AS (
  SELECT k, min((doc_id, spot)) AS f FROM windows GROUP BY k HAVING count(*) > 1
), later AS (
  SELECT doc_id, spot FROM windows JOIN firsts USING (k) WHERE (doc_id, spot) <> f
), runs AS (
  SELECT doc_id, spot, sum(CASE WHEN spot - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY spot) AS run
  FROM (SELECT *, lag(spot) OVER (PARTITION BY doc_id ORDER BY spot) AS before FROM later)
), spans AS (
  SELECT doc_id, run, min(spot) AS s, max(spot) + 100 AS e FROM runs GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS z FROM spans
  UNION ALL SELECT texts.doc_id, coalesce(e, 0), n FROM texts LEFT JOIN (SELECT doc_id, max(e) AS e FROM spans GROUP BY doc_id) USING (doc_id)
), kept AS (
  SELECT doc_id, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (z - a))::BIGINT), '' ORDER BY a) AS h FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM texts JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(e - s) AS r, count(*) AS c FROM spans GROUP BY doc_id) USING (doc_id)
"""


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), full=False)
