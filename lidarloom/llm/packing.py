"""Packing of tokenised documents into sequences of fixed length by minimum bin slack.

A document's ids, with the end id, are cut into full pieces of the capacity and one rest. Packing looks only at the
histogram of piece lengths, which the capacity bounds whatever the corpus holds: the longest length left seeds a
window; a subset sum over the other lengths with their counts, as a bitset of reachable sums, finds the filling closest
to the capacity, and backtracking through the bitsets gives how often each length is used; that filling is repeated as long as its lengths
last. Pieces then find their place by their rank among pieces of their length, counted in salted groups, so that one
length may hold any share of the rows.

A null or empty text is the end id alone. Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import ctypes
import os
import zlib
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import cut, ship, table

CAPACITY, END = 4096, 2
SALTS = 256
#: Entries of each generation of a worker's caches: plain words, other words, marks.
CACHES = (100_000, 10_000, 5_000)
#: A word of letters with the marks after it.
PLAIN = "^(?P<word>[a-zA-ZÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?]*)$"
#: Bytes of text whose words are told apart together, and plain words that are encoded in one go.
SLICE_BYTES, GO_WORDS = 4 << 20, 4_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Recent:
    """A bounded cache of two generations: entries that aren't asked for while the young one fills up are dropped."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys) -> list:
        """Those of the keys that aren't known; the others are in the young generation afterwards."""
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out

    def add(self, made: dict) -> None:
        self.young.update(made)

    def age(self) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    The tokenizer drops white space and no match of its pattern crosses it, so the distinct words of many texts are encoded apart; a plain
    word is encoded apart from the marks after it, and remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.plain, self.words, self.marks = map(Recent, CACHES)

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, words: list[str]) -> list[bytes]:
        """Lower-case words of letters: each is one match, whose last id ends a word, so that they can be encoded in one go."""
        row = self.raw([" ".join(words)])[0]
        ends = ((np.flatnonzero(self.ends[np.frombuffer(row, "<u4")]) + 1) * 4).tolist()
        return [row[s:e] for s, e in zip([0, *ends], ends, strict=False)] if len(ends) == len(words) else self.raw(words)

    def remembered(self, cache: Recent, words: pa.Array, make) -> pa.Array:
        """Ids of each of words, which may repeat; those that the cache hasn't are made, GO_WORDS at a time."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        cache.age()
        new = cache.missing(distinct)
        for at in range(0, len(new), GO_WORDS):
            part = new[at : at + GO_WORDS]
            cache.add(dict(zip(part, make(part), strict=True)))
        return pa.array(map(cache.young.__getitem__, distinct), pa.large_binary(), size=len(distinct)).take(coded.indices)

    def encode_words(self, distinct: pa.Array) -> pa.Array:
        """Ids of words with the marks around them."""
        found = pc.extract_regex(distinct, PLAIN)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        word, marks = found.drop_null().flatten()
        word, marks = self.remembered(self.plain, pc.utf8_lower(word), self.together), self.remembered(self.marks, marks, self.raw)
        others = self.remembered(self.words, distinct.filter(pa.array(~plain)), self.raw)
        place = np.where(plain, np.cumsum(plain) - 1, plain.sum() + np.cumsum(~plain) - 1)
        return pa.concat_arrays([pc.binary_join_element_wise(word, marks, pa.scalar(b"", pa.large_binary())), others]).take(pa.array(place))

    def encode(self, text: str) -> bytes:
        return bytes(next(self.encode_all(pa.array([text], pa.string()))))

    def encode_all(self, texts: pa.Array) -> Iterator[memoryview]:
        """Ids of each text; a null one has none."""
        split = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        ids = self.encode_words(coded.dictionary).take(coded.indices)
        if not len(ids):
            yield from [memoryview(b"")] * len(texts)
            return
        bounds = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][split.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        for s, e in zip(bounds, bounds[1:], strict=False):
            yield data[s:e]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def trim() -> None:
    """Gives freed memory back to the system, so that a worker's peak is that of one slice and its caches."""
    with suppress(OSError, AttributeError):  # no such call outside glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of runs of at most SLICE_BYTES of text, or of one longer text."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    first = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > SLICE_BYTES:
            yield first, i - first
            first, size = i, 0
        size += n
    if len(sizes) > first:
        yield first, len(sizes) - first


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        enc, tail = encoder(path), int(end).to_bytes(4, "little")
        names = [x.split()[0] for x in PIECES.split(", ")]
        for whole in batches:
            for batch in (whole.slice(*s) for s in slices(whole.column(1))):
                rows: list[tuple] = []
                for doc_id, body in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1)), strict=True):
                    ids = bytes(body) + tail
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        part = ids[4 * at : 4 * (at + capacity)]
                        rows.append((doc_id, at, len(part) // 4, zlib.crc32(part), n))
                made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                rows.clear()
                trim()
                yield made

    return run


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to use each length so that the sum is as close to room as it gets: bitset dynamic programming, backtracked."""
    reach, steps = 1, []
    mask = (2 << room) - 1
    for length in sorted((k for k, n in counts.items() if n and k <= room), reverse=True):
        n, part = min(counts[length], room // length), 1
        while n:
            part = min(part, n)
            steps.append((reach, length, part))
            reach |= reach << part * length & mask
            n -= part
            part *= 2
        if reach >> room & 1:
            break
    left, out = reach.bit_length() - 1, {}
    for before, length, part in reversed(steps):
        if not before >> left & 1:
            left -= part * length
            out[length] = out.get(length, 0) + part
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fillings and how often each is repeated; each repeat uses some length up, which bounds their number."""
    counts, out = {k: n for k, n in counts.items() if n}, []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        use = fill(counts, capacity - seed)
        counts[seed] += 1
        use[seed] = use.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in use.items())
        out.append((use, times))
        for k, n in use.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return out


def places(fillings: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length a table with a row for each filling that uses it: first rank, uses in a window, first sequence, offset."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for use, times in fillings:
        offset = 0
        for length, n in sorted(use.items(), reverse=True):
            out.setdefault(length, []).append((ranks.get(length, 0), n, sequence, offset))
            ranks[length] = ranks.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64).T for k, v in out.items()}


def _place(tables: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # a worker that places pieces needs no words any more
        trim()
        for batch in batches:
            length, rank = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                at = np.flatnonzero(length == k)
                first, n, begin, off = tables[k]
                row = np.searchsorted(first, rank[at], side="right") - 1
                within = rank[at] - first[row]
                sequence[at] = begin[row] + within // n[row]
                offset[at] = off[row] + within % n[row] * k
            keep = [i for i, c in enumerate(batch.schema.names) if c != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(sequence), pa.array(offset)], names=[*[batch.schema.names[i] for i in keep], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = cut(given.mapInArrow(_pieces(path or tokenizer_path(), capacity, end), PIECES))
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int")
    salted = pieces.withColumn("salt", salt)
    groups = cut(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r[0]: r[1] for r in groups.groupBy("length").agg(F.sum("n")).collect()}
    tables = places(plan(histogram, capacity))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(groups.select("length", "salt", before.alias("before")))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(starts, ["length", "salt"])
    ranked = ranked.select(*[x.split()[0] for x in PIECES.split(", ")], (F.col("before") + F.col("own") - 1).alias("rank"))
    return ranked.mapInArrow(_place(tables), PIECES + ", sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
