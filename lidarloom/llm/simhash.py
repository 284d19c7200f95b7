"""SimHash near-duplicates, compared on vertical bit planes.

Fingerprints at most radius bits apart agree on two of radius + 2 blocks of bits, whichever those are: each distinct fingerprint
goes to one bucket for each choice of blocks. Inside a bucket the fingerprints are held as bit planes (one integer for
each free bit, one bit for each member); a member is compared with all others at once by adding its mismatches
into carry-save counters, and is abandoned as soon as every counter exceeds the radius. A bucket beyond bucket_rows members
is split by the same rule on its free bits, again and again; the choice of blocks loses no pair, and in the
end the number of free bits bounds the bucket, so that no group is cut or capped.

A bucket yields a spanning forest of its links, not all pairs; components of the whole graph follow by star contraction.
Null text is empty: fingerprint zero, linked like any other. Repeated rows get the same row each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, ship, table
from .components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of width words, repeats included; fewer words make one shingle, none make none."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    row, h = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends.tolist()[min(width, len(words)) - 1 :]
    return np.array([h(row[s:e], SEED) for s, e in zip(starts, ends, strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [signed(fingerprint(shingle_hashes(t.as_py(), width))) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(made, pa.int64())], names=[*batch.schema.names[1:], "fp"])

    return run


def masks(free: tuple[int, ...], radius: int) -> list[int]:
    """The choices of two of radius + 2 blocks of the free bits, as masks of those bits."""
    blocks = [free[i * len(free) // (radius + 2) : (i + 1) * len(free) // (radius + 2)] for i in range(radius + 2)]
    return [sum(1 << b for b in (*x, *y)) for x, y in combinations(blocks, 2)]


def free_bits(mask: int) -> tuple[int, ...]:
    return tuple(b for b in range(64) if not mask >> b & 1)


def links(fps: list[int], radius: int, free: tuple[int, ...]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the fingerprints (unsigned, distinct) within radius, as pairs of indices."""
    n = len(fps)
    full = (1 << n) - 1
    planes = [sum((fp >> b & 1) << i for i, fp in enumerate(fps)) for b in free]
    width = (radius + 1).bit_length()
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for i, fp in enumerate(fps[:-1]):
        counters, over = [0] * width, 0
        later = full ^ ((2 << i) - 1)
        for b, plane in zip(free, planes, strict=True):
            carry = (plane ^ full if fp >> b & 1 else plane) & later
            for k in range(width):
                if not carry:
                    break
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry | _beyond(counters, radius)
            if over == later:
                break
        near = later & ~over
        while near:
            j = (near & -near).bit_length() - 1
            near &= near - 1
            if (a := top(i)) != (c := top(j)):
                root[max(a, c)] = min(a, c)
                out.append((j, i))
    return out


def _beyond(counters: list[int], radius: int) -> int:
    """Members whose counter reads radius + 1: counting stops there, so that equality is enough."""
    out = -1
    for k, c in enumerate(counters):
        out &= c if (radius + 1) >> k & 1 else ~c
    return out


def _compare(radius: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((3, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            if not rows.shape[1]:
                continue
            new = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            last = int(new[-1]) if len(new) else 0
            yield pairs(rows[:, :last])
            rest = rows[:, last:]
        yield pairs(rest)

    def pairs(rows: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        if rows.shape[1]:
            starts = np.concatenate([[0], np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1, [rows.shape[1]]])
            for k in np.flatnonzero(np.diff(starts) > 1).tolist():
                s, e = int(starts[k]), int(starts[k + 1])
                fps = rows[2, s:e].view(np.uint64).tolist()
                for i, j in links(fps, radius, free_bits(int(rows[0, s]) & ((1 << 64) - 1))):
                    a.append(signed(fps[i]))
                    b.append(signed(fps[j]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return compare


def near(fps: DataFrame, radius: int, bucket_rows: int = 256, broadcast_rows: int = 200_000) -> DataFrame:
    """Edges a, b that span the links (at most radius differing bits) of the distinct fingerprints in column fp."""
    ship(fps.sparkSession)

    def keyed(rows: DataFrame, choice: Column) -> DataFrame:
        spread = rows.select("fp", F.explode(choice).alias("mask"))
        return spread.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")

    level = masks(tuple(range(64)), radius)
    rows = keyed(fps, F.array(*[F.lit(signed(m)) for m in level]))
    cold: list[DataFrame] = []
    while True:
        free = 64 - level[0].bit_count()
        if 1 << free <= bucket_rows or free < radius + 2:
            cold.append(rows)
            break
        hot = cut(rows.groupBy("mask", "value").count().where(F.col("count") > bucket_rows).select("mask", "value"))
        n_hot = hot.count()
        if not n_hot:
            cold.append(rows)
            break
        side = F.broadcast(hot) if n_hot <= broadcast_rows else hot
        cold.append(rows.join(side, ["mask", "value"], "left_anti"))
        used = {r[0] & ((1 << 64) - 1) for r in hot.select("mask").distinct().collect()}  # at most as many as there are choices
        children = {m: [m | c for c in masks(free_bits(m), radius)] for m in level if m in used}
        choice = F.create_map(*[x for m, cs in children.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(c)) for c in cs]))])
        level = sorted({c for cs in children.values() for c in cs}, key=lambda m: m.bit_count())
        rows = keyed(rows.join(side, ["mask", "value"], "left_semi"), F.element_at(choice, F.col("mask"))).distinct()
    every = cold[0]
    for more in cold[1:]:
        every = every.unionByName(more)
    return every.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(_compare(radius), "a long, b long")


def link(prints: DataFrame, radius: int) -> DataFrame:
    """prints: doc_id, fp. Returns them with component_id, the smallest doc_id reachable by links."""
    firsts = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near(firsts, radius)).select(F.col("node").alias("fp"), "root")
    whole = cut(firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = cut(whole.groupBy("root").agg(F.min("first").alias("component_id")))
    named = cut(whole.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, fp (as a signed long) of documents with columns doc_id, text; kept in the checkpoint folder, 16 bytes a document."""
    ship(docs.sparkSession)
    given = docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long").alias("doc_id"))
    return cut(given.mapInArrow(_fingerprints(width), "doc_id long, fp long"))


def classes(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    found = link(fingerprints(docs, width), radius)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """docs with one document of each component, that of the smallest id (null last); all columns stay.

    Rows that share an id but not a text are documents of their own; rows that share both are copies, of which one stays.
    """
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    prints = fingerprints(given, width)
    edges = near(cut(prints.select("fp").distinct()), radius)
    return kept_of(docs, prints, components(edges), id_col, text_col, lambda t: signed(fingerprint(shingle_hashes(t, width))))


def _named(name_of, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([name_of(t.as_py()) for t in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], names=[*batch.schema.names[1:], column])

    return run


def kept_of(docs: DataFrame, prints: DataFrame, roots: DataFrame, id_col: str, text_col: str, name_of) -> DataFrame:
    """One row of docs for each component. prints: doc_id, fp of every row; roots: node, root of the linked fp; name_of: fp of a text.

    The text stays where it is unless its id is null or comes twice: only then is its fp computed again to tell the rows apart.
    """
    own, fp, text, other, name = (free_name(docs, n) for n in ("keep_id", "keep_fp", "keep_text", "keep_several", "keep_name"))
    firsts = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"))
    linked = firsts.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), F.struct("first.none", "first.doc_id", "fp").alias("k"))
    heads = cut(linked.groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.doc_id").alias(own), F.col("k.fp").alias(fp)))
    several = cut(prints.groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(own).isNull()).select(own))
    here = F.col(f"`{id_col}`").cast("long")
    alone = heads.join(several.withColumnRenamed(own, other), F.col(own).eqNullSafe(F.col(other)), "left_anti")
    kept = docs.join(alone.select(own), here == F.col(own), "left_semi")
    if several.isEmpty():
        return kept
    both = docs.join(heads.join(several.withColumnRenamed(own, other), F.col(own).eqNullSafe(F.col(other)), "left_semi").select(own).distinct(), here.eqNullSafe(F.col(own)), "left_semi")
    given = both.select(F.col(f"`{text_col}`").cast("string").alias(text), *[F.col(f"`{c}`") for c in docs.columns])
    made = given.mapInArrow(_named(name_of, fp), T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())]))
    picked = made.join(heads.select(F.col(own), F.col(fp).alias(name)), here.eqNullSafe(F.col(own)) & (F.col(fp) == F.col(name)), "left_semi")
    return kept.unionByName(picked.dropDuplicates([id_col, fp]).drop(fp))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
