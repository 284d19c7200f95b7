"""Embedding near-duplicates by an inverted multi-index.

Two codebooks, one for each half of the normalised vectors, are trained apart on a bounded sample; their product is a grid
of cells. Every distinct vector is filed in its cell, and looks up cells in the order of a multi-sequence traversal: two lists of
half-distances, walked from the nearest pair of entries outwards. The distance of an entry is how far the half must move to
cross into that codeword's region, so that the walk may stop at the distance that the threshold allows: every pair of the
threshold is then found (reach 1). A smaller reach, the share of that distance, trades recall for speed. It is measured on the table itself: a
bounded sample of vectors is compared with all others by brute force, and the least reach that finds every pair of the sample
is taken, or 1 if the sample has too few pairs to tell. What is found is verified by cosine in double precision.

Equal vectors of a label are one row with a count, so that copies are never expanded into pairs; cells beyond cell_rows
members are dealt out in parts. Vectors that are null, empty, zero, or hold null or non-finite components, and
rows without label or id, link with nothing; vectors of different lengths never link. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship, table
from .components import components


@dataclass
class Codebooks:
    """Codewords of either half; vectors of other lengths are cut or padded with zeros, which keeps distances lower bounds."""

    halves: tuple[np.ndarray, np.ndarray]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        a, b = (h.shape[1] for h in self.halves)
        x = np.pad(x, ((0, 0), (0, max(0, a + b - x.shape[1]))))
        return [x[:, :a], x[:, a : a + b]]

    def gaps(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distance of each half of each row to the region of each codeword: 0 for its own."""
        out = []
        for half, words in zip(self.parts(x), self.halves, strict=True):
            d = (half**2).sum(1)[:, None] - 2 * half @ words.T + (words**2).sum(1)
            own = d.argmin(1)
            apart = np.sqrt(((words[:, None] - words[None]) ** 2).sum(2))[own]
            gap = np.maximum(d - d[np.arange(len(d)), own][:, None], 0) / np.maximum(2 * apart, 1e-12)
            gap[np.arange(len(d)), own] = 0
            out.append(gap**2)
        return out


def traverse(first: np.ndarray, second: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) by growing first[i] + second[j], as long as that is at most most."""
    order = [np.argsort(v, kind="stable").tolist() for v in (first, second)]
    a, b = (v[o].tolist() for v, o in zip((first, second), order, strict=True))
    heap, seen = [(a[0] + b[0], 0, 0)], {(0, 0)}
    while heap and heap[0][0] <= most:
        _, i, j = heapq.heappop(heap)
        yield order[0][i], order[1][j]
        for k, m in ((i + 1, j), (i, j + 1)):
            if k < len(a) and m < len(b) and (k, m) not in seen:
                seen.add((k, m))
                heapq.heappush(heap, (a[k] + b[m], k, m))


def kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    words = x[np.random.default_rng(11).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = ((x**2).sum(1)[:, None] - 2 * x @ words.T + (words**2).sum(1)).argmin(1)
        for i in range(len(words)):
            if (m := own == i).any():
                words[i] = x[m].mean(0)
    return np.unique(words, axis=0)


def train(distinct: DataFrame, size: int, sample_rows: int) -> Codebooks | None:
    """Codebooks of size words each from at most sample_rows distinct vectors, those of the smallest hashes."""
    rows = [r[0] for r in distinct.select("v").orderBy(F.xxhash64("v")).limit(sample_rows).collect()]
    if not rows:
        return None
    width = max(map(len, rows))
    x = np.array([r + [0.0] * (width - len(r)) for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a = (width + 1) // 2
    second = x[:, a:] if width > 1 else np.zeros((len(x), 1))
    return Codebooks((kmeans(x[:, :a], size), kmeans(second, size)))


def matrix(column: pa.Array) -> list[np.ndarray]:
    """The vectors of a list column; lengths may differ."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ends = ends - ends[0]
    return [flat[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]


FILED = "cell long, probe boolean, rep long, n long, label string, v array<double>"


def _file(books: Codebooks, most: float):
    """Each vector as a member of its own cell and as a probe of the cells that its walk visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in [whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)]:
                vectors = matrix(batch.column(3))
                cells, rows, probe = [], [], []
                by_length: dict[int, list[int]] = {}
                for i, v in enumerate(vectors):
                    by_length.setdefault(len(v), []).append(i)
                for at in by_length.values():
                    x = np.stack([vectors[i] for i in at])
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    first, second = books.gaps(x)
                    for k, i in enumerate(at):
                        for n, (a, b) in enumerate(traverse(first[k], second[k], most)):
                            for p in (False, True)[n > 0 :]:
                                cells.append(a << 20 | b)
                                rows.append(i)
                                probe.append(p)
                picked = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(probe), *[batch.column(c).take(picked) for c in range(4)]], names=["cell", "probe", "rep", "n", "label", "v"])

    return run


def _needed(books: Codebooks, queries: list[tuple], least: float):
    """Number of pairs of queries (rep, label, v) with the rows, and the greatest squared distance that a walk goes to find one, in either direction."""
    groups: dict[tuple, list[tuple]] = {}
    for rep, label, v in queries:
        groups.setdefault((label, len(v)), []).append((rep, v))

    def cells(gaps: list[np.ndarray]) -> list[np.ndarray]:
        return [g.argmin(1) for g in gaps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {}
        for key, rows in groups.items():
            x = np.array([v for _, v in rows])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            gaps = books.gaps(x)
            made[key] = (np.array([r for r, _ in rows]), x, gaps, cells(gaps))
        n, most = 0, 0.0
        for whole in batches:
            for batch in [whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)]:
                vectors, reps = matrix(batch.column(2)), batch.column(0).to_numpy()
                at: dict[tuple, list[int]] = {}
                for i, (label, v) in enumerate(zip(batch.column(1).to_pylist(), vectors, strict=True)):
                    at.setdefault((label, len(v)), []).append(i)
                for key in at.keys() & made.keys():
                    own, y, gaps, cell = made[key]
                    x = np.stack([vectors[i] for i in at[key]])
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    q, r = np.nonzero((y @ x.T >= least) & (own[:, None] != reps[at[key]]))
                    if len(q):
                        theirs = books.gaps(x[r])
                        there = cells(theirs)
                        asked = sum(g[q, c] for g, c in zip(gaps, there, strict=True))
                        back = sum(g[np.arange(len(r)), c[q]] for g, c in zip(theirs, cell, strict=True))
                        n, most = n + len(q), max(most, float(np.maximum(asked, back).max()))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([most])], names=["n", "most"])

    return run


def measured_reach(distinct: DataFrame, books: Codebooks, least: float, query_rows: int, least_pairs: int = 200) -> float:
    """The least reach by which query_rows vectors find all their partners; 1 if these have fewer than least_pairs."""
    queries = [tuple(r) for r in distinct.select("rep", "label", "v").orderBy(F.xxhash64("v", F.lit(7))).limit(query_rows).collect()]
    found = distinct.select("rep", "label", "v").mapInArrow(_needed(books, queries, least), "n long, most double").agg(F.sum("n"), F.max("most")).first()
    if (found[0] or 0) < least_pairs:
        return 1.0
    return min(1.0, (found[1] / max(2 - 2 * least, 1e-9)) ** 0.5)


LINKED = "a long, b long, n long"


def _verify(least: float):
    """Rows come sorted by group and members before probes: (a, null, links of a in this group) and forest edges (a, b, 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, reps, counts, made, root = None, np.zeros(0, np.int64), np.zeros(0), None, {}

        def top(i):
            while root.setdefault(i, i) != i:
                root[i] = i = root[root[i]]
            return i

        waiting: list = []

        def close():
            nonlocal reps, counts, made
            if waiting:
                reps, counts = np.array([w[0] for w in waiting]), np.array([w[1] for w in waiting])
                x = np.stack([w[2] for w in waiting])
                made = (x, np.linalg.norm(x, axis=1))
                waiting.clear()

        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True))
            probe, rep, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6))
            vectors = matrix(batch.column(7))
            starts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            a, b, links = [], [], []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if s == e:
                    continue
                if keys[s] != group:
                    group, made = keys[s], None
                    waiting.clear()
                    root.clear()
                m = s
                while m < e and not probe[m]:
                    waiting.append((rep[m], n[m], vectors[m]))
                    m += 1
                if m == e:
                    continue
                close()
                if made is None:
                    continue
                for at in range(m, e, 2048):
                    x = np.stack(vectors[at : min(e, at + 2048)])
                    own = rep[at : at + len(x)]
                    cosine = (x @ made[0].T) / (np.linalg.norm(x, axis=1)[:, None] * made[1])
                    hit = (cosine >= least) & (own[:, None] != reps)
                    total = hit @ counts
                    some = np.flatnonzero(total)
                    a += own[some].tolist()
                    b += [None] * len(some)
                    links += total[some].astype(np.int64).tolist()
                    for i, j in zip(*np.nonzero(hit), strict=True):
                        p, q = top(int(own[i])), top(int(reps[j]))
                        if p != q:
                            root[max(p, q)] = min(p, q)
                            a.append(int(own[i]))
                            b.append(int(reps[j]))
                            links.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "n"])

    return run


def link(rows: DataFrame, least: float = 0.98, words: int | None = None, sample_rows: int = 4000, reach: float | None = None, cell_rows: int = 1024, query_rows: int = 1000) -> DataFrame:
    """rows: vec_id, embedding, label. Returns vec_id, n_links, component_id, kept, one row per vector."""
    spark = rows.sparkSession
    ship(spark)
    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(ok, F.lit(False))
    distinct = cut(given.where(usable).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    words = words or max(16, min(256, int((distinct.count() / 5000) ** 0.5)))  # about as many rows a cell at any size
    books = train(distinct, words, sample_rows)
    if books is None:
        return given.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if reach is None:
        reach = measured_reach(distinct, books, least, query_rows)
    # Cosine c means a squared distance of 2 - 2c between normalised vectors.
    filed = distinct.select("rep", "n", "label", "v").mapInArrow(_file(books, (2 - 2 * least) * reach**2 + 1e-9), FILED)
    filed = cut(filed.withColumn("size", F.size("v")))
    place = ["label", "size", "cell"]
    parts = cut(filed.where("not probe").groupBy(place).agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("parts")))
    dealt = filed.join(parts, place)
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    own = F.array(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.select(*place, F.explode(F.when(F.col("probe"), every).otherwise(own)).alias("part"), "probe", "rep", "n", "v")
    key = [*place, "part"]
    found = cut(dealt.repartition(*key).sortWithinPartitions(*key, "probe").mapInArrow(_verify(least), LINKED))
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "root")
    named = distinct.join(links, "rep", "left").join(roots, "rep", "left")
    named = cut(named.select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("root")))
    # Rows that link with nothing are kept out of the join, whose key would bring them together.
    linked = given.where(usable).join(named, ["label", "v"]).select("vec_id", F.col("links").alias("n_links"), F.col("root").alias("component_id"))
    alone = given.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: DuckDB SQL for the rows of op10_multiindex, all pairs of a label compared; vec_id must be unique and not null.
ORACLE_SQL = """
WITH RECURSIVE given AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), usable AS (
  SELECT vec_id, label, list_transform(v, lambda x: coalesce(x, 0)) AS v FROM given
  WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) END >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS spot FROM given
  UNION SELECT node, b FROM reach JOIN links ON spot = a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM given JOIN (SELECT node AS vec_id, min(spot) AS component_id FROM reach GROUP BY node) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""


def op10_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))
