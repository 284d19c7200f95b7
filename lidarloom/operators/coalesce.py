"""Coalescing of byte ranges into reads.

Ranges of a file are taken in order of their offsets. A range joins the group before it if the gap is at most max_gap bytes
and the group's wasted bytes stay within max_waste of its length. One exchange by file and one ordered pass over Arrow batches; a task holds
the ranges of the read that it is at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import error
from ..functions.ranges import usable

#: 256 KiB and 2 per cent.
MAX_GAP, MAX_WASTE = 256 * 1024, 0.02


def refused(requests: DataFrame, file: str) -> DataFrame:
    """Requests with error_code: not whole, negative, empty, or overlapping any range that begins before."""
    before = Window.partitionBy(file).orderBy("offset", "idx").rowsBetween(Window.unboundedPreceding, -1)
    end = F.max(F.col("offset") + F.col("length")).over(before)
    bad = ~usable(F.col("offset"), F.col("length")) | (F.col("offset") < end)
    return requests.withColumn("error_code", F.when(F.coalesce(bad, F.lit(False)), "invalid-byte-range"))


def _fold(max_gap: int, max_waste: float):
    """Rows come sorted by file, offset, idx: each with the start, length and wanted bytes of its read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[pa.RecordBatch]] = [[]]  # the rows of the read that is open, as slices of batches
        last, start, end, wanted = None, 0, 0, 0

        def made(rows: list[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
            for r in rows:
                offset = r.column(2).to_numpy()
                columns = [r.column(0), r.column(1), *[pa.array(np.full(len(offset), v, np.int64)) for v in (start, span, wanted)], pa.array(offset - start), r.column(3)]
                yield pa.RecordBatch.from_arrays(columns, names=[*r.schema.names[:2], "span_offset", "span_length", "wanted", "slice_offset", "slice_length"])

        for batch in batches:
            at, out = 0, []
            for i, (f, o, n) in enumerate(zip(*[batch.column(k).to_pylist() for k in (0, 2, 3)], strict=True)):
                if o is None or n is None or o < 0 or n < 1 or ((f,) == last and o < end):
                    raise error("invalid-byte-range", f"{f}: {o}+{n} is empty, negative or overlaps the range before")
                span = o + n - start
                if (f,) == last and o - end <= max_gap and span - wanted - n <= span * max_waste:
                    end, wanted = o + n, wanted + n
                    continue
                if i > at:
                    parts[0].append(batch.slice(at, i - at))
                out += made(parts[0], end - start)
                parts[0], at = [], i
                last, start, end, wanted = (f,), o, o + n, n
            if batch.num_rows > at:
                parts[0].append(batch.slice(at))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        yield from made(parts[0], end - start)

    return run


def plan(requests: DataFrame, file: str, max_gap: int = MAX_GAP, max_waste: float = MAX_WASTE) -> DataFrame:
    """requests: file, idx, offset, length. Returns file, idx, span_offset, span_length, wanted, slice_offset, slice_length.

    Ranges that refused() would flag raise invalid-byte-range: a plan over them would read less than is wanted.
    """
    given = requests.select(file, F.col("idx").cast("long").alias("idx"), F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"))
    rows = given.repartition(file).sortWithinPartitions(file, "offset", "idx")
    kind = dict(given.dtypes)[file]
    return rows.mapInArrow(_fold(max_gap, max_waste), f"`{file}` {kind}, idx long, span_offset long, span_length long, wanted long, slice_offset long, slice_length long")


def stats(planned: DataFrame, file: str) -> DataFrame:
    """Per file: ranges, reads, bytes wanted, read and wasted, and requests saved."""
    groups = planned.groupBy(file, "span_offset").agg(F.first("span_length").alias("span"), F.first("wanted").alias("wanted"), F.count(F.lit(1)).alias("n"))
    return groups.groupBy(file).agg(F.sum("n").alias("n_ranges"), F.count(F.lit(1)).alias("n_reads"), F.sum("wanted").alias("bytes_wanted"), F.sum("span").alias("bytes_read"), F.sum(F.col("span") - F.col("wanted")).alias("bytes_wasted"), F.sum(F.col("n") - 1).alias("requests_saved"))
