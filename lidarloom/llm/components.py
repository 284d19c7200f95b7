"""Connected components of a graph given as edges, by alternating star contraction.

Nothing but the edges of the present round is kept, in the checkpoint folder; nodes with very many edges are handled by pre-aggregated minima
and by joins whose large partitions Spark splits. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _minima(edges: DataFrame) -> DataFrame:
    return cut(edges.groupBy("a").agg(F.min("b").alias("m")))


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none if it has one from above: one pass, of which a number reaches the driver."""
    end = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    ends = edges.select(F.inline(F.array(end("a", 1), end("b", 0))))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where("up > 1 or up > 0 and down > 0").agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a, b of one type. Returns node, root: root is the smallest node of the component; nodes without edges are absent.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    """
    e = cut(_distinct(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    for _ in range(most_rounds):
        if _settled(e):
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.where("b > a").join(_minima(both), "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = cut(_distinct(large))
        least = _minima(large)
        # The neighbours of a node meet the least of them; so does the node itself, in the row of that neighbour.
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = cut(_distinct(small))
        del both, large, least, small
        release(e.sparkSession)  # shuffles and checkpoints of the round are of no more use
    raise RuntimeError("components did not settle")
