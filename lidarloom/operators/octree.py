"""Octree keys, hierarchy validation and the tile table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import error

MAX_DEPTH = 32
KEY = ("depth", "x", "y", "z")


def key_text(*parts) -> Column:
    return F.concat_ws("-", *[F.col(p) if isinstance(p, str) else p for p in parts or KEY])


def parse_key(text: Column) -> Column:
    """Struct depth, x, y, z; null unless the text is four whole numbers joined by hyphens."""
    part = lambda k: F.regexp_extract(text, r"^(\d{1,18})-(\d{1,18})-(\d{1,18})-(\d{1,18})$", k).try_cast("long")
    return F.when(part(1).isNotNull(), F.struct(part(1).cast("int").alias("depth"), *[part(k + 1).alias(KEY[k]) for k in (1, 2, 3)]))


def ancestor(axis: Column, depth: Column, at: Column) -> Column:
    """The coordinate of the ancestor at depth at; depths are below 32, so that no shift wraps."""
    return F.call_function("shiftright", axis, (depth - at).cast("int"))


def beneath(root: tuple[int, int, int, int]) -> Column:
    """Whether a key lies in the subtree of root, itself included."""
    up = F.greatest(F.col("depth") - root[0], F.lit(0)).cast("int")
    inside = F.col("depth") >= root[0]
    for c, r in zip(KEY[1:], root[1:], strict=True):
        inside = inside & (F.call_function("shiftright", F.col(c), up) == r)
    return inside


def hierarchy_error(count: Column, length: Column, file_count: Column) -> Column:
    """The error code of a hierarchy entry (count -1 marks a sub-page), null if it is well-formed."""
    bad = (length < 0) | (count < -1) | ((count == -1) & (length == 0)) | ((count > 0) & (length == 0)) | ((count == 0) & (length > 0)) | (count > file_count)
    return F.when(F.coalesce(bad, F.lit(True)), F.lit("malformed-hierarchy"))


def tile_errors(entries: DataFrame, keys: list[str], root: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """Entries with error_code: too deep (told before the subtree), outside the page's subtree, or a key that comes twice."""
    twice = F.count(F.lit(1)).over(Window.partitionBy(*keys, *KEY)) > 1
    return entries.withColumn("error_code", F.when((F.col("depth") >= MAX_DEPTH) | ~beneath(root) | twice, F.lit("malformed-hierarchy")))


def require_clean(df: DataFrame) -> DataFrame:
    """Strict mode: the first quarantined row raises, at the time the query runs."""
    message = F.concat(F.lit("malformed-hierarchy: "), key_text())
    return df.where(F.when(F.col("error_code").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True)).drop("error_code")


def ancestor_closure(entries: DataFrame, keys: list[str], root_depth: int = 0) -> DataFrame:
    """All proper ancestors down from root_depth, once each. No iteration: each entry lists its own at once."""
    at = F.explode(F.when(F.col("depth") > root_depth, F.sequence(F.lit(root_depth), F.col("depth") - 1)))
    up = entries.select(*keys, *KEY).distinct().select(*keys, *KEY, at.alias("at"))
    return up.select(*keys, F.col("at").alias("depth"), *[ancestor(F.col(c), F.col("depth"), F.col("at")).alias(c) for c in KEY[1:]]).distinct()


def synthesized(entries: DataFrame, keys: list[str], root_depth: int = 0) -> DataFrame:
    """Ancestors that have no entry of their own."""
    return ancestor_closure(entries, keys, root_depth).join(entries.select(*keys, *KEY), [*keys, *KEY], "left_anti")


def tiles(nodes: DataFrame, pages: DataFrame | None, keys: list[str], token_base: str | Column = "copc://tiles/", root_depth: int = 0) -> DataFrame:
    """Nodes, sub-pages and missing ancestors as one table: keys, key, parent_key, kind, synthesized, uri.

    A node without points keeps its row and has no content; so has a synthesized ancestor, which its flag tells apart.
    """
    rows = nodes.select(*keys, *KEY, "point_count", F.when(F.col("point_count") > 0, F.lit("points")).alias("kind"))
    if pages is not None:
        rows = rows.unionByName(pages.select(*keys, *KEY, F.lit(None).cast("long").alias("point_count"), F.lit("hierarchy").alias("kind")))
    made = synthesized(rows, keys, root_depth).select(*keys, *KEY, F.lit(None).cast("long").alias("point_count"), F.lit(None).cast("string").alias("kind"), F.lit(True).alias("synthesized"))
    every = rows.withColumn("synthesized", F.lit(False)).unionByName(made)
    parent = F.when(F.col("depth") > root_depth, F.concat_ws("-", F.col("depth") - 1, *[F.shiftright(c, 1) for c in KEY[1:]]))
    letter = F.when(F.col("kind") == "points", F.lit("n/")).when(F.col("kind") == "hierarchy", F.lit("h/"))
    return every.select(*keys, *KEY, key_text().alias("key"), parent.alias("parent_key"), "point_count", "kind", "synthesized", F.concat(token_base if isinstance(token_base, Column) else F.lit(token_base), letter, key_text()).alias("uri"))


def point_totals(nodes: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """For each file (keys, point_count of its header) the points that its nodes hold, and a code where these are more."""
    held = nodes.groupBy(*keys).agg(F.sum("point_count").alias("held_points"))
    found = files.select(*keys, "point_count").join(held, keys, "left").withColumn("held_points", F.coalesce("held_points", F.lit(0).cast("long")))
    return found.withColumn("error_code", F.when(F.col("held_points") > F.col("point_count"), F.lit("malformed-hierarchy")))


def page_contents(pages: DataFrame, contents: DataFrame, keys: list[str]) -> DataFrame:
    """Pointers to sub-pages with what their pages hold at the same key (contents: keys, key parts, point_count); a pointer without its entry has a code."""
    held = contents.select(*keys, *KEY, "point_count")
    return pages.select(*keys, *KEY).join(held, [*keys, *KEY], "left").withColumn("error_code", F.when(F.col("point_count").isNull(), F.lit("malformed-hierarchy")))


def cell_bounds(cube: list[float]) -> dict[str, Column]:
    """Bounds of a key's cell in the cube (min x, y, z, max x, y, z)."""
    out = {}
    for i, c in enumerate(KEY[1:]):
        side = F.lit(cube[i + 3] - cube[i]) / F.pow(F.lit(2.0), F.col("depth"))
        out[f"{c}_lo"] = F.lit(cube[i]) + side * F.col(c)
        out[f"{c}_hi"] = F.lit(cube[i]) + side * F.col(c) + side
    return out


def prune(nodes: DataFrame, cube: list[float], box: list[float], max_depth: int) -> DataFrame:
    """Nodes down to max_depth whose cell meets the box: metadata alone decides which chunks are read."""
    b = cell_bounds(cube)
    meets = F.lit(True)
    for i, c in enumerate(KEY[1:]):
        meets = meets & (b[f"{c}_hi"] >= box[i]) & (b[f"{c}_lo"] <= box[i + 3])
    return nodes.where((F.col("depth") <= max_depth) & meets)


def check_token_base(base: str) -> str:
    """An absolute URI with a scheme, ending in a slash, that normalising leaves as it is."""
    from urllib.parse import urlsplit, urlunsplit

    parts = urlsplit(base)
    if not parts.scheme or not base.endswith("/") or urlunsplit(parts) != base or any(p in (".", "..") for p in parts.path.split("/")):
        raise error("invalid-token-base", f"{base!r} can't be the base of tile URIs")
    return base
