"""The point pipeline: scale and offset, geocentric positions, tile boxes, centres and relative positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crs import Transform, ecef


def with_ecef(points: DataFrame, transform: Transform) -> DataFrame:
    """points (x, y, z in file units) with ex, ey, ez."""
    df = transform.with_wgs84(points, "x", "y", "z", "__")
    made = ecef(F.col("__lon"), F.col("__lat"), F.col("__height"))
    return df.withColumns(dict(zip(("ex", "ey", "ez"), made, strict=True))).drop("__lon", "__lat", "__height")


def boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    """Geocentric box of each tile, with its middle as the centre; partial aggregates make any tile size a few numbers."""
    ends = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), *[f(c).alias(f"{n}_{c}") for c in ("ex", "ey", "ez") for n, f in (("min", F.min), ("max", F.max))])
    return ends.withColumns({f"rtc_{c[1]}": (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in ("ex", "ey", "ez")})


def relative(points: DataFrame, centres: DataFrame, keys: list[str]) -> DataFrame:
    """dx, dy, dz as 32-bit floats from the centre of the tile. centres has a row for each tile: AQE broadcasts it if it is small."""
    df = points.join(centres.select(*keys, "rtc_x", "rtc_y", "rtc_z"), keys)
    return df.withColumns({f"d{c}": (F.col(f"e{c}") - F.col(f"rtc_{c}")).cast("float") for c in "xyz"})


def centred(points: DataFrame, keys: list[str]) -> DataFrame:
    """points with dx, dy, dz as 32-bit floats from the middle of their tile's box: one exchange, positions computed once.

    A tile's points, bounded by the node size of the file format, are buffered by the window, which spills.
    """
    w = Window.partitionBy(*keys)
    middle = lambda c: (F.min(c).over(w) + F.max(c).over(w)) / 2
    return points.withColumns({f"d{c}": (F.col(f"e{c}") - middle(f"e{c}")).cast("float") for c in "xyz"})


def colour8(c: Column) -> Column:
    """16-bit colour to 8 bits, always by a shift."""
    return F.shiftrightunsigned(c.cast("int"), 8)


def batch_id_type(n: Column) -> Column:
    return F.when(n <= 256, "UNSIGNED_BYTE").when(n <= 65536, "UNSIGNED_SHORT").otherwise("UNSIGNED_INT")


def padding8(n: Column) -> Column:
    return F.pmod(8 - F.pmod(n, F.lit(8)), F.lit(8))
