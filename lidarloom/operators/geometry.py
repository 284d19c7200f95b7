"""Regions, geometric errors and extents of tiles, as Column expressions without shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crs import Transform, ecef
from .octree import cell_bounds

#: The root's error is its span over 16; each edge of a cell is sampled at 5 places.
ROOT_DIVISOR, SAMPLES = 16, 5


def root_geometric_error(df: DataFrame, transform: Transform, low: tuple[str, str, str], high: tuple[str, str, str], name: str = "geometric_error") -> DataFrame:
    """df with the longest of three chords from the low corner along each axis, over 16."""
    own, points = df.columns, []
    for k, at in enumerate(((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))):
        for i, c in enumerate("xyz"):
            df = df.withColumn(f"__{c}", F.col((low, high)[at[i]][i]))
        df = transform.with_wgs84(df, "__x", "__y", "__z", f"__{k}_")
        points.append(ecef(F.col(f"__{k}_lon"), F.col(f"__{k}_lat"), F.col(f"__{k}_height")))
    chord = [F.sqrt(sum((a - b) * (a - b) for a, b in zip(points[0], p, strict=True))) for p in points[1:]]
    return df.select(*own, (F.greatest(*chord) / ROOT_DIVISOR).alias(name))


def error_at(root: Column, depth: Column) -> Column:
    """Halved with every level, counted from the file's root even in sub-pages."""
    return root / F.pow(F.lit(2.0), depth)


def regions(keys: DataFrame, cube: list[float], transform: Transform) -> DataFrame:
    """keys with region: west, south, east, north (radians), minimum and maximum height (metres). No exchange; equal keys stay apart.

    The four edges of a cell's outline are sampled; the bounds are padded by how far a sample strays from
    the straight line between the ends of its edge. The samples are an array, so that the projection is compiled once.
    """
    own = keys.columns
    df = keys.withColumns({f"__{k}": c for k, c in cell_bounds(cube).items()})
    corner = {k: (F.col(f"__x_{k[0]}"), F.col(f"__y_{k[1]}")) for k in (("lo", "lo"), ("hi", "lo"), ("hi", "hi"), ("lo", "hi"))}
    outline = [corner[k] for k in (("lo", "lo"), ("hi", "lo"), ("hi", "hi"), ("lo", "hi"))]
    samples = []
    for e in range(4):
        (x0, y0), (x1, y1) = outline[e], outline[(e + 1) % 4]
        for s in range(SAMPLES):
            part = F.lit(s / (SAMPLES - 1))
            samples.append(F.struct((x0 + (x1 - x0) * part).alias("x"), (y0 + (y1 - y0) * part).alias("y")))
    df = df.withColumn("__p", F.transform(F.array(*samples), transform.lonlat))
    bounds = {}
    for c, low, high in (("lon", "west", "east"), ("lat", "south", "north")):
        values = [F.col("__p")[i][c] for i in range(4 * SAMPLES)]
        stray = [F.abs(values[SAMPLES * e + s] - (values[SAMPLES * e] + (values[SAMPLES * e + SAMPLES - 1] - values[SAMPLES * e]) * (s / (SAMPLES - 1)))) for e in range(4) for s in range(1, SAMPLES - 1)]
        pad = F.greatest(*stray)
        bounds[low], bounds[high] = F.radians(F.least(*values) - pad), F.radians(F.greatest(*values) + pad)
    bounds |= {"min_height": F.col("__z_lo") * transform.unit, "max_height": F.col("__z_hi") * transform.unit}
    order = ("west", "south", "east", "north", "min_height", "max_height")
    return df.select(*own, F.struct(*[bounds[k].alias(k) for k in order]).alias("region"))


def extent(df: DataFrame, transform: Transform, low: tuple[str, str], high: tuple[str, str]) -> DataFrame:
    """west, south, east, north in radians over the four corners, without padding."""
    corners, own = [], df.columns
    for k, (x, y) in enumerate(((low[0], low[1]), (high[0], low[1]), (high[0], high[1]), (low[0], high[1]))):
        df = transform.with_wgs84(df.withColumn("__0", F.lit(0.0)), x, y, "__0", f"__{k}_")
        corners.append((F.col(f"__{k}_lon"), F.col(f"__{k}_lat")))
    lon, lat = zip(*corners, strict=True)
    return df.select(*own, *[F.radians(c).alias(n) for n, c in (("west", F.least(*lon)), ("south", F.least(*lat)), ("east", F.greatest(*lon)), ("north", F.greatest(*lat)))])

