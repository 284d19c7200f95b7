"""Point clouds derived from the star-schema tables, in Spark and in SQL alike, so that every operator has data to run on."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import A, FOOT, GRS80_F

#: A Lambert conic definition in feet, and a cube in its units.
DEFINITION = "+proj=lcc +lat_0=41.75 +lon_0=-120.5 +lat_1=43 +lat_2=45.5 +x_0=399999.9999984 +y_0=0 +datum=NAD83 +units=ft +no_defs"
CUBE = [635577.79, 848882.15, 406.1400000000003, 640233.3, 853537.66, 5061.65000000001]
HEADER_MIN, HEADER_MAX = [635577.79, 848882.15, 406.14], [639003.73, 853537.66, 615.26]
SIDE = 4096
KEYS = ["url"]

#: A point's place on a grid of 4096 steps, its depth from 1 to 4 and its file.
GRID = """
  l_orderkey, l_linenumber, l_partkey, l_suppkey, concat('file', cast(l_suppkey % 4 as string)) as url, cast(1 + l_linenumber % 4 as int) as depth,
  (l_orderkey * 37 + l_linenumber * 101) & 4095 as ux, (l_partkey * 53) & 4095 as uy, ((l_suppkey * 11 + l_linenumber) & 511) * 8 as uz,
  cast(l_quantity as int) * 256 as red, cast(l_partkey % 256 as int) * 256 as green, cast(l_suppkey % 256 as int) * 256 as blue,
  cast(cast(floor(l_extendedprice) as bigint) % 65536 as int) as intensity, cast(l_linenumber as int) as classification, cast(l_linenumber % 5 + 1 as int) as return_number
"""
AXES = ("x", "y", "z")
STEPS = [(CUBE[i + 3] - CUBE[i]) / SIDE for i in range(3)]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    grid = read(spark, d, "lineitem").selectExpr(*[c.strip() for c in _split(GRID)])
    place = {c: F.lit(CUBE[i]) + F.col(f"u{c}") * F.lit(STEPS[i]) for i, c in enumerate(AXES)}
    return grid.withColumns(place).withColumns({f"k{c}": F.expr(f"shiftright(u{c}, 12 - depth)") for c in AXES})


def _split(text: str) -> list[str]:
    """Select items of a list, cut at commas outside brackets."""
    out, level = [""], 0
    for ch in text:
        level += (ch == "(") - (ch == ")")
        if ch == "," and not level:
            out.append("")
        else:
            out[-1] += ch
    return out


def num(x: float) -> str:
    """A DOUBLE literal."""
    return repr(x) if "e" in repr(x) else f"{x!r}e0"


POINTS_SQL = "points as (select *, " + ", ".join(f"{num(CUBE[i])} + u{c} * {num(STEPS[i])} as {c}, u{c} >> (12 - depth) as k{c}" for i, c in enumerate(AXES)) + f" from (select {GRID.replace('as string', 'as varchar')} from lineitem) g)"
#: One in five cells is left out, to leave gaps among ancestors.
KEPT = "(kx * 7 + ky * 3 + kz) % 5 <> 0"
NODES_SQL = POINTS_SQL + f", nodes as (select url, depth, kx as x, ky as y, kz as z, count(*) as point_count from points where {KEPT} group by all)"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where(KEPT).groupBy("url", "depth", F.col("kx").alias("x"), F.col("ky").alias("y"), F.col("kz").alias("z")).agg(F.count(F.lit(1)).alias("point_count"))


REQUESTS = """
 select l_suppkey as file, idx, cast(sum(len + gap) over (partition by l_suppkey order by idx rows between unbounded preceding and current row) - len as bigint) as "offset", len as length
 from (select l_suppkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as idx,
   cast(l_quantity as bigint) * 1000 as len, case when l_linenumber = 7 then 300000 else cast(l_linenumber as bigint) * l_linenumber * 20 end as gap from {table}) r
"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    n = F.col("l_linenumber").cast("long")
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.row_number().over(w).cast("long").alias("idx"), (F.col("l_quantity").cast("long") * 1000).alias("length"), F.when(n == 7, 300000).otherwise(n * n * 20).alias("gap"))
    run = Window.partitionBy("file").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("file", "idx", (F.sum(F.col("length") + F.col("gap")).over(run) - F.col("length")).alias("offset"), "length")


REQUESTS_SQL = "requests as (" + REQUESTS.format(table="lineitem") + ")"


def lcc_sql(source: str, x: str = "x", y: str = "y", steps: int = 8) -> str:
    """CTEs l0, ... ending in lonlat: source with lon and lat in degrees, by the closed Lambert formulas."""
    e = math.sqrt(GRS80_F * (2 - GRS80_F))
    p = [math.radians(v) for v in (41.75, 43.0, 45.5)]
    m = [math.cos(v) / math.sqrt(1 - (e * math.sin(v)) ** 2) for v in p]
    t = [math.tan(math.pi / 4 - v / 2) / ((1 - e * math.sin(v)) / (1 + e * math.sin(v))) ** (e / 2) for v in p]
    n = math.log(m[1] / m[2]) / math.log(t[1] / t[2])
    scale = A * m[1] / (n * t[1] ** n)
    rho0 = scale * t[0] ** n
    east, north = f"({x} * {num(FOOT)} - 399999.9999984e0)", f"({num(rho0)} - {y} * {num(FOOT)})"
    out = [f"l0 as (select *, degrees(atan2({east}, {north}) / {num(n)}) + -120.5e0 as lon, pow(sqrt({east} * {east} + {north} * {north}) / {num(scale)}, {num(1 / n)}) as t0 from {source})"]
    out.append("l1 as (select *, pi() / 2 - 2 * atan(t0) as p0 from l0)")
    for k in range(steps):
        s = f"({num(e)} * sin(p{k}))"
        out.append(f"l{k + 2} as (select * , pi() / 2 - 2 * atan(t0 * pow((1 - {s}) / (1 + {s}), {num(e / 2)})) as p{k + 1} from l{k + 1})")
    out.append(f"lonlat as (select *, degrees(p{steps}) as lat from l{steps + 1})")
    return ", ".join(out)


def ecef_sql(lon: str, lat: str, h: str) -> tuple[str, str, str]:
    f = 1 / 298.257223563
    e2 = f * (2 - f)
    n = f"({num(A)} / sqrt(1 - {num(e2)} * sin(radians({lat})) * sin(radians({lat}))))"
    return f"(({n} + {h}) * cos(radians({lat})) * cos(radians({lon})))", f"(({n} + {h}) * cos(radians({lat})) * sin(radians({lon})))", f"(({n} * {num(1 - e2)} + {h}) * sin(radians({lat})))"
