"""Names of the registered queries, their plans, and the DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import crs, ranges
from ..operators import admission, coalesce, documents, geometry, octree, points
from . import derived as D

K = D.KEYS
ROOT = (1, 0, 1, 0)
LCC = crs.transform(D.DEFINITION)
ROOT_ERROR = 88.7096992341827


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Tile table with ancestors filled in, regions, errors and, for tiles with points, centre and count."""
    tiles = octree.tiles(D.nodes(spark, d), None, K)
    shaped = geometry.regions(tiles, D.CUBE, LCC).withColumn("geometric_error", geometry.error_at(F.lit(ROOT_ERROR), F.col("depth")))
    return shaped.join(tile_boxes(spark, d).withColumnsRenamed({"kx": "x", "ky": "y", "kz": "z"}), [*K, "depth", "x", "y", "z"], "left")


PK = ["url", "depth", "kx", "ky", "kz"]


def ecef_points(spark, d):
    return points.with_ecef(D.points(spark, d), LCC)


def tile_boxes(spark, d):
    return points.boxes(ecef_points(spark, d), PK)


def key_text_parent(spark, d):
    t = octree.tiles(D.nodes(spark, d), None, K).where("not synthesized")
    return t.select("url", "key", "parent_key", octree.parse_key(F.col("key"))["depth"].alias("parsed_depth"))


def subtree_filter(spark, d):
    return D.nodes(spark, d).where(octree.beneath(ROOT))


def node_build(spark, d):
    w = Window.partitionBy("url").orderBy("depth", "x", "y", "z").rowsBetween(Window.unboundedPreceding, 0)
    n = D.nodes(spark, d).withColumn("length", F.col("point_count") * 36)
    return n.withColumn("offset", F.sum("length").over(w) - F.col("length"))


def ancestor_closure(spark, d):
    return octree.ancestor_closure(D.nodes(spark, d), K)


def synthesized_ancestors(spark, d):
    return octree.synthesized(D.nodes(spark, d), K)


def synthesized_count(spark, d):
    return octree.tiles(D.nodes(spark, d), None, K).groupBy("url").agg(F.count_if("synthesized").alias("n_synthesized"), F.count(F.lit(1)).alias("n_tiles"), F.count("uri").alias("n_content"))


def pages_of(spark, d):
    """Every fourth deepest cell that was left out points to a sub-page."""
    return D.points(spark, d).where(f"not ({D.KEPT}) and depth = 4").select("url", "depth", F.col("kx").alias("x"), F.col("ky").alias("y"), F.col("kz").alias("z")).distinct()


def tile_table(spark, d):
    t = octree.tiles(D.nodes(spark, d), pages_of(spark, d), K)
    return t.select("url", "key", "parent_key", "point_count", "kind", "synthesized", "uri")


def tile_children(spark, d):
    t = octree.tiles(D.nodes(spark, d), None, K).where("parent_key is not null")
    return t.groupBy("url", "parent_key").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "z", "key"))), lambda s: s["key"]), ",").alias("children"))


def duplicate_keys(spark, d):
    p = D.points(spark, d).select("url", "depth", F.col("kx").alias("x"), F.col("ky").alias("y"), F.col("kz").alias("z"))
    return octree.tile_errors(p, K).groupBy("url", "error_code").agg(F.count(F.lit(1)).alias("n"))


def hierarchy_validation(spark, d):
    li = D.read(spark, d, "lineitem")
    count, length = (F.col("l_partkey") % 7 - 1).alias("c"), (F.col("l_suppkey") % 3 - 0)
    return li.select("l_orderkey", "l_linenumber", octree.hierarchy_error(count, length * F.col("l_linenumber") - (F.col("l_orderkey") % 11 == 0).cast("int") * 9, F.lit(4)).alias("error_code"))


def geometric_error(spark, d):
    return D.nodes(spark, d).select("url", octree.key_text().alias("key"), F.round(geometry.error_at(F.lit(ROOT_ERROR), F.col("depth")), 9).alias("geometric_error"))


def lcc_to_wgs84(spark, d):
    p = LCC.with_wgs84(D.points(spark, d), "x", "y", "z")
    return p.select("l_orderkey", "l_linenumber", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), F.round("height", 6).alias("height"))


def ecef_rounded(spark, d):
    return ecef_points(spark, d).select("l_orderkey", "l_linenumber", *[F.round(c, 3).alias(c) for c in ("ex", "ey", "ez")])


def bbox_rtc(spark, d):
    return tile_boxes(spark, d).select(*PK, "n_points", *[F.round(f"rtc_{c}", 3).alias(f"rtc_{c}") for c in "xyz"])


def relative_positions(spark, d):
    r = points.centred(ecef_points(spark, d), PK)
    return r.select("l_orderkey", "l_linenumber", *[(F.round(F.col(f"d{c}").cast("double"), 2) + 0.0).alias(f"d{c}") for c in "xyz"])


def region_for_key(spark, d):
    r = geometry.regions(D.nodes(spark, d).select("url", *octree.KEY), D.CUBE, LCC)
    return r.select("url", octree.key_text().alias("key"), *[F.round(F.degrees(f"region.{c}"), 8).alias(c) for c in ("west", "south", "east", "north")], *[F.round(f"region.{c}", 6).alias(c) for c in ("min_height", "max_height")])


def header_rows(spark, d):
    s = D.read(spark, d, "supplier")
    low = {f"lo_{c}": F.lit(D.HEADER_MIN[i]) + F.col("s_suppkey") % 50 for i, c in enumerate(D.AXES)}
    high = {f"hi_{c}": F.lit(D.HEADER_MAX[i]) - F.col("s_suppkey") % 30 for i, c in enumerate(D.AXES)}
    return s.select("s_suppkey", *[c.alias(k) for k, c in (low | high).items()])


LOW, HIGH = tuple(f"lo_{c}" for c in D.AXES), tuple(f"hi_{c}" for c in D.AXES)


def root_span(spark, d):
    return geometry.root_geometric_error(header_rows(spark, d), LCC, LOW, HIGH).select("s_suppkey", F.round("geometric_error", 4).alias("geometric_error"))


def extent(spark, d):
    return geometry.extent(header_rows(spark, d), LCC, LOW[:2], HIGH[:2]).select("s_suppkey", *[F.round(F.degrees(c), 8).alias(c) for c in ("west", "south", "east", "north")])


def rgb8_batch_id(spark, d):
    w = Window.partitionBy(*PK).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "intensity")
    p = D.points(spark, d)
    return p.select("l_orderkey", "l_linenumber", *PK, *[points.colour8(F.col(c)).alias(f"{c}8") for c in ("red", "green", "blue")], (F.row_number().over(w) - 1).alias("batch_id"))


def pnts_layout(spark, d):
    n = F.col("point_count")
    width = F.when(n <= 256, 1).when(n <= 65536, 2).otherwise(4)
    body = n * 12 + n * width + n * 3
    return D.nodes(spark, d).select("url", octree.key_text().alias("key"), points.batch_id_type(n).alias("id_type"), (body + points.padding8(body + 28)).alias("body"), (n * 13).alias("batch"))


def coalesce_plan(spark, d):
    return coalesce.plan(D.requests(spark, d), "file")


def coalesce_stats(spark, d):
    return coalesce.stats(coalesce_plan(spark, d), "file")


def coalesce_refused(spark, d):
    r = D.requests(spark, d).withColumn("length", F.col("length") + F.when(F.col("idx") % 17 == 0, 400000).otherwise(0))
    return coalesce.refused(r, "file").groupBy("file", "error_code").agg(F.count(F.lit(1)).alias("n"))


def range_headers(spark, d):
    r = D.requests(spark, d)
    return r.select("file", "idx", ranges.range_header(F.col("offset"), F.col("length")).alias("header"), ranges.deadline_ms(F.col("length") * 100).alias("deadline_ms"))


def attempts(spark, d):
    """Answers of a server to ranges: some whole, short, moved, unreadable or failed."""
    r = D.requests(spark, d).withColumn("k", (F.col("file") + F.col("idx")) % 8)
    shift = F.when(F.col("k") == 3, 5).otherwise(0)
    text = F.concat(F.lit("bytes "), (F.col("offset") + shift).cast("string"), F.lit("-"), (F.col("offset") + F.col("length") - 1).cast("string"), F.lit("/"), F.when(F.col("k") == 4, "*").when(F.col("k") == 5, "10").otherwise("99999999999"))
    status = F.element_at(F.array(*[F.lit(x) for x in (206, 206, 200, 206, 206, 206, 503, 404)]), (F.col("k") + 1).cast("int"))
    return r.withColumns({"status": status, "content_range": F.when(F.col("k") == 1, None).otherwise(text), "body": F.col("length") - F.when(F.col("idx") % 40 == 0, 1).otherwise(0)})


def content_range_parse(spark, d):
    return attempts(spark, d).withColumn("c", ranges.content_range(F.col("content_range"))).select("file", "idx", F.col("c.start").alias("start"), F.col("c.last").alias("last"), F.col("c.total").alias("total"))


def attempt_errors(spark, d):
    a = attempts(spark, d)
    a = a.withColumn("error_code", ranges.attempt_error(F.col("status"), F.col("content_range"), F.col("offset"), F.col("length"), F.col("body")))
    return a.groupBy("error_code", ranges.worth_retrying(F.col("error_code"), F.col("status")).alias("retry")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


def registry_lookup(spark, d):
    """Requests for tiles: known ones find their key, unknown ones of our scheme are errors, others pass."""
    tiles = octree.tiles(D.nodes(spark, d), None, K, F.concat(F.lit("copc://t/"), F.col("url"), F.lit("/"))).where("uri is not null").select("uri", "key")
    o = D.read(spark, d, "orders")
    scheme = F.when(F.col("o_orderkey") % 5 == 0, "https://t/file").otherwise("copc://t/file")
    uri = F.concat(scheme, (F.col("o_custkey") % 4).cast("string"), F.lit("/n/"), F.concat_ws("-", F.lit(2), *[F.pmod(F.col("o_orderkey") / F.lit(1), F.lit(4)).cast("long"), F.pmod(F.col("o_custkey"), F.lit(4)), F.pmod(F.col("o_orderkey") + F.col("o_custkey"), F.lit(4))]))
    asked = o.select("o_orderkey", uri.alias("uri")).join(tiles, "uri", "left")
    verdict = F.when(F.col("key").isNotNull(), "found").when(F.col("uri").startswith("copc:"), "unknown-tile-request").otherwise("pass")
    return asked.select("o_orderkey", "uri", "key", verdict.alias("verdict"))


def crs_lookup(spark, d):
    registry = crs.Registry()
    registry.register(2992, D.DEFINITION)
    n = D.read(spark, d, "nation").withColumn("code", F.when(F.col("n_nationkey") % 3 == 0, 2992).when(F.col("n_nationkey") % 3 == 1, 4326).otherwise(9999))
    found = n.join(F.broadcast(registry.table(spark)), "code", "left")
    return found.select("n_nationkey", "code", "definition", F.when(F.col("definition").isNull(), "crs-not-registered").alias("error_code"))


#: Shapes of a file's WKT: a projected system, one without a code of its own, a geographic one, and one whose name holds brackets.
WKT_SHAPES = [
    ('PROJCS["{n}",GEOGCS["base of {n}",AUTHORITY["EPSG","4258"]],UNIT["metre",1],AUTHORITY["EPSG","{c}"]]', True),
    ('PROJCS["{n}",GEOGCS["base of {n}",AUTHORITY["EPSG","4258"]],AUTHORITY["LOCAL","{c}"]]', False),
    ('GEOGCS["{n}",DATUM["datum",AUTHORITY["EPSG","6258"]],AUTHORITY["EPSG","{c}"]]', True),
    ('COMPD_CS["{n}",PROJCS["[{n}",AUTHORITY["EPSG","{c}"]],VERT_CS["height",AUTHORITY["EPSG","5621"]]]', True),
]


def wkt_epsg(spark, d):
    """The code of each customer's WKT, built from the table's own text."""
    c = D.read(spark, d, "customer")
    code = (F.col("c_custkey") % 30000 + 2000).cast("string")
    shapes = [F.replace(F.replace(F.lit(w), F.lit("{n}"), F.col("c_name")), F.lit("{c}"), code) for w, _ in WKT_SHAPES]
    made = c.select("c_custkey", F.element_at(F.array(*shapes), (F.col("c_custkey") % 4 + 1).cast("int")).alias("wkt"))
    return made.select("c_custkey", "wkt", crs.epsg_codes("wkt").alias("code"))


UTM = crs.transform("+proj=utm +zone=10 +ellps=GRS80 +units=m +no_defs")


def utm_points(spark, d):
    """The points' grid laid out in a zone of the transverse Mercator projection."""
    return D.points(spark, d).select("l_orderkey", "l_linenumber", (300000 + F.col("ux") * 100.0).alias("x"), (4600000 + F.col("uy") * 100.0).alias("y"), "z")


def utm_to_wgs84(spark, d):
    p = UTM.with_wgs84(utm_points(spark, d), "x", "y", "z")
    return p.select("l_orderkey", "l_linenumber", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


def utm_sql() -> str:
    """Zone 10 on GRS80, by the series."""
    radius, _, back = crs.kruger(crs.GRS80_F)
    e = (crs.GRS80_F * (2 - crs.GRS80_F)) ** 0.5
    xi, eta = (f"{f} - " + " - ".join(f"{D.num(b)} * {g}({2 * j} * xi) * {h}({2 * j} * eta)" for j, b in enumerate(back, 1)) for f, g, h in (("xi", "sin", "cosh"), ("eta", "cos", "sinh")))
    out = [f"u0 as (select *, (4600000 + uy * 100e0) / {D.num(0.9996 * radius)} as xi, (300000 + ux * 100e0 - 500000) / {D.num(0.9996 * radius)} as eta from points)"]
    out.append(f"u1 as (select *, {xi} as xi1, {eta} as eta1 from u0)")
    out.append("u2 as (select *, degrees(atan2(sinh(eta1), cos(xi1))) - 123e0 as lon, tan(pi() / 4 - asin(sin(xi1) / cosh(eta1)) / 2) as t0 from u1)")
    out.append("v0 as (select *, pi() / 2 - 2 * atan(t0) as p0 from u2)")
    for k in range(8):
        s = f"({D.num(e)} * sin(p{k}))"
        out.append(f"v{k + 1} as (select *, pi() / 2 - 2 * atan(t0 * pow((1 - {s}) / (1 + {s}), {D.num(e / 2)})) as p{k + 1} from v{k})")
    return ", ".join(out) + f" select l_orderkey, l_linenumber, round(lon, 8) as lon, round(degrees(p8), 8) as lat from v8"


def ledger_events(spark, d):
    e = D.read(spark, d, "events").select("event_id", "user_id", "value")
    own = e.select(F.concat(F.lit("p"), (F.col("user_id") % 16).cast("string")).alias("provider"), (F.col("event_id") * 2).alias("seq"), F.lit("acquire").alias("op"), F.col("event_id").alias("lease"), F.concat(F.lit("origin"), (F.col("user_id") % 4).cast("string")).alias("origin"), (F.abs(F.coalesce("value", F.lit(0.0))) * 1000).cast("long").alias("bytes"))
    return own.unionByName(own.where("lease % 3 > 0").withColumns({"op": F.lit("release"), "seq": F.col("seq") + 401}))


def admission_ledger(spark, d):
    """Eight processes of two providers each, which share the slots of their origin."""
    events = ledger_events(spark, d).withColumn("process", F.substring("provider", 2, 2).cast("int") % 8)
    return admission.ledger(events, range_bytes=400_000, process="process")


def admission_totals(spark, d):
    return admission.totals(admission_ledger(spark, d))


def tileset_json(spark, d):
    t = octree.tiles(D.nodes(spark, d), None, K)
    t = geometry.regions(t, D.CUBE, LCC).withColumn("geometric_error", geometry.error_at(F.lit(ROOT_ERROR), F.col("depth")))
    flat = t.select("url", "key", "parent_key", *octree.KEY, "uri", "geometric_error", F.array(*[f"region.{c}" for c in ("west", "south", "east", "north", "min_height", "max_height")]).alias("region"))
    return documents.tileset_documents(flat, ["url"])


def document_registry(spark, d):
    return documents.registry_differences(tileset_json(spark, d), octree.tiles(D.nodes(spark, d), None, K), K)


def point_totals(spark, d):
    """Headers as large as their files' points; that of file0 states one too few."""
    header = F.count(F.lit(1)) - F.when(F.col("url") == "file0", F.count_if(~F.expr(D.KEPT)) + 1).otherwise(0)
    return octree.point_totals(D.nodes(spark, d), D.points(spark, d).groupBy("url").agg(header.alias("point_count")), K)


def page_contents(spark, d):
    """The pages hold their cells' points; those of cells in an odd column have no entry."""
    held = D.points(spark, d).where(f"not ({D.KEPT}) and kx % 2 = 0").groupBy("url", "depth", *[F.col(f"k{c}").alias(c) for c in "xyz"]).agg(F.count(F.lit(1)).alias("point_count"))
    return octree.page_contents(pages_of(spark, d), held, K)


def pnts_payload(spark, d):
    p = ecef_points(spark, d).withColumns({"ordinal": F.col("l_orderkey") * 8 + F.col("l_linenumber"), "gps_time": F.col("l_orderkey").cast("double"), "number_of_returns": F.lit(5)})
    return documents.point_tiles(p, PK).select(*PK, "point_count", F.length("payload").alias("n_bytes"), F.sha2("payload", 256).alias("sha256"))


def pruned_nodes(spark, d):
    c = D.CUBE
    box = [c[0], c[1], c[2], (c[0] + c[3]) / 2 - 1, (c[1] + c[4]) / 2 - 1, (c[2] + c[5]) / 2 - 1]
    return octree.prune(D.nodes(spark, d), c, box, 3)


def lod_rollup(spark, d):
    return D.points(spark, d).rollup("url", "depth").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity"))


def class_cube(spark, d):
    return D.points(spark, d).cube("classification", "return_number").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("n_files"))


def topk_nodes(spark, d):
    return D.nodes(spark, d).orderBy(F.desc("point_count"), "url", *octree.KEY).limit(20)


def node_setops(spark, d):
    n = D.nodes(spark, d).select(*octree.KEY, "url")
    a, b = (n.where(F.col("url") == u).select(*octree.KEY) for u in ("file0", "file1"))
    return a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.exceptAll(b).withColumn("part", F.lit("first")))


QUERIES = [
    key_text_parent, subtree_filter, node_build, ancestor_closure, synthesized_ancestors, synthesized_count, tile_table, tile_children, duplicate_keys, hierarchy_validation, geometric_error,
    lcc_to_wgs84, utm_to_wgs84, ecef_rounded, bbox_rtc, relative_positions, region_for_key, root_span, extent, rgb8_batch_id, pnts_layout, coalesce_plan, coalesce_stats, coalesce_refused, range_headers,
    content_range_parse, attempt_errors, registry_lookup, crs_lookup, wkt_epsg, admission_ledger, admission_totals, tileset_json, document_registry, point_totals, page_contents, pnts_payload, pruned_nodes, lod_rollup, class_cube, topk_nodes, node_setops, flagship,
]


def queries():
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    nodes, pts = f"with recursive {D.NODES_SQL}", f"with recursive {D.POINTS_SQL}"
    key = lambda p="": f"concat_ws('-', {p}depth, {p}x, {p}y, {p}z)"
    parent = "case when depth > 0 then concat_ws('-', depth - 1, x >> 1, y >> 1, z >> 1) end"
    up = ", up as (select url, depth, x, y, z from nodes union select url, depth - 1, x >> 1, y >> 1, z >> 1 from up where depth > 0)"
    closure = up + ", closure as (select distinct url, depth - 1 as depth, x >> 1 as x, y >> 1 as y, z >> 1 as z from up where depth > 0)"
    made = closure + ", made as (select * from closure c where not exists (select 1 from nodes n where (n.url, n.depth, n.x, n.y, n.z) = (c.url, c.depth, c.x, c.y, c.z)))"
    every = made + f", every_ as (select url, depth, x, y, z, point_count, false as synthesized, 'copc://tiles/n/' || {key()} as uri from nodes union all select url, depth, x, y, z, null, true, null from made)"
    pages = f", pages as (select distinct url, depth, kx as x, ky as y, kz as z from points where not ({D.KEPT}) and depth = 4)"
    rows = pages + ", rows_ as (select url, depth, x, y, z, point_count, 'points' as kind from nodes union all select url, depth, x, y, z, null, 'hierarchy' from pages)"
    rows += closure.replace("from nodes union", "from rows_ union")
    rows += ", all_ as (select *, false as synthesized from rows_ union all select url, depth, x, y, z, null, null, true from closure c where not exists (select 1 from rows_ n where (n.url, n.depth, n.x, n.y, n.z) = (c.url, c.depth, c.x, c.y, c.z)))"
    e = D.ecef_sql("lon", "lat", f"(z * {D.num(crs.FOOT)})")
    geo = f"{pts}, {D.lcc_sql('points')}, geo as (select *, {e[0]} as ex, {e[1]} as ey, {e[2]} as ez from lonlat)"
    boxes = geo + f", boxes as (select {', '.join(PK)}, count(*) as n_points, " + ", ".join(f"(min(e{c}) + max(e{c})) / 2 as rtc_{c}" for c in "xyz") + " from geo group by all)"
    side = [f"({D.num(D.CUBE[i + 3] - D.CUBE[i])} / pow(2.0, depth))" for i in range(3)]
    lo = [f"({D.num(D.CUBE[i])} + {side[i]} * {c})" for i, c in enumerate("xyz")]
    hi = [f"({lo[i]} + {side[i]})" for i in range(3)]
    cells = f", cells as (select url, {key()} as key, " + ", ".join(f"{lo[i]} as {c}0, {hi[i]} as {c}1" for i, c in enumerate("xyz")) + " from nodes)"
    ends = ["(0, x0, y0, x1, y0)", "(1, x1, y0, x1, y1)", "(2, x1, y1, x0, y1)", "(3, x0, y1, x0, y0)"]
    samples = cells + ", samples as (select url, key, z0, z1, edge, s, x_a + (x_b - x_a) * (s / 4e0) as x, y_a + (y_b - y_a) * (s / 4e0) as y from (" + " union all ".join(f"select *, {', '.join(f'{v} as {n}' for v, n in zip(t.strip('()').split(', '), ('edge', 'x_a', 'y_a', 'x_b', 'y_b'), strict=True))} from cells" for t in ends) + ") c, (values (0), (1), (2), (3), (4)) v(s))"
    padded = f"{nodes}{samples}, {D.lcc_sql('samples')}, strays as (select *, " + ", ".join(f"abs({c} - (first_value({c}) over w + (last_value({c}) over w - first_value({c}) over w) * (s / 4e0))) as stray_{c}" for c in ("lon", "lat")) + " from lonlat window w as (partition by url, key, edge order by s rows between unbounded preceding and unbounded following))"
    head = "heads as (select s_suppkey, " + ", ".join(f"{D.num(D.HEADER_MIN[i])} + s_suppkey % 50 as lo_{c}, {D.num(D.HEADER_MAX[i])} - s_suppkey % 30 as hi_{c}" for i, c in enumerate("xyz")) + " from supplier)"
    corner = lambda names: " union all ".join("select s_suppkey, " + f"{k} as k, " + ", ".join(f"{v}_{c} as {c}" for v, c in zip(t, "xyz", strict=True)) + " from heads" for k, t in enumerate(names))
    chords = f"with {head}, corners as ({corner([('lo', 'lo', 'lo'), ('hi', 'lo', 'lo'), ('lo', 'hi', 'lo'), ('lo', 'lo', 'hi')])}), {D.lcc_sql('corners')}, geo as (select s_suppkey, k, {e[0]} as ex, {e[1]} as ey, {e[2]} as ez from lonlat)"
    fold = f"""with recursive {D.REQUESTS_SQL}, fold as (
      select file, idx, "offset", length, "offset" as start, "offset" + length as last, length as wanted from requests where idx = 1
      union all select r.file, r.idx, r."offset", r.length,
        case when r."offset" - f.last <= 262144 and (r."offset" + r.length - f.start) - (f.wanted + r.length) <= (r."offset" + r.length - f.start) * 0.02 then f.start else r."offset" end,
        r."offset" + r.length,
        case when r."offset" - f.last <= 262144 and (r."offset" + r.length - f.start) - (f.wanted + r.length) <= (r."offset" + r.length - f.start) * 0.02 then f.wanted + r.length else r.length end
      from fold f join requests r on r.file = f.file and r.idx = f.idx + 1),
      planned as (select file, idx, start as span_offset, cast(max(last) over (partition by file, start) - start as bigint) as span_length, cast(sum(length) over (partition by file, start) as bigint) as wanted, "offset" - start as slice_offset, length as slice_length from fold)"""
    answers = f"""with {D.REQUESTS_SQL}, k as (select *, (file + idx) % 8 as k from requests), answers as (select file, idx, "offset", length,
      [206, 206, 200, 206, 206, 206, 503, 404][k + 1] as status, length - case when idx % 40 = 0 then 1 else 0 end as body, "offset" + case when k = 3 then 5 else 0 end as a, "offset" + length - 1 as b, k,
      case k when 4 then null when 5 then 10 else 99999999999 end as t from k), parsed as (select *, k <> 1 and b >= a and coalesce(b < t, true) as ok from answers)"""
    group = lambda c: f"cast({c} as bigint)"
    return {
        "key_text_parent": f"{nodes} select url, {key()} as key, {parent} as parent_key, depth as parsed_depth from nodes",
        "subtree_filter": f"{nodes} select * from nodes where depth >= 1 and x >> (depth - 1) = 0 and y >> (depth - 1) = 1 and z >> (depth - 1) = 0",
        "node_build": f"{nodes} select url, depth, x, y, z, point_count, point_count * 36 as length, cast(sum(point_count * 36) over (partition by url order by depth, x, y, z) - point_count * 36 as bigint) as \"offset\" from nodes",
        "ancestor_closure": f"{nodes}{closure} select * from closure",
        "synthesized_ancestors": f"{nodes}{made} select * from made",
        "synthesized_count": f"{nodes}{every} select url, count(*) filter (where synthesized) as n_synthesized, count(*) as n_tiles, count(uri) as n_content from every_ group by url",
        "tile_table": f"{nodes}{rows} select url, {key()} as key, {parent} as parent_key, point_count, kind, synthesized, 'copc://tiles/' || case kind when 'points' then 'n/' when 'hierarchy' then 'h/' end || {key()} as uri from all_",
        "tile_children": f"{nodes}{every} select url, {parent} as parent_key, count(*) as n, string_agg({key()}, ',' order by x, y, z) as children from every_ where depth > 0 group by 1, 2",
        "document_registry": f"{nodes}{every} select url, count(uri) as n_document, count(uri) as n_registry, 0 as n_unmatched from every_ group by 1",
        "point_totals": f"{pts}, t as (select url, count(*) - case when url = 'file0' then count(*) filter (not ({D.KEPT})) + 1 else 0 end as point_count, count(*) filter ({D.KEPT}) as held_points from points group by url) select *, case when held_points > point_count then 'malformed-hierarchy' end as error_code from t",
        "page_contents": f"{pts}, c as (select url, depth, kx as x, ky as y, kz as z, count(*) as n from points where not ({D.KEPT}) and depth = 4 group by all) select url, depth, x, y, z, case when x % 2 = 0 then n end as point_count, case when x % 2 <> 0 then 'malformed-hierarchy' end as error_code from c",
        "duplicate_keys": f"{pts}, c as (select url, depth, kx, ky, kz, count(*) over (partition by url, depth, kx, ky, kz) as n from points) select url, case when n > 1 then 'malformed-hierarchy' end as error_code, count(*) as n from c group by all",
        "hierarchy_validation": "with e as (select l_orderkey, l_linenumber, l_partkey % 7 - 1 as c, (l_suppkey % 3) * l_linenumber - case when l_orderkey % 11 = 0 then 9 else 0 end as n from lineitem) select l_orderkey, l_linenumber, case when n < 0 or c < -1 or (c = -1 and n = 0) or (c > 0 and n = 0) or (c = 0 and n > 0) or c > 4 then 'malformed-hierarchy' end as error_code from e",
        "geometric_error": f"{nodes} select url, {key()} as key, round({D.num(ROOT_ERROR)} / pow(2.0, depth), 9) as geometric_error from nodes",
        "lcc_to_wgs84": f"{pts}, {D.lcc_sql('points')} select l_orderkey, l_linenumber, round(lon, 8) as lon, round(lat, 8) as lat, round(z * {D.num(crs.FOOT)}, 6) as height from lonlat",
        "ecef_rounded": f"{geo} select l_orderkey, l_linenumber, round(ex, 3) as ex, round(ey, 3) as ey, round(ez, 3) as ez from geo",
        "bbox_rtc": f"{boxes} select {', '.join(PK)}, n_points, round(rtc_x, 3) as rtc_x, round(rtc_y, 3) as rtc_y, round(rtc_z, 3) as rtc_z from boxes",
        "relative_positions": f"{boxes} select l_orderkey, l_linenumber, " + ", ".join(f"round(cast(cast(e{c} - rtc_{c} as float) as double), 2) + 0e0 as d{c}" for c in "xyz") + f" from geo join boxes using ({', '.join(PK)})",
        "region_for_key": f"{padded} select url, key, round(min(lon) - max(stray_lon), 8) as west, round(min(lat) - max(stray_lat), 8) as south, round(max(lon) + max(stray_lon), 8) as east, round(max(lat) + max(stray_lat), 8) as north, round(min(z0) * {D.num(crs.FOOT)}, 6) as min_height, round(min(z1) * {D.num(crs.FOOT)}, 6) as max_height from strays group by url, key",
        "root_span": f"{chords} select s_suppkey, round(max(sqrt((g.ex - o.ex) * (g.ex - o.ex) + (g.ey - o.ey) * (g.ey - o.ey) + (g.ez - o.ez) * (g.ez - o.ez))) / 16, 4) as geometric_error from geo g join (select s_suppkey, ex, ey, ez from geo where k = 0) o using (s_suppkey) group by s_suppkey",
        "extent": f"with {head}, corners as ({corner([('lo', 'lo', 'lo'), ('hi', 'lo', 'lo'), ('hi', 'hi', 'lo'), ('lo', 'hi', 'lo')])}), {D.lcc_sql('corners')} select s_suppkey, round(min(lon), 8) as west, round(min(lat), 8) as south, round(max(lon), 8) as east, round(max(lat), 8) as north from lonlat group by s_suppkey",
        "rgb8_batch_id": f"{pts} select l_orderkey, l_linenumber, {', '.join(PK)}, red >> 8 as red8, green >> 8 as green8, blue >> 8 as blue8, cast(row_number() over (partition by {', '.join(PK)} order by l_orderkey, l_linenumber, l_partkey, l_suppkey, intensity) - 1 as int) as batch_id from points",
        "pnts_layout": f"{nodes}, b as (select *, point_count * 15 + point_count * case when point_count <= 256 then 1 when point_count <= 65536 then 2 else 4 end as body from nodes) select url, {key()} as key, case when point_count <= 256 then 'UNSIGNED_BYTE' when point_count <= 65536 then 'UNSIGNED_SHORT' else 'UNSIGNED_INT' end as id_type, body + (8 - (body + 28) % 8) % 8 as body, point_count * 13 as batch from b",
        "coalesce_plan": f"{fold} select * from planned",
        "coalesce_stats": f"{fold}, g as (select file, span_offset, any_value(span_length) as span, any_value(wanted) as wanted, count(*) as n from planned group by all) select file, {group('sum(n)')} as n_ranges, count(*) as n_reads, {group('sum(wanted)')} as bytes_wanted, {group('sum(span)')} as bytes_read, {group('sum(span - wanted)')} as bytes_wasted, {group('sum(n - 1)')} as requests_saved from g group by file",
        "coalesce_refused": f"with {D.REQUESTS_SQL}, r as (select file, idx, \"offset\", length + case when idx % 17 = 0 then 400000 else 0 end as length from requests), l as (select *, max(\"offset\" + length) over (partition by file order by \"offset\", idx rows between unbounded preceding and 1 preceding) as last from r) select file, case when \"offset\" < last then 'invalid-byte-range' end as error_code, count(*) as n from l group by all",
        "range_headers": f"with {D.REQUESTS_SQL} select file, idx, 'bytes=' || \"offset\" || '-' || (\"offset\" + length - 1) as header, cast(8000 + ceil(length * 100 / 1048576.0) * 2000 as bigint) as deadline_ms from requests",
        "content_range_parse": f"{answers} select file, idx, case when ok then a end as start, case when ok then b end as last, case when ok then t end as total from parsed",
        "attempt_errors": f"{answers}, c as (select *, case when status = 200 then 'range-unsupported' when status >= 400 then 'range-request-failed' when k = 1 then 'content-range-unreadable' when not ok or a <> \"offset\" or body <> length then 'content-range-mismatch' end as error_code from parsed) select error_code, coalesce(error_code = 'range-request-failed' and status >= 500, false) as retry, count(*) as n, {group('sum(length)')} as bytes from c group by all",
        "registry_lookup": f"{nodes}, asked as (select o_orderkey, case when o_orderkey % 5 = 0 then 'https://t/file' else 'copc://t/file' end || (o_custkey % 4) || '/n/' || concat_ws('-', 2, o_orderkey % 4, o_custkey % 4, (o_orderkey + o_custkey) % 4) as uri from orders) select o_orderkey, a.uri, key, case when key is not null then 'found' when a.uri like 'copc:%' then 'unknown-tile-request' else 'pass' end as verdict from asked a left join (select 'copc://t/' || url || '/n/' || {key()} as uri, {key()} as key from nodes) t on a.uri = t.uri",
        "crs_lookup": f"select n_nationkey, code, definition, case when definition is null then 'crs-not-registered' end as error_code from (select n_nationkey, case n_nationkey % 3 when 0 then 2992 when 1 then 4326 else 9999 end as code from nation) n left join (values (2992, '{D.DEFINITION}'), (4326, '{crs.WGS84_DEFINITION}')) v(c, definition) on c = code",
        "wkt_epsg": "with made as (select c_custkey, case c_custkey % 4 " + " ".join(f"when {i} then replace(replace('{w}', '{{n}}', c_name), '{{c}}', cast(c_custkey % 30000 + 2000 as varchar))" for i, (w, _) in enumerate(WKT_SHAPES)) + " end as wkt from customer) select c_custkey, wkt, case when c_custkey % 4 in (" + ", ".join(str(i) for i, (_, known) in enumerate(WKT_SHAPES) if known) + ") then cast(c_custkey % 30000 + 2000 as int) end as code from made",
        "utm_to_wgs84": f"{pts}, {utm_sql()}",
        "pruned_nodes": f"{nodes} select * from nodes where depth <= 3 and " + " and ".join(f"{lo[i]} <= {(D.CUBE[i] + D.CUBE[i + 3]) / 2 - 1!r}" for i in range(3)),
        "lod_rollup": f"{pts} select url, depth, count(*) as n, {group('sum(intensity)')} as intensity from points group by rollup (url, depth)",
        "class_cube": f"{pts} select classification, return_number, count(*) as n, count(distinct url) as n_files from points group by cube (classification, return_number)",
        "topk_nodes": f"{nodes} select * from nodes order by point_count desc, url, depth, x, y, z limit 20",
        "node_setops": f"{nodes}, a as (select depth, x, y, z from nodes where url = 'file0'), b as (select depth, x, y, z from nodes where url = 'file1') select *, 'both' as part from (select * from a intersect select * from b) union all select *, 'first' as part from (select * from a except all select * from b)",
    }


