"""Behaviour and golden numbers of the point-cloud engine."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from lidarloom import errors
from lidarloom.functions import crs, ranges
from lidarloom.operators import admission, coalesce, documents, geometry, octree, points
from lidarloom.plans import derived as D
from lidarloom.sources import layout
from lidarloom.sources.copc import CopcSource, groups

LCC = crs.transform(D.DEFINITION)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    ("wkt", "code"),
    [
        ('PROJCS["Harbour grid",GEOGCS["Base",AUTHORITY["EPSG","4258"]],UNIT["metre",1],AUTHORITY["EPSG","25832"]]', 25832),
        ('GEOGCS["Sea chart",DATUM["D",AUTHORITY["EPSG","6258"]],AUTHORITY["EPSG","4258"]]', 4258),
        ('PROJCS["Town plan",GEOGCS["Base",AUTHORITY["EPSG","4258"]],AUTHORITY["TOWN","7"]]', None),
        ('COMPD_CS["both",VERT_CS["tide",AUTHORITY["EPSG","5621"]],PROJCS["grid",AUTHORITY["EPSG","25833"]]]', 25833),
        ('COMPD_CS["two",GEOGCS["first",AUTHORITY["EPSG","4258"]],GEOGCS["second",AUTHORITY["EPSG","4230"]]]', 4230),
        ('PROJCS["closing ] first, then [",AUTHORITY["EPSG","25831"]]', 25831),
        ('PROJCS  ["spaced",\n\tGEOGCS ["Base" , AUTHORITY ["EPSG","4258"]],\n\tAUTHORITY [ "EPSG" , "25830" ]]', 25830),
        ("", None), (None, None), ('VERT_CS["tide",AUTHORITY["EPSG","5621"]]', None), ("a chart without any system", None),
    ],
)
def test_wkt_code(wkt, code):
    assert crs.epsg_code(wkt) == code


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("EPSG:25832", "alias"), ("+ellps=GRS80 +units=m", "missing-projection"), ("+proj=lcc +lat_1=50 +nadgrids=town.gsb", "grid-shift"), ("+proj=merc +nadgrids", "grid-shift"),
        ("+proj=lcc +lat_1=50 +ellps=bessel", "unsupported-ellipsoid"), ("+proj=longlat +a=6370000 +b=6370000", "unsupported-ellipsoid"), ("+proj=longlat +datum=potsdam", "unsupported-datum"),
        ("+proj=longlat +ellps=GRS80 +towgs84=1,0,0", "unsupported-datum"), ("+proj=merc +pm=paris", "unsupported-meridian"), ("+proj=merc +axis=neu", "unsupported-axis"), ("+proj=stere +lat_0=90", "unsupported-projection"),
        ("+proj=utm +ellps=GRS80", "unsupported-projection"),
    ],
)
def test_definition_guard(text, reason):
    with pytest.raises(errors.BY_CODE["crs-definition-unusable"]) as e:
        crs.check_definition(text)
    assert e.value.reason == reason


def test_transverse_mercator(spark):
    """Back from points that the outward series gives; on the central meridian the northing is the arc of the meridian."""
    f = crs.GRS80_F
    e = math.sqrt(f * (2 - f))
    radius, out, _ = crs.kruger(f)
    rows = []
    for lon, lat in [(9.0, 0.0), (9.0, 60.0), (10.5, 48.0), (6.1, -33.0), (12.9, 71.0)]:
        la, ph = math.radians(lon - 9), math.radians(lat)
        t = math.sinh(math.atanh(math.sin(ph)) - e * math.atanh(e * math.sin(ph)))
        xi, eta = math.atan2(t, math.cos(la)), math.atanh(math.sin(la) / math.hypot(1, t))
        x = 500000 + 0.9996 * radius * (eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(out, 1)))
        y = 0.9996 * radius * (xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(out, 1)))
        rows.append((lon, lat, x, y, 0.0))
    p = np.linspace(0, math.radians(60), 200001)
    m = crs.A * (1 - e * e) / (1 - (e * np.sin(p)) ** 2) ** 1.5
    assert rows[1][3] == pytest.approx(0.9996 * float(((m[1:] + m[:-1]) / 2 * np.diff(p)).sum()), abs=1e-3)
    df = frame(spark, rows, "lon0 double, lat0 double, x double, y double, z double")
    for definition, shift in (("+proj=utm +zone=32 +ellps=GRS80", 0.0), ("+proj=tmerc +lon_0=9 +k=0.9996 +x_0=500000 +ellps=GRS80", 0.0), ("+proj=utm +zone=32 +south +ellps=GRS80", 1e7)):
        made = crs.transform(definition)
        for r in made.with_wgs84(df.withColumn("y", F.col("y") + shift), "x", "y", "z").withColumn("p", made.lonlat(F.struct("x", "y"))).collect():
            assert (r.lon, r.lat) == pytest.approx((r.lon0, r.lat0), abs=1e-9) and tuple(r.p) == pytest.approx((r.lon, r.lat), abs=1e-12)


def test_units_and_registry():
    assert crs.metres_per_unit(crs.terms("+proj=merc +units=us-ft")) == 1200 / 3937
    assert crs.metres_per_unit(crs.terms("+proj=merc +to_meter=0")) == 1
    assert crs.terms("+PROJ=merc +proj=lcc +south") == {"proj": "lcc", "south": True}
    r = crs.Registry()
    with pytest.raises(errors.BY_CODE["crs-not-registered"]) as e:
        r.resolve('PROJCS["grid",AUTHORITY["EPSG","25832"]]')
    assert e.value.epsg_code == 25832
    with pytest.raises(errors.BY_CODE["crs-code-not-found"]):
        r.resolve(None)


def test_errors_survive_pickling():
    e = pickle.loads(pickle.dumps(errors.error("range-timeout", "late", timeout_ms=8000)))
    assert (e.code, e.timeout_ms, str(e)) == ("range-timeout", 8000, "late")
    assert errors.from_wire({"code": "no-such", "message": "m"}).code == "worker-task-failed"
    assert len(set(errors.CODES)) == 24


def test_golden_region_and_error(spark):
    keys = frame(spark, [(0, 0, 0, 0), (1, 1, 0, 0), (4, 2, 1, 0)], "depth int, x long, y long, z long")
    rows = {(r.depth, r.x): r.region for r in geometry.regions(keys, D.CUBE, LCC).collect()}
    deg = lambda r: [math.degrees(v) for v in (r.west, r.south, r.east, r.north)]
    assert deg(rows[0, 0]) == pytest.approx([-123.075542258471, 44.049718474631, -123.057284529060, 44.062885832507], abs=1e-11)
    assert (rows[0, 0].min_height, rows[0, 0].max_height) == pytest.approx((123.791472, 1542.790920), abs=1e-6)
    assert deg(rows[1, 1]) == pytest.approx([-123.066412447771, 44.049918664210, -123.057284551545, 44.056501829639], abs=1e-11)
    assert deg(rows[4, 2]) == pytest.approx([-123.072843346591, 44.050566829219, -123.071702268119, 44.051389804437], abs=1e-11)
    head = frame(spark, [(*D.HEADER_MIN, *D.HEADER_MAX)], "a double, b double, c double, d double, e double, f double")
    assert geometry.root_geometric_error(head, LCC, ("a", "b", "c"), ("d", "e", "f")).first().geometric_error == pytest.approx(88.7096992341827, abs=1e-9)
    p = frame(spark, [(637932.14, 849326.9, 551.77)], "x double, y double, z double")
    at = points.with_ecef(p, LCC).first()
    centre, rel = (-2505234.608518916, -3847990.649652401, 4412295.864508179), (3.717665195465088, -2.379110097885132, -1.5120006799697876)
    assert (at.ex, at.ey, at.ez) == pytest.approx([c + r for c, r in zip(centre, rel, strict=True)], abs=1e-5)


def test_tree_cases(spark):
    nodes = frame(spark, [("f", 0, 0, 0, 0, 10), ("f", 31, 1 << 30, 0, 0, 5)], "url string, depth int, x long, y long, z long, point_count long")
    assert octree.tiles(nodes, None, ["url"]).where("synthesized").count() == 30
    empty = frame(spark, [("f", 0, 0, 0, 0, 0), ("f", 2, 0, 0, 0, 7)], "url string, depth int, x long, y long, z long, point_count long")
    t = {r.key: r for r in octree.tiles(empty, None, ["url"]).collect()}
    assert t["0-0-0-0"].uri is None and not t["0-0-0-0"].synthesized and t["1-0-0-0"].synthesized and t["2-0-0-0"].uri == "copc://tiles/n/2-0-0-0"
    deep = frame(spark, [("f", 32, 0, 0, 0, 1), ("f", 1, 1, 0, 0, 1), ("f", 1, 1, 0, 0, 2)], "url string, depth int, x long, y long, z long, point_count long")
    assert [r.error_code for r in octree.tile_errors(deep, ["url"]).collect()] == ["malformed-hierarchy"] * 3
    with pytest.raises(Exception, match="malformed-hierarchy"):
        octree.require_clean(octree.tile_errors(deep, ["url"])).collect()
    assert [r.k for r in frame(spark, [("1-2-3-4",), ("1-2-3",), ("1--2-3-4",)], "t string").select(octree.parse_key(F.col("t")).alias("k")).collect()][1:] == [None, None]
    for bad in ("tiles/", "copc://x", "copc://x/../"):
        with pytest.raises(errors.BY_CODE["invalid-token-base"]):
            octree.check_token_base(bad)


@pytest.mark.parametrize(
    ("rows", "spans"),
    [
        ([(100, 980), (1100, 900)], [(100, 1900)]),  # 20 of 1900 bytes wasted
        ([(0, 20_000_000), (20_262_145, 20_000_000)], [(0, 20_000_000), (20_262_145, 20_000_000)]),  # a gap of one byte over 256 KiB
        ([(0, 20_000_000), (20_262_144, 20_000_000)], [(0, 40_262_144)]),  # the gap at its bound
        ([(40, 60), (160, 60)], [(40, 60), (160, 60)]),
        ([(0, 3000), (3093, 3000), (6186, 3000)], [(0, 6093), (6186, 3000)]),  # waste adds up
        ([(70, 30), (40, 30), (0, 40)], [(0, 100)]),
    ],
)
def test_coalesce(spark, rows, spans):
    df = frame(spark, [("f", i, o, n) for i, (o, n) in enumerate(rows)], "file string, idx long, offset long, length long")
    got = sorted({(r.span_offset, r.span_length) for r in coalesce.plan(df, "file").collect()})
    assert got == spans
    assert [(g[0][0], g[-1][0] + g[-1][1] - g[0][0]) for g in groups([(o, n, ()) for o, n in rows])] == spans


def test_coalesce_refuses(spark):
    rows = [("a", 0, 0, 100), ("a", 1, 10, 10), ("a", 2, 30, 10), ("b", 0, 7, 0), ("c", 0, -1, 5), ("d", 0, 3, 4)]
    df = frame(spark, rows, "file string, idx long, offset long, length long")
    bad = {(r.file, r.idx) for r in coalesce.refused(df, "file").where("error_code is not null").collect()}
    assert bad == {("a", 1), ("a", 2), ("b", 0), ("c", 0)}
    assert coalesce.plan(df.where("file = 'd'"), "file").count() == 1 and coalesce.plan(df.where("false"), "file").count() == 0
    for f in "abc":
        with pytest.raises(Exception, match="invalid-byte-range|empty, negative or overlaps"):
            coalesce.plan(df.where(F.col("file") == f), "file").collect()


def test_regions_keep_equal_keys(spark):
    df = frame(spark, [(1, 0, 0, 0), (1, 0, 0, 0)], "depth int, x long, y long, z long")
    made = geometry.regions(df, D.CUBE, LCC)
    assert made.count() == 2 and "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_one_root(spark):
    import pandas as pd

    row = lambda key, parent: (key, parent, 0, 0, 0, 0, None, 1.0, [0.0] * 6)
    names = ["key", "parent_key", "depth", "x", "y", "z", "uri", "geometric_error", "region"]
    assert '"children"' in documents.tree_document(pd.DataFrame([row("a", None), row("b", "a")], columns=names))
    with pytest.raises(errors.BY_CODE["malformed-hierarchy"]):
        documents.tree_document(pd.DataFrame([row("a", None), row("b", None)], columns=names))


def test_shared_slots(spark):
    """Two providers of one process share the six slots of an origin; of two processes each has its own."""
    rows = [(f"p{i % 2}", i, "acquire", i, "o", 1, i % 2) for i in range(14)]
    df = frame(spark, rows, "provider string, seq long, op string, lease long, origin string, bytes long, own int").withColumn("one", F.lit(1))
    admitted = lambda process: admission.ledger(df, process=process).where("verdict = 'admitted'").count()
    assert (admitted("one"), admitted("own"), admitted("provider")) == (6, 12, 12)


def test_point_tiles_across_batches(spark):
    """Tiles that span Arrow batches have the same payload as when each is encoded alone."""
    n = 25_000
    cols = "id % 3 as t, id as ordinal, id * 1.5d as ex, id * 0.25d as ey, id + 1e6d as ez, 256 as red, 512 as green, 65535 as blue, 1.0d as gps_time, 5 as intensity, 2 as classification, 1 as return_number, 1 as number_of_returns"
    rows = documents.point_tiles(spark.range(n).selectExpr(*cols.split(", ")), ["t"]).collect()
    assert sorted(r.point_count for r in rows) == [8333, 8333, 8334]
    for r in rows:
        i = np.arange(r.t, n, 3)
        at = np.stack([i * 1.5, i * 0.25, i + 1e6], axis=1)
        back = documents.decode_pnts(bytes(r.payload))
        assert back["centre"] == r.rtc == ((at.min(0) + at.max(0)) / 2).tolist() and (back["relative"] == (at - np.array(r.rtc)).astype("<f4")).all() and back["rgb"][0].tolist() == [1, 2, 255]


def test_content_range(spark):
    texts = ["bytes 20-29/30", "\t bytes 20-29/* \t", "bytes 20-30/30", "bytes 8-7/30", "octets 0-1/2", None, "bytes 0-1/99999999999999999999", "bytes 0-99999999999999999999/*"]
    got = [r.c for r in frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(ranges.content_range(F.col("t")).alias("c")).collect()]
    assert [g and tuple(g) for g in got] == [(20, 29, 30), (20, 29, None), None, None, None, None, None, None]
    assert [r[0] for r in spark.range(3).orderBy("id").select(ranges.retry_wait_ms(F.col("id"))).collect()] == [500, 2000, None]


def test_budget_verdicts():
    ledger = admission.Ledger(100, 100)
    assert [ledger.acquire(i, "o", n)[0] for i, n in enumerate((100, 1, 101))] == ["admitted", "deferred", "rejected"]
    assert ledger.host("o").tally == {"admitted": 1, "deferred": 0, "rejected": 0}
    hosts = admission.Ledger(100, 2)
    assert [hosts.acquire(i, "o", 10)[0] for i in range(3)] == ["admitted", "admitted", "deferred"]
    assert hosts.bytes.tally["deferred"] == 0
    hosts.release(0)
    with pytest.raises(errors.BY_CODE["lease-already-released"]):
        hosts.release(0)
    hosts.destroy()
    hosts.release(1)
    assert hosts.bytes.in_use == 0 and hosts.acquire(9, "o", 1) == ("rejected", "destroyed")


@pytest.mark.parametrize("n", [1, 47, 255, 256, 257, 65536, 65537])
def test_pnts_round_trip(n):
    g = np.random.default_rng(n)
    rel, rgb = g.normal(size=(n, 3)).astype(np.float32), g.integers(0, 256, (n, 3))
    batch = {"GpsTime": np.full(n, 12345.5), "Intensity": np.full(n, 100), "Classification": np.full(n, 2), "ReturnNumber": np.ones(n), "NumberOfReturns": np.full(n, 2)}
    raw = documents.encode_pnts(rel, [-2505234.608518916, -3847990.649652401, 4412295.864508179], rgb, batch)
    back = documents.decode_pnts(raw)
    assert (back["relative"] == rel).all() and (back["ids"] == np.arange(n)).all() and (back["rgb"] == rgb).all() and back["batch"]["GpsTime"][0] == 12345.5
    if n == 47:
        assert len(raw) == 2024


def test_pnts_guards():
    with pytest.raises(errors.BY_CODE["zero-point-chunk"]):
        documents.encode_pnts(np.zeros((0, 3)), [0, 0, 0], np.zeros((0, 3)), {})
    with pytest.raises(errors.BY_CODE["position-count-mismatch"]):
        documents.encode_pnts(np.zeros((2, 3)), [0, 0, 0], np.zeros((1, 3)), {})


@pytest.mark.parametrize(("x", "text"), [(1.0, "1"), (0.1, "0.1"), (-2.5e-7, "-2.5e-7"), (1e-6, "0.000001"), (1e21, "1e+21"), (123456789012345680000.0, "123456789012345680000"), (88.7096992341827, "88.7096992341827"), (0.0, "0"), (1.5e300, "1.5e+300"), (100.0, "100")])
def test_numbers(x, text):
    assert documents.number(x) == text


def test_source(spark, tmp_path):
    keys = [(0, 0, 0, 0)] * 3 + [(2, 1, 0, 0)] * 5
    p = np.zeros(8, layout.POINT7)
    p["x"], p["gps_time"], p["returns"], p["red"] = np.arange(8) * 100, 7.5, 2 << 4 | 1, 45000
    (tmp_path / "a.copc").write_bytes(layout.build_file(p, keys, [0, 0, 0, 64, 64, 64], D.DEFINITION and 'PROJCS["p",AUTHORITY["EPSG","2992"]]'))
    spark.dataSource.register(CopcSource)
    load = lambda t: spark.read.format("copc").option("table", t).load(str(tmp_path))
    f = load("files").first()
    assert (f.point_count, f.point_format, f.cube, crs.epsg_code(f.wkt)) == (8, 7, [0, 0, 0, 64, 64, 64], 2992)
    assert {(r.depth, r.x, r.point_count) for r in load("hierarchy").collect()} == {(0, 0, 3), (2, 1, 5)} and load("pages").count() == 0
    rows = load("points").orderBy("x").collect()
    assert [r.x for r in rows] == [i * 1.0 for i in range(8)] and {(r.gps_time, r.return_number, r.number_of_returns, r.red) for r in rows} == {(7.5, 1, 2, 45000)}


def test_layout_refuses():
    good = layout.build_file(np.zeros(1, layout.POINT7), [(0, 0, 0, 0)], [0, 0, 0, 1, 1, 1])
    assert layout.check_file(layout.parse_header("u", good[:589]))["point_count"] == 1
    for at, value, code in ((0, b"X", "not-copc"), (94, b"\0\0", "unsupported-header-layout"), (377, b"x", "not-copc")):
        bad = bytearray(good)
        bad[at : at + len(value)] = value
        with pytest.raises(errors.LoomError) as e:
            layout.parse_header("u", bytes(bad[:589]))
        assert e.value.code == code
    entry = lambda *v: np.array([v], layout.ENTRY).tobytes()
    for page in (b"x" * 31, entry(-1, 0, 0, 0, 0, 5, 1), entry(0, 0, 0, 0, 0, 0, 1), entry(0, 0, 0, 0, 0, 5, 0), entry(0, 0, 0, 0, 0, 5, 9), entry(0, 0, 0, 0, 0, 0, -1), entry(0, 0, 0, 0, 0, 5, -2), entry(0, 0, 0, 0, 1, 5, 1) * 2):
        with pytest.raises(errors.BY_CODE["malformed-hierarchy"]):
            layout.parse_page("u", page, 5)
    nodes, pages = layout.parse_page("u", entry(0, 0, 0, 0, 100, 10, 5) + entry(1, 0, 0, 0, 900, 64, -1), 5)
    assert len(nodes) == len(pages) == 1


def test_stream_equals_batch(spark, tmp_path):
    from lidarloom.streaming.state import admission_stream

    schema = "provider string, seq long, op string, lease long, origin string, bytes long"
    rows = [("p", i, "acquire" if i % 3 else "release", i if i % 3 else i - 2, f"o{i % 2}", 30) for i in range(1, 30)]
    for k in range(3):
        frame(spark, rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = admission_stream(events, 100, 2).writeStream.format("memory").queryName("ledger_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.seq: r.verdict for r in spark.table("ledger_out").collect()}
    want = {r.seq: r.verdict for r in admission.ledger(frame(spark, rows, schema), 100, 2).collect()}
    assert got == want


def test_registry_differences(spark):
    docs = frame(spark, [("f", '{"root":{"content":{"uri":"copc://t/n/0-0-0-0"},"children":[{"content":{"uri":"copc://t/n/1-0-0-0"}}]}}'), ("g", "{}")], "url string, document string")
    known = frame(spark, [("f", "copc://t/n/0-0-0-0"), ("f", "copc://t/n/1-1-0-0"), ("f", None)], "url string, uri string")
    assert [tuple(r) for r in documents.registry_differences(docs, known, ["url"]).collect()] == [("f", 2, 2, 2)]
    held = octree.point_totals(frame(spark, [("f", 5), ("f", 6)], "url string, point_count long"), frame(spark, [("f", 10), ("g", 0)], "url string, point_count long"), ["url"])
    assert {tuple(r) for r in held.collect()} == {("f", 10, 11, "malformed-hierarchy"), ("g", 0, 0, None)}
