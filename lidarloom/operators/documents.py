"""Sinks: tileset documents and point-tile payloads."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import error

#: Magic and version of a point tile, bytes of its header.
MAGIC, VERSION, HEADER = b"pnts", 1, 28
#: Batch table in this order: column, numpy type, component type.
BATCH = (("GpsTime", "<f8", "DOUBLE"), ("Intensity", "<u2", "UNSIGNED_SHORT"), ("Classification", "u1", "UNSIGNED_BYTE"), ("ReturnNumber", "u1", "UNSIGNED_BYTE"), ("NumberOfReturns", "u1", "UNSIGNED_BYTE"))


def number(x: float) -> str:
    """A double as JavaScript writes it: shortest digits, whole numbers without point, exponents only from 1e21 or below 1e-6."""
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == 0:
        return "0"
    digits, _, exponent = f"{repr(float(abs(x)))}".partition("e")
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    n = len(whole) + int(exponent or 0)
    all_digits = (whole + part).lstrip("0")
    n -= len(whole + part) - len(all_digits) if whole.strip("0") == "" else 0
    all_digits = all_digits.rstrip("0")
    sign, k = "-" if x < 0 else "", len(all_digits)
    if k <= n <= 21:
        return sign + all_digits + "0" * (n - k)
    if 0 < n <= 21:
        return sign + all_digits[:n] + "." + all_digits[n:]
    if -6 < n <= 0:
        return sign + "0." + "0" * -n + all_digits
    e = n - 1
    return sign + all_digits[0] + ("." + all_digits[1:] if k > 1 else "") + ("e+" if e > 0 else "e-") + str(abs(e))


def dumps(x) -> str:
    """Compact JSON with numbers as JavaScript writes them; None members are left out."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{dumps(v)}" for k, v in x.items() if v is not None) + "}"
    if isinstance(x, list | tuple):
        return "[" + ",".join(map(dumps, x)) + "]"
    if isinstance(x, bool | str) or x is None:
        return json.dumps(x, ensure_ascii=False)
    return number(float(x))


def tree_document(rows: pd.DataFrame) -> str:
    """Nested tileset document of one page's tiles: key, parent_key, depth, x, y, z, uri, geometric_error, region (six numbers)."""
    rows = rows.sort_values(["depth", "x", "y", "z"])
    made: dict[str, dict] = {}
    root = None
    for r in rows.itertuples(index=False):
        tile = {"boundingVolume": {"region": list(r.region)}, "geometricError": r.geometric_error, "content": {"uri": r.uri} if r.uri else None}
        made[r.key] = tile
        parent = made.get(r.parent_key) if r.parent_key else None
        if parent is None:
            if root is not None:
                raise error("malformed-hierarchy", f"{r.key} is a second root of its page")
            root = tile
            root["refine"] = "ADD"
        else:
            parent.setdefault("children", []).append(tile)
    if root is None:
        raise error("malformed-hierarchy", "a page without a root tile")
    return dumps({"asset": {"version": "1.0"}, "geometricError": root["geometricError"], "root": root})


def tileset_documents(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """One document for each page. keys name the page; its tiles are bounded by the page size of the file format."""
    schema = ", ".join(f"{k} {dict(tiles.dtypes)[k]}" for k in keys) + ", n_tiles long, document string"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, len(pdf), tree_document(pdf))], columns=[*keys, "n_tiles", "document"])

    return tiles.groupBy(*keys).applyInPandas(run, schema)


def _padded(text: str, at: int) -> bytes:
    raw = text.encode()
    return raw + b" " * (-(at + len(raw)) % 8)


@lru_cache(maxsize=4096)
def batch_table(n: int) -> str:
    """JSON of the batch table of n points."""
    table, at = {}, 0
    for name, dtype, component in BATCH:
        table[name] = {"byteOffset": at, "componentType": component, "type": "SCALAR"}
        at += n * np.dtype(dtype).itemsize
    return dumps(table)


def encode_pnts(relative: np.ndarray, centre: list[float], rgb: np.ndarray, batch: dict[str, np.ndarray]) -> bytes:
    """relative: float32 [n, 3]; rgb: uint8 [n, 3]; batch: the columns of BATCH."""
    n = len(rgb)
    if not n:
        raise error("zero-point-chunk", "a tile without points has no payload")
    if relative.shape != (n, 3):
        raise error("position-count-mismatch", f"{relative.size} coordinates for {n} points")
    kind, component = ("u1", "UNSIGNED_BYTE") if n <= 256 else ("<u2", "UNSIGNED_SHORT") if n <= 65536 else ("<u4", "UNSIGNED_INT")
    ids = np.arange(n).astype(kind).tobytes()
    positions = relative.astype("<f4").tobytes()
    feature = {"POINTS_LENGTH": n, "RTC_CENTER": list(centre), "POSITION": {"byteOffset": 0}, "BATCH_ID": {"byteOffset": len(positions), "componentType": component}, "RGB": {"byteOffset": len(positions) + len(ids)}, "BATCH_LENGTH": n}
    feature_json = _padded(dumps(feature), HEADER)
    body = positions + ids + rgb.astype("u1").tobytes()
    body += b"\0" * (-(HEADER + len(feature_json) + len(body)) % 8)
    start = HEADER + len(feature_json) + len(body)
    batch_json = _padded(batch_table(n), start)
    tail = b"".join([np.asarray(batch[name]).astype(dtype, copy=False).tobytes() for name, dtype, _ in BATCH])
    tail += b"\0" * (-(start + len(batch_json) + len(tail)) % 8)
    total = start + len(batch_json) + len(tail)
    return MAGIC + struct.pack("<6I", VERSION, total, len(feature_json), len(body), len(batch_json), len(tail)) + feature_json + body + batch_json + tail


def decode_pnts(raw: bytes) -> dict:
    """The inverse of encode_pnts, with checks of the layout."""
    version, total, fj, fb, bj, bb = struct.unpack("<6I", raw[4:HEADER])
    if raw[:4] != MAGIC or version != VERSION or total != len(raw) or HEADER + fj + fb + bj + bb != total or (HEADER + fj) % 8 or total % 8:
        raise error("worker-task-failed", "not a point tile")
    feature = json.loads(raw[HEADER : HEADER + fj])
    body = raw[HEADER + fj : HEADER + fj + fb]
    table = json.loads(raw[HEADER + fj + fb :][:bj])
    tail, n = raw[total - bb :], feature["POINTS_LENGTH"]
    kinds = {"UNSIGNED_BYTE": "u1", "UNSIGNED_SHORT": "<u2", "UNSIGNED_INT": "<u4", "DOUBLE": "<f8"}
    get = lambda src, at, kind, k=1: np.frombuffer(src, kind, n * k, at)
    return {
        "centre": feature["RTC_CENTER"],
        "relative": get(body, 0, "<f4", 3).reshape(n, 3),
        "ids": get(body, feature["BATCH_ID"]["byteOffset"], kinds[feature["BATCH_ID"]["componentType"]]),
        "rgb": get(body, feature["RGB"]["byteOffset"], "u1", 3).reshape(n, 3),
        "batch": {k: get(tail, v["byteOffset"], kinds[v["componentType"]]) for k, v in table.items()},
    }


def point_tiles(points: DataFrame, keys: list[str]) -> DataFrame:
    """Payload of each tile: keys, point_count, rtc, payload. points: keys, ordinal, ex, ey, ez, red, green, blue (16 bits), gps_time, intensity, classification, return_number, number_of_returns.

    One pass: a tile's points, bounded by the node size of the file format, meet once and give box, centre and payload.
    """
    kinds = dict(points.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", point_count long, rtc array<double>, payload binary"
    values = ["ex", "ey", "ez", "red", "green", "blue", "gps_time", "intensity", "classification", "return_number", "number_of_returns"]
    given = points.select(*keys, "ordinal", *values).repartition(*keys).sortWithinPartitions(*keys, "ordinal")
    return given.mapInArrow(_tiles(len(keys)), schema)


def _tiles(n_keys: int):
    """Rows come sorted by tile and ordinal; tiles are cut from the column buffers, and the last one of a batch waits for the next."""
    names = [n for n, _, _ in BATCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if rest is not None and len(rest):
                rows = pa.concat_tables([rest, rows])
            if not len(rows):
                continue
            rows = rows.combine_chunks()
            new = np.zeros(len(rows), bool)
            new[0] = True
            for k in range(n_keys):
                codes = rows.column(k).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(new)
            rest = rows.slice(starts[-1])
            if len(starts) > 1:
                yield made(rows, starts)
        if rest is not None and len(rest):
            yield made(rest.combine_chunks(), np.array([0, len(rest)]))

    def made(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        x = [rows.column(i).to_numpy() for i in range(n_keys + 1, rows.num_columns)]
        at = np.stack(x[:3], axis=1).astype(float)[: starts[-1]]
        centres = (np.minimum.reduceat(at, starts[:-1]) + np.maximum.reduceat(at, starts[:-1])) / 2
        sizes = np.diff(starts)
        relative = (at - np.repeat(centres, sizes, axis=0)).astype("<f4")
        rgb = (np.stack(x[3:6], axis=1).astype(np.int64)[: starts[-1]] >> 8).astype("u1")
        batch = {n: v.astype(d, copy=False) for (n, d, _), v in zip(BATCH, x[6:], strict=True)}
        raws = [encode_pnts(relative[s:e], c, rgb[s:e], {n: batch[n][s:e] for n in names}) for s, e, c in zip(starts[:-1].tolist(), starts[1:].tolist(), centres.tolist(), strict=True)]
        keys = [rows.column(k).combine_chunks().take(pa.array(starts[:-1])) for k in range(n_keys)]
        made_ = [pa.array(sizes.astype(np.int64)), pa.array(centres.tolist(), pa.list_(pa.float64())), pa.array(raws, pa.binary())]
        return pa.RecordBatch.from_arrays([*keys, *made_], names=[*rows.schema.names[:n_keys], "point_count", "rtc", "payload"])

    return run


def registry_differences(docs: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """For each page the URIs in its document, those in the registry (keys, uri), and how many only one of both has."""
    named = docs.select(*keys, F.explode(F.regexp_extract_all("document", F.lit('"uri":"([^"]*)"'), F.lit(1))).alias("uri"), F.lit(1).alias("here"))
    known = registry.where("uri is not null").select(*keys, "uri", F.lit(1).alias("there"))
    both = named.join(known, [*keys, "uri"], "full")
    return both.groupBy(*keys).agg(F.count("here").alias("n_document"), F.count("there").alias("n_registry"), F.count_if(F.col("here").isNull() | F.col("there").isNull()).alias("n_unmatched"))
