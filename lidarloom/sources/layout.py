"""Binary layouts of cloud-optimised point clouds: header, info record, WKT record, hierarchy pages, plain point records."""

from __future__ import annotations

import struct

import numpy as np

from ..errors import error

#: Fixed values of the file format.
HEADER, INFO_HEADER_END, INFO, FIRST_READ = 375, 429, 160, 589
SAFE = (1 << 53) - 1
ENTRY = np.dtype([("depth", "<i4"), ("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("offset", "<u8"), ("length", "<i4"), ("count", "<i4")])
POINT7 = np.dtype({"names": ["x", "y", "z", "intensity", "returns", "classification", "gps_time", "red", "green", "blue"], "formats": ["<i4", "<i4", "<i4", "<u2", "u1", "u1", "<f8", "<u2", "<u2", "<u2"], "offsets": [0, 4, 8, 12, 14, 16, 22, 30, 32, 34], "itemsize": 36})
FORMATS = (7, 8)


def parse_header(url: str, b: bytes) -> dict:
    """Of the first 589 bytes; checks come in the order in which the format is read."""
    if len(b) < FIRST_READ or b[:4] != b"LASF":
        raise error("not-copc", f"{url}: no LAS header", url=url)
    u = lambda fmt, at: struct.unpack_from("<" + fmt, b, at)
    if u("H", 94)[0] != HEADER:
        raise error("unsupported-header-layout", f"{url}: header of {u('H', 94)[0]} bytes", url=url)
    user, record, length = b[377:393].rstrip(b"\0"), u("H", 393)[0], u("H", 395)[0]
    if (user, record) != (b"copc", 1) or length != INFO:
        raise error("not-copc", f"{url}: the first record isn't the info record", url=url)
    cx, cy, cz, half, spacing = u("5d", INFO_HEADER_END)
    root_offset, root_length = u("2Q", INFO_HEADER_END + 40)
    count, evlr = u("Q", 247)[0], u("I", 243)[0]
    if max(root_offset, root_length, count) > SAFE:
        raise error("not-copc", f"{url}: offsets beyond 2**53", url=url)
    x1, x0, y1, y0, z1, z0 = u("6d", 179)
    return {
        "url": url, "header_length": HEADER, "point_data_offset": u("I", 96)[0], "vlr_count": u("I", 100)[0], "evlr_count": evlr,
        "point_format": b[104] & 0x3F, "record_length": u("H", 105)[0], "scale": list(u("3d", 131)), "offset": list(u("3d", 155)),
        "min": [x0, y0, z0], "max": [x1, y1, z1], "point_count": count, "cube": [cx - half, cy - half, cz - half, cx + half, cy + half, cz + half],
        "spacing": spacing, "root_offset": root_offset, "root_length": root_length,
    }


def check_file(h: dict) -> dict:
    if h["point_format"] not in FORMATS:
        raise error("unsupported-point-format", f"{h['url']}: point format {h['point_format']}", url=h["url"])
    if not h["root_length"]:
        raise error("malformed-hierarchy", f"{h['url']}: empty root page", url=h["url"])
    return h


def parse_wkt(url: str, region: bytes, vlrs: int, evlrs: int) -> str | None:
    """The WKT record of the records between header and points; None if there is none, an error if it may be in the extended ones."""
    at = 0
    for _ in range(vlrs):
        if at + 54 > len(region):
            raise error("not-copc", f"{url}: records overrun their region", url=url)
        user, record, length = region[at + 2 : at + 18].rstrip(b"\0"), *struct.unpack_from("<HH", region, at + 18)
        body = region[at + 54 : at + 54 + length]
        if (user, record) == (b"LASF_Projection", 2112):
            if len(body) < length:
                raise error("not-copc", f"{url}: the WKT record overruns its region", url=url)
            if text := body.rstrip(b"\0").decode("utf-8", "replace"):
                return text
        at += 54 + length
    if evlrs:
        raise error("wkt-not-in-vlrs", f"{url}: no WKT before the points", url=url)
    return None


def parse_page(url: str, b: bytes, file_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and sub-pages of a hierarchy page, validated; a key that comes twice is refused."""

    def bad(why: str, key=None):
        return error("malformed-hierarchy", f"{url}: {why}" + (f" at {'-'.join(map(str, key))}" if key is not None else ""), url=url)

    if len(b) % ENTRY.itemsize:
        raise bad(f"page of {len(b)} bytes")
    e = np.frombuffer(b, ENTRY)
    key = np.stack([e[c] for c in ("depth", "x", "y", "z")], axis=1) if len(e) else np.zeros((0, 4), int)
    for wrong, why in (
        ((key < 0).any(1), "negative key"), (e["count"] < -1, "count below -1"), (e["length"] < 0, "negative length"), (e["offset"] > SAFE, "offset beyond 2**53"),
        ((e["count"] == -1) & (e["length"] == 0), "empty sub-page"), ((e["count"] > 0) & (e["length"] == 0), "points without bytes"),
        ((e["count"] == 0) & (e["length"] > 0), "bytes without points"), (e["count"] > file_count, "more points than the file"),
    ):
        if wrong.any():
            raise bad(why, key[wrong.argmax()])
    if len(np.unique(key, axis=0)) < len(key):
        raise bad("a key comes twice")
    return e[e["count"] >= 0], e[e["count"] == -1]


def decode_plain(raw: bytes, header: dict, count: int) -> dict[str, np.ndarray]:
    """Points of an uncompressed chunk. Compressed chunks need a decoder of their own: any callable of this form."""
    size = header["record_length"]
    if len(raw) < size * count:
        raise error("worker-task-failed", "the chunk is shorter than its points")
    p = np.frombuffer(raw, np.dtype({**{k: list(v) if isinstance(v, tuple) else v for k, v in (("names", POINT7.names), ("formats", [POINT7.fields[n][0] for n in POINT7.names]), ("offsets", [POINT7.fields[n][1] for n in POINT7.names]))}, "itemsize": size}), count)
    out = {c: p[c] * header["scale"][i] + header["offset"][i] for i, c in enumerate("xyz")}
    out |= {c: p[c] for c in ("red", "green", "blue", "intensity", "classification", "gps_time")}
    return out | {"return_number": p["returns"] & 15, "number_of_returns": p["returns"] >> 4}


def build_file(points: np.ndarray, keys: list[tuple[int, int, int, int]], cube: list[float], wkt: str = "", scale: float = 0.01, offset: list[float] | None = None) -> bytes:
    """A file with uncompressed chunks, for tests and tools: points (POINT7) dealt out by keys, one for each point."""
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    text = wkt.encode() + b"\0" if wkt else b""
    vlrs = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(text), b"") + text if wkt else b""
    data = FIRST_READ + len(vlrs)
    entries, at = [], data
    groups: dict[tuple, int] = {}
    for i in order:
        groups[keys[i]] = groups.get(keys[i], 0) + 1
    for k, n in groups.items():
        entries.append((*k, at, 36 * n, n))
        at += 36 * n
    page = np.array(entries, ENTRY).tobytes()
    half = (cube[3] - cube[0]) / 2
    h = bytearray(HEADER)
    h[:4] = b"LASF"
    struct.pack_into("<HIIBH", h, 94, HEADER, data, 1 + bool(wkt), 7, 36)
    struct.pack_into("<6d", h, 131, scale, scale, scale, *(offset or cube[:3]))
    struct.pack_into("<6d", h, 179, cube[3], cube[0], cube[4], cube[1], cube[5], cube[2])
    struct.pack_into("<Q", h, 247, len(points))
    info = struct.pack("<5d2Q", *[(cube[i] + cube[i + 3]) / 2 for i in range(3)], half, half / 64, at, len(page)).ljust(INFO, b"\0")
    return bytes(h) + struct.pack("<H16sHH32s", 0, b"copc", 1, INFO, b"") + info + vlrs + points[order].tobytes() + page
