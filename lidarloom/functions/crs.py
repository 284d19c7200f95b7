"""Coordinate reference systems: WKT codes, the registry, definitions, and projections as Column expressions."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import error

#: WGS84 and GRS80.
A, WGS84_F, GRS80_F = 6378137.0, 1 / 298.257223563, 1 / 298.257222101
FOOT, US_FOOT = 0.3048, 1200 / 3937
PROJECTIONS = ("longlat", "latlong", "lcc", "merc", "tmerc", "utm")
WGS84_DEFINITION = "+proj=longlat +datum=WGS84 +no_defs"

TOKEN = re.compile(r'"[^"]*(?:"|$)|\[|\]|[A-Z_]+(?=\s*\[)')
EPSG = re.compile(r'\s*"?EPSG"?\s*,\s*"?([0-9]+)"?\s*')


def epsg_code(wkt: str | None) -> int | None:
    """The EPSG code that is a direct child of PROJCS, or of GEOGCS where there is no PROJCS; the last of each wins."""
    path: list[tuple[str, int]] = []
    word, codes, projected = "", {}, False
    for t in TOKEN.finditer(wkt or ""):
        if t[0] == "[":
            projected |= word == "PROJCS"
            path.append((word, t.end()))
            word = ""
        elif t[0] == "]":
            if path:
                name, begin = path.pop()
                m = EPSG.fullmatch((wkt or "")[begin : t.start()]) if name == "AUTHORITY" and path else None
                if m:
                    codes[path[-1][0]] = int(m[1])
        elif t[0][0] != '"':
            word = t[0]
    return codes.get("PROJCS") if projected else codes.get("GEOGCS")


@F.pandas_udf(T.IntegerType())
def epsg_codes(wkts: pd.Series) -> pd.Series:
    """epsg_code() of a column, a batch at a time."""
    return wkts.map(epsg_code).astype("Int32")


class Registry:
    """EPSG codes to proj4 definitions; a code registered again replaces the former definition."""

    def __init__(self):
        self.known = {4326: WGS84_DEFINITION}

    def register(self, code: int, definition: str) -> None:
        self.known[code] = definition

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.known.items()), "code int, definition string")

    def resolve(self, wkt: str | None) -> str:
        code = epsg_code(wkt)
        if code is None:
            raise error("crs-code-not-found", "the file's WKT names no horizontal EPSG code")
        if code not in self.known:
            raise error("crs-not-registered", f"EPSG:{code} isn't registered; register_crs({code}, '+proj=...') adds it", epsg_code=code)
        return self.known[code]


def terms(definition: str) -> dict[str, str | bool]:
    """+key=value terms: keys in lower case, the last of repeated ones wins, a bare term is True."""
    out: dict[str, str | bool] = {}
    for part in definition.split("+"):
        key, eq, value = part.strip().partition("=")
        if key.strip():
            out[key.strip().lower()] = value.strip() if eq else True
    return out


def check_definition(definition: str) -> dict[str, str | bool]:
    found = terms(definition)
    if "nadgrids" in found and found["nadgrids"] != "@null":
        raise error("crs-definition-unusable", "the definition needs a grid shift", reason="grid-shift")
    if "proj" not in found:
        reason = "missing-projection" if definition.strip().startswith("+") else "alias"
        raise error("crs-definition-unusable", f"the definition has no projection ({reason})", reason=reason)
    for key, held, reason in (("ellps", ("GRS80", "WGS84"), "unsupported-ellipsoid"), ("datum", ("WGS84", "NAD83"), "unsupported-datum"), ("axis", ("enu",), "unsupported-axis")):
        if key in found and found[key] not in held:
            raise error("crs-definition-unusable", f"+{key}={found[key]} isn't built in", reason=reason)
    if any(k in found for k in ("a", "b", "r", "rf", "f", "es", "e")):
        raise error("crs-definition-unusable", "ellipsoids by their axes aren't built in", reason="unsupported-ellipsoid")
    if "towgs84" in found and any(float(v) for v in str(found["towgs84"]).split(",")):
        raise error("crs-definition-unusable", "datum shifts aren't built in", reason="unsupported-datum")
    if str(found.get("pm", "greenwich")).lower() not in ("greenwich", "0"):
        raise error("crs-definition-unusable", f"the prime meridian {found['pm']} isn't built in", reason="unsupported-meridian")
    if found["proj"] not in PROJECTIONS:
        raise error("crs-definition-unusable", f"projection {found['proj']} isn't built in", reason="unsupported-projection")
    if found["proj"] == "utm" and not 1 <= int(found.get("zone", 0)) <= 60:
        raise error("crs-definition-unusable", "utm needs a zone from 1 to 60", reason="unsupported-projection")
    return found


def metres_per_unit(found: dict[str, str | bool]) -> float:
    """to_meter, else units; what is missing or 0 counts as 1."""
    if "to_meter" in found:
        return float(found["to_meter"]) or 1.0
    return {"ft": FOOT, "us-ft": US_FOOT, "km": 1000.0}.get(str(found.get("units", "m")), 1.0)


@dataclass
class Transform:
    """to_wgs84(x, y, z) gives Columns lon, lat (degrees) and height (metres) over a DataFrame's columns."""

    found: dict
    unit: float

    def number(self, key: str, default: float = 0.0) -> float:
        return float(self.found.get(key, default))

    @property
    def flattening(self) -> float:
        return GRS80_F if "GRS80" in (self.found.get("ellps"), {"NAD83": "GRS80"}.get(str(self.found.get("datum")))) else WGS84_F

    @property
    def eccentricity(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    def lonlat(self, point: Column) -> Column:
        """Struct lon, lat (degrees) of a struct x, y (file units), as one expression: for arrays, where columns can't be staged."""
        if self.found["proj"] in ("longlat", "latlong"):
            return F.struct(point["x"].alias("lon"), point["y"].alias("lat"))
        once = lambda value, body: F.transform(F.array(value), body)[0]

        lon, t = self.conformal(point["x"], point["y"])
        chi = F.struct(lon.alias("lon"), (F.lit(math.pi / 2) - 2 * F.atan(t)).alias("chi"))
        return once(chi, lambda v: F.struct(v["lon"].alias("lon"), F.degrees(geodetic(v["chi"], self.flattening)).alias("lat")))

    def conformal(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude in degrees, and the isometric t of the latitude: tan(pi / 4 - conformal latitude / 2)."""
        number, e, kind = self.number, self.eccentricity, self.found["proj"]
        utm = kind == "utm"
        x_0, y_0 = (500000.0, 10000000.0 if "south" in self.found else 0.0) if utm else (number("x_0"), number("y_0"))
        east, north = x * F.lit(self.unit) - F.lit(x_0), y * F.lit(self.unit) - F.lit(y_0)
        k0 = number("k_0", number("k", 0.9996 if utm else 1.0))
        lon_0 = 6.0 * int(self.found["zone"]) - 183 if utm else number("lon_0")
        if kind == "lcc":
            lat0, lat1, lat2 = (math.radians(number(k, number("lat_1"))) for k in ("lat_0", "lat_1", "lat_2"))
            m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
            t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
            n = math.log(m(lat1) / m(lat2)) / math.log(t(lat1) / t(lat2)) if abs(lat1 - lat2) > 1e-10 else math.sin(lat1)
            scale = A * m(lat1) / (n * t(lat1) ** n) * k0
            rho0, sign = scale * t(lat0) ** n, math.copysign(1.0, n)
            dy = F.lit(rho0) - north
            rho = F.lit(sign) * F.sqrt(east * east + dy * dy)
            return F.degrees(F.atan2(F.lit(sign) * east, F.lit(sign) * dy) / F.lit(n)) + F.lit(lon_0), F.pow(rho / F.lit(scale), F.lit(1 / n))
        if kind == "merc":
            ts = math.radians(number("lat_ts"))
            k0 = math.cos(ts) / math.sqrt(1 - (e * math.sin(ts)) ** 2) if "lat_ts" in self.found else k0
            return F.degrees(east / F.lit(A * k0)) + F.lit(lon_0), F.exp(-north / F.lit(A * k0))
        radius, out, back = kruger(self.flattening)
        lat0 = math.radians(0.0 if utm else number("lat_0"))
        chi = math.asin(math.tanh(math.atanh(math.sin(lat0)) - e * math.atanh(e * math.sin(lat0)))) if abs(lat0) < math.pi / 2 else lat0
        origin = chi + sum(a * math.sin(2 * j * chi) for j, a in enumerate(out, 1))
        xi, eta = north / F.lit(k0 * radius) + F.lit(origin), east / F.lit(k0 * radius)
        xi1 = xi - sum(F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(back, 1))
        eta1 = eta - sum(F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(back, 1))
        lon = F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + F.lit(lon_0)
        return lon, F.tan(F.lit(math.pi / 4) - F.asin(F.sin(xi1) / F.cosh(eta1)) / 2)

    def with_wgs84(self, df: DataFrame, x: str, y: str, z: str, prefix: str = "") -> DataFrame:
        """df with columns lon, lat and height (each with the prefix). The conformal latitude is staged, so that it isn't repeated."""
        lon, lat, height = f"{prefix}lon", f"{prefix}lat", f"{prefix}height"
        kind = self.found["proj"]
        df = df.withColumn(height, F.col(z) * F.lit(self.unit))
        if kind in ("longlat", "latlong"):
            return df.withColumns({lon: F.col(x), lat: F.col(y)})
        work = f"{prefix}__t"
        made = self.conformal(F.col(x), F.col(y))
        df = df.withColumns({lon: made[0], work: F.lit(math.pi / 2) - 2 * F.atan(made[1])})
        return df.withColumn(lat, F.degrees(geodetic(F.col(work), self.flattening))).drop(work)


def kruger(f: float) -> tuple[float, list[float], list[float]]:
    """Rectifying radius, and the coefficients of the transverse Mercator series to the fourth order: outwards and back."""
    n = f / (2 - f)
    #: The published series in the third flattening.
    out = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return A / (1 + n) * (1 + n**2 / 4 + n**4 / 64), out, back


def geodetic(chi: Column, f: float) -> Column:
    """Latitude from the conformal latitude by the series of the sixth order: two trigonometric functions, exact to the last digits of a double."""
    n = f / (2 - f)
    #: The published series in the third flattening.
    d = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45 + 26 * n**5 / 45 - 2854 * n**6 / 675,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45 + 2704 * n**5 / 315 + 2323 * n**6 / 945,
        56 * n**3 / 15 - 136 * n**4 / 35 - 1262 * n**5 / 105 + 73814 * n**6 / 2835,
        4279 * n**4 / 630 - 332 * n**5 / 35 - 399572 * n**6 / 14175,
        4174 * n**5 / 315 - 144838 * n**6 / 6237,
        601676 * n**6 / 22275,
    ]
    # sin(2j chi) = sin(2 chi) U(j - 1) of c = cos(2 chi): the polynomial in c, by its coefficients
    powers, before, now = [0.0] * len(d), [0.0], [1.0]
    for c in d:
        for i, v in enumerate(now):
            powers[i] += c * v
        before, now = now, [(2 * now[i - 1] if i else 0.0) - (before[i] if i < len(before) else 0.0) for i in range(len(now) + 1)]
    c, total = F.cos(2 * chi), F.lit(powers[-1])
    for v in reversed(powers[:-1]):
        total = total * c + F.lit(v)
    return chi + F.sin(2 * chi) * total


def transform(definition: str) -> Transform:
    found = check_definition(definition)
    return Transform(found, metres_per_unit(found))


def ecef(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    """Geocentric metres on WGS84 from degrees and ellipsoidal height."""
    e2 = WGS84_F * (2 - WGS84_F)
    la, ph = F.radians(lon), F.radians(lat)
    n = F.lit(A) / F.sqrt(1 - F.lit(e2) * F.sin(ph) * F.sin(ph))
    return (n + height) * F.cos(ph) * F.cos(la), (n + height) * F.cos(ph) * F.sin(la), (n * F.lit(1 - e2) + height) * F.sin(ph)
