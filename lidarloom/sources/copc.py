"""The "copc" data source: files, hierarchy, pages or points of cloud-optimised point clouds as DataFrames.

spark.dataSource.register(CopcSource) makes spark.read.format("copc").option("table", ...).load(path) available. A reader
reads by ranges only: three reads open a file; point chunks are grouped into coalesced reads, one partition each.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, LessThan, LessThanOrEqual

from ..errors import error
from . import layout
from .reader import Reader, named

SCHEMAS = {
    "files": "url string, header_length int, point_data_offset long, vlr_count int, evlr_count int, point_format int, record_length int, scale array<double>, offset array<double>, min array<double>, max array<double>, point_count long, cube array<double>, spacing double, root_offset long, root_length long, wkt string, total_bytes long",
    "hierarchy": "url string, page_key string, depth int, x long, y long, z long, offset long, length long, point_count long",
    "pages": "url string, page_key string, depth int, x long, y long, z long, offset long, length long",
    "points": "url string, key string, ordinal long, x double, y double, z double, red int, green int, blue int, classification int, intensity int, gps_time double, return_number int, number_of_returns int",
}
MAX_GAP, MAX_WASTE = 256 * 1024, 0.02
#: Chunk decoders by name; the option decoder also takes module:attribute, which workers can import.
DECODERS: dict[str, Callable] = {"plain": layout.decode_plain}


def open_file(url: str, reader: Reader | None = None) -> dict:
    """Header, WKT and size (null if the server keeps it to itself); a format that can't be shown is refused before more is read."""
    reader = reader or Reader(url)
    h = layout.check_file(layout.parse_header(url, reader.read(0, layout.FIRST_READ)))
    span = h["point_data_offset"] - layout.HEADER
    h["wkt"] = layout.parse_wkt(url, reader.read(layout.HEADER, span), h["vlr_count"], h["evlr_count"]) if span > 0 else None
    return h | {"total_bytes": reader.total_bytes}


def walk(reader: Reader, h: dict, max_depth: int) -> Iterator[tuple[str, object, object]]:
    """(page key, nodes, sub-pages) of each hierarchy page, sub-pages deeper than max_depth left unread."""
    todo = [("0-0-0-0", h["root_offset"], h["root_length"])]
    while todo:
        key, offset, length = todo.pop()
        nodes, pages = layout.parse_page(reader.url, reader.read(offset, length), h["point_count"])
        yield key, nodes, pages
        todo += [("-".join(str(int(p[c])) for c in ("depth", "x", "y", "z")), int(p["offset"]), int(p["length"])) for p in pages if p["depth"] <= max_depth]


def groups(ranges: list[tuple[int, int, tuple]]) -> list[list[tuple[int, int, tuple]]]:
    """Ranges (offset, length, what) in reads: neighbours join while gap and waste stay in bounds."""
    out: list[list] = []
    wanted = 0
    for r in sorted(ranges):
        if out:
            start, end = out[-1][0][0], out[-1][-1][0] + out[-1][-1][1]
            if r[0] < end:
                raise error("invalid-byte-range", "ranges overlap")
            span = r[0] + r[1] - start
            if r[0] - end <= MAX_GAP and span - wanted - r[1] <= span * MAX_WASTE:
                out[-1].append(r)
                wanted += r[1]
                continue
        out.append([r])
        wanted = r[1]
    return out


class Part(InputPartition):
    def __init__(self, url: str, chunks: list | None = None):
        self.url, self.chunks = url, chunks


class CopcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table = options.get("table", "files")
        self.max_depth = int(options.get("maxDepth", "31"))
        self.decoder = options.get("decoder", "plain")
        path = options.get("path", "")
        self.fetch = options.get("fetch", "http")
        remote = path.lower().startswith(("http://", "https://"))
        self.urls = path.split() if remote else sorted(glob.glob(os.path.join(path, "*") if os.path.isdir(path) else path))
        if not self.urls or remote and not all(urlsplit(u).netloc for u in self.urls):
            raise error("invalid-source-url", f"nothing at {path!r}")

    def partitions(self) -> list[Part]:
        if self.table != "points":
            return [Part(u) for u in self.urls]
        out = []
        for u in self.urls:
            reader = Reader(u, self.fetch)
            h = open_file(u, reader)
            chunks = [(int(n["offset"]), int(n["length"]), tuple(int(n[c]) for c in ("depth", "x", "y", "z", "count"))) for _, nodes, _ in walk(reader, h, self.max_depth) for n in nodes if n["count"] > 0 and n["depth"] <= self.max_depth]
            out += [Part(u, g) for g in groups(chunks)]
        return out or [Part(self.urls[0], [])]

    def read(self, part: Part) -> Iterator[tuple]:
        names = [x.split()[0] for x in SCHEMAS[self.table].split(", ")]
        reader = Reader(part.url, self.fetch)
        h = open_file(part.url, reader)
        if self.table == "files":
            yield tuple(h[n] for n in names)
        elif self.table == "points":
            yield from self.points(part, h, names, reader)
        else:
            for key, nodes, pages in walk(reader, h, self.max_depth):
                for e in nodes if self.table == "hierarchy" else pages:
                    row = (part.url, key, *[int(e[c]) for c in ("depth", "x", "y", "z", "offset", "length")])
                    yield (*row, int(e["count"])) if self.table == "hierarchy" else row

    def points(self, part: Part, h: dict, names: list[str], reader: Reader) -> Iterator[tuple]:
        if not part.chunks:
            return
        start = part.chunks[0][0]
        raw = reader.read(start, part.chunks[-1][0] + part.chunks[-1][1] - start, sum(c[1] for c in part.chunks))
        decode = named(self.decoder, DECODERS)
        for offset, length, (*key, count) in part.chunks:
            p = decode(raw[offset - start : offset - start + length], h, count)
            text = "-".join(map(str, key))
            for i, row in enumerate(zip(*[p[n].tolist() for n in names[3:]], strict=True)):
                yield (part.url, text, i, *row)


class PruningReader(CopcReader):
    """Takes filters too (option pushdown, with spark.sql.python.filterPushdown.enabled): other files aren't opened, deeper pages aren't read.

    Spark evaluates every filter again, so that pruning may keep more than is asked for.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("url",):
                self.urls = [u for u in self.urls if u == f.value]
            elif isinstance(f, EqualTo | LessThan | LessThanOrEqual) and f.attribute == ("depth",):
                self.max_depth = min(self.max_depth, int(f.value) - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[Part]:
        return super().partitions() if self.urls else [Part("", [])]

    def read(self, part: Part) -> Iterator[tuple]:
        return super().read(part) if part.url else iter(())


class CopcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "copc"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "files")]

    def reader(self, schema) -> CopcReader:
        options = dict(self.options)
        return (PruningReader if options.get("pushdown", "").lower() == "true" else CopcReader)(options)
