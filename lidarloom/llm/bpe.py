"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A null text counts as empty: no tokens, empty bytes. Long texts are encoded part by part, cut only between a
character that isn't white space and a blank, where every match of the pattern ends anyway, so that the ids
equal those of the whole text. A text without such a place is encoded in one part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

#: Characters after which a long text is cut at the next safe place.
PART = 1 << 16
SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """Parts of a text, each of about size characters, cut where no match of the pattern crosses."""
    at = 0
    while len(text) - at > size and (m := SAFE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(text: str | None, path: str, pattern: str) -> Iterator[list[int]]:
    enc = encoding(path, pattern)
    for part in parts(text or ""):
        yield enc.encode_ordinary(part)


def _rows(path: str, pattern: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        names = [str(i).encode() for i in range(enc.n_vocab)]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, ids_hash, bytes_hash, ids_all, bytes_all = 0, hashlib.sha256(), hashlib.sha256(), [], []
                for ids in encode(text.as_py(), path, pattern):
                    if not ids:
                        continue
                    raw = enc.decode_bytes(ids)
                    ids_hash.update((b" " if n else b"") + b" ".join([names[i] for i in ids]))
                    bytes_hash.update(raw)
                    n += len(ids)
                    if full:
                        ids_all += ids
                        bytes_all.append(raw)
                out.append((doc_id, n, ids_hash.hexdigest(), bytes_hash.hexdigest(), *((ids_all, b"".join(bytes_all)) if full else ())))
                if full and len(out) == 256:
                    yield _batch(out, full)
                    out = []
            if out:
                yield _batch(out, full)

    return run


def _batch(rows: list[tuple], full: bool) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kinds += [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] if full else []
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, full: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, digests of ids and decoded bytes, and with full the ids and bytes themselves.

    Narrow: one pass, no shuffle; a task holds one Arrow batch. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * full
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(_rows(path or rank_path(), pattern or default_pattern(), full), schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), full=False)
