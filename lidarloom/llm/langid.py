"""Language identification: multinomial logistic regression on TF-IDF of hashed character n-grams.

Term frequencies are shares of a document's n-grams; document frequencies are counted over all training documents. Weights
are trained with follow-the-regularised-leader (per-coordinate rates, elastic net: the L1 part leaves most of them 0) on a
bounded sample of rows for each language, of any length, and a temperature is then fitted on rows of the sample that were held back.

A text's score depends on the text alone: n-grams lie inside one text, and weights are whole multiples of 1 / UNIT, whose sums are
exact in any order, so that rows, batches and neighbours don't matter. A text that is null or has no letter is "und" with
score 0. Repeated rows each get the same row; an empty table gives no rows; without training rows every text is "und" with score 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, ship, table

BITS, ORDERS = 15, (1, 2, 3)
DIMS = 1 << BITS
#: Characters of lower-cased text handled at once; a longer text is taken part by part.
WINDOW = 1 << 18
#: Weights are rounded to whole multiples of 1 / UNIT.
UNIT = 1 << 22


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def hashes(c: np.ndarray, order: int) -> np.ndarray:
    """A hash for the n-gram at each place of c but the last order - 1."""
    n = len(c) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, 0x9E37 + order, np.uint32)
    for k in range(order):
        h = (h ^ c[k : k + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def n_grams(length: int) -> int:
    """Number of n-grams of all orders in a text of length characters."""
    return sum(max(0, length - order + 1) for order in ORDERS)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, ascending, and hash) of every n-gram of lower-cased texts, about WINDOW characters at a time."""
    held: list[tuple[int, str, int]] = []  # text, part with the characters after it that its last n-grams need, places that are its own
    size = 0

    def flush() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        c, sizes = codes("".join([p for _, p, _ in held])), np.array([len(p) for _, p, _ in held])
        at = np.arange(len(c)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row, own, rest = (np.repeat(x, sizes) for x in (np.array([i for i, _, _ in held]), np.array([o for _, _, o in held]), sizes))
        for order in ORDERS:
            h = hashes(c, order)
            inside = ((at < own) & (at + order <= rest))[: len(h)]
            yield row[: len(h)][inside], h[inside]

    for i, text in enumerate(texts):
        for at in range(0, len(text), WINDOW):
            part = text[at : at + WINDOW + max(ORDERS) - 1]
            held.append((i, part, min(WINDOW, len(text) - at)))
            size += len(part)
            if size >= WINDOW:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def counts_of(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text."""
    return sum((np.bincount(h, minlength=DIMS) for _, h in grams([text.lower()])), np.zeros(DIMS, np.int64))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # int64 [DIMS, language], idf and scale included, in units of 1 / UNIT
    bias: np.ndarray
    temperature: float


def logits(texts: list[str], model: Model) -> np.ndarray:
    """Raw scores [text, language]."""
    low = [t.lower() for t in texts]
    sums = np.zeros((len(low), len(model.langs)), np.int64)
    for row, h in grams(low):
        if len(row):
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            sums[row[first]] += np.add.reduceat(model.weights[h], first, axis=0)
    n = np.array([max(n_grams(len(t)), 1) for t in low], float)
    return sums / UNIT / n[:, None] + model.bias


def probabilities(z: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    z = z / temperature
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task: how many documents hold each hashed n-gram, as one row a coordinate in use, and their number as coordinate -1."""
    found, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            texts = [(t or "").lower() for t in batch.column(0).slice(at, 64).to_pylist()]
            held = np.zeros((len(texts), DIMS), bool)
            for row, h in grams(texts):
                held[row, h] = True
            found += held.sum(0)
            n += len(texts)
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(found[at], n), pa.int64())], names=["at", "n"])


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Over all rows of docs; the result is bounded by the number of coordinates. Tasks' counts are added in the shuffle."""
    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(_frequencies, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out, known = np.zeros(DIMS), rows["at"].to_numpy() >= 0
    out[rows["at"].to_numpy()[known]] = rows["n"].to_numpy()[known]
    return out, int(rows["n"].to_numpy()[~known].sum())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, h, text: lang, h and the counts of the text's n-grams, packed: at most DIMS of them, however long the text is."""
    for batch in batches:
        rows = []
        for text in batch.column(2):
            text = text.as_py()
            if not has_letter(text):
                rows.append(None)
                continue
            counts = counts_of(text)
            at = np.flatnonzero(counts)
            rows.append(zlib.compress(at.astype("<u2").tobytes() + counts[at].astype("<u4").tobytes(), 1))
        keep = [i for i, r in enumerate(rows) if r is not None]
        yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(keep, pa.int32())) for i in (0, 1)], pa.array([rows[i] for i in keep], pa.binary())], names=["lang", "h", "packed"])


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and counts of a row of _features."""
    raw = zlib.decompress(raw)
    n = len(raw) // 6
    return np.frombuffer(raw, "<u2", n).astype(np.int64), np.frombuffer(raw, "<u4", n, 2 * n).astype(np.int64)


def sample(docs: DataFrame, each: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, coordinates, counts): about each rows of every language, those of the smallest hashes, of any length, with a letter.

    A rare language is taken whole; the rows of one language are at most twice the bound. Texts stay with the executors.
    """
    own = docs.where(F.col("lang").isNotNull()).withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}
    if not sizes:
        return []
    low, span = -(2**63), float(2**64)
    bound = {k: low + int(min(1.0, 1.2 * each / n) * (span - 2**12)) if n > each else 2**63 - 1 for k, n in sizes.items()}
    top = F.create_map(*[F.lit(x) for kv in bound.items() for x in kv])
    some = own.where(F.col("h") <= F.try_element_at(top, F.col("lang"))).select("lang", "h", F.col("text").cast("string"))
    kept: dict[str, int] = {}
    out = []
    for r in sorted(some.mapInArrow(_features, "lang string, h long, packed binary").collect(), key=lambda r: (r["h"], r["lang"], bytes(r["packed"]))):
        kept[r["lang"]] = kept.get(r["lang"], 0) + 1
        if kept[r["lang"]] <= 2 * each:
            out.append((r["lang"], *unpacked(r["packed"])))
    return out


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_langs: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal: weights [DIMS + 1, language]; coordinate DIMS is the bias, without L1."""
    z, n = np.zeros((DIMS + 1, n_langs)), np.zeros((DIMS + 1, n_langs))
    order = np.random.default_rng(7)

    def weights(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], n[at]
        pen = np.where(at == DIMS, 0.0, l1)[:, None]
        return np.where(np.abs(zz) <= pen, 0.0, -(zz - np.sign(zz) * pen) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], DIMS), np.append(rows[i][1], 1.0)
            w = weights(at)
            p = probabilities((x @ w)[None])[0]
            p[y[i]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(DIMS + 1))
    return w[:DIMS], w[DIMS]


def calibrate(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    loss = lambda t: -np.log(np.maximum(probabilities(z, float(np.exp(t)))[np.arange(len(y)), y], 1e-12)).mean()
    low, high, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, each: int = 500) -> Model | None:
    """docs: doc_id, text, lang, training rows only. each bounds the sample of a language; document frequencies cover all rows."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = sample(docs, each)
    if not rows:
        return None
    df, total = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + df)) + 1
    scale = 30.0
    langs = sorted({lang for lang, _, _ in rows})
    y = np.array([langs.index(lang) for lang, _, _ in rows])
    made = [(at, n / n.sum() * idf[at] * scale) for _, at, n in rows]
    held = np.arange(len(rows)) % 5 == 4
    held &= len(rows) >= 20
    w, bias = ftrl([m for m, h in zip(made, held, strict=True) if not h], y[~held], len(langs))
    model = Model(langs, np.rint(w * idf[:, None] * scale * UNIT).astype(np.int64), bias, 1.0)
    if held.any():
        model.temperature = calibrate(np.array([x @ w[at] + bias for (at, x), h in zip(made, held, strict=True) if h]), y[held])
    return model


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in [whole.slice(i, 256) for i in range(0, whole.num_rows, 256)]:
                texts = batch.column(2).to_pylist()
                known = [i for i, t in enumerate(texts) if model and has_letter(t)]
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                if model and known:
                    p = probabilities(logits([texts[i] for i in known], model), model.temperature)
                    for i, k, s in zip(known, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                        lang[i], score[i] = model.langs[k], min(s, 1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs: doc_id, held_out, text. One narrow pass; the model is bounded by coordinates times languages."""
    ship(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    return predict(docs, train(docs.where(~F.col("held_out"))))
