"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

Gradient-boosted shallow trees on binned statistics give paths; each path becomes a conjunctive rule; a logistic regression
with lasso penalty weighs the rules, and those with weight become Column expressions, so that scoring is one narrow
pass without Python. Training uses a bounded sample of labelled rows (train_rows) and the statistics of whole texts.

A null text has the statistics of the empty text; rows with null labels aren't learned from; repeated rows each get the same
row; an empty table gives no rows; without labels of both kinds the score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table
from .rules import MORE, STATS, statistics

RATIOS = ("words", "mean_length", "symbols", "marks", "capitals", "ends", "dup_lines", "lines", "repeats", "variety")


def ratios(prefix: str = "") -> dict[str, Column]:
    c = {k: F.col(f"{prefix}{k}").cast("double") for k in (*STATS, *MORE)}
    some, chars, lines = (F.greatest(c[k], F.lit(1.0)) for k in ("n_words", "word_chars", "n_lines"))
    made = (c["n_words"], c["word_chars"] / some, c["n_symbols"] / some, c["n_marks"] / some, c["n_upper"] / chars, c["n_ends"] / some, c["n_dup_lines"] / lines, c["n_lines"] / some, c["n_repeat_words"] / some, c["n_distinct"] / some)
    return dict(zip(RATIOS, made, strict=True))


@dataclass(frozen=True)
class Rule:
    """Conditions (feature, low, high): low < x <= high, all of which must hold."""

    conditions: tuple[tuple[int, float, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, low, high in self.conditions:
            out &= (x[:, f] > low) & (x[:, f] <= high)
        return out

    def column(self, features: list[Column]) -> Column:
        out = F.lit(True)
        for f, low, high in self.conditions:
            if np.isfinite(low):
                out = out & (features[f] > float(low))
            if np.isfinite(high):
                out = out & (features[f] <= float(high))
        return out


@dataclass
class Ensemble:
    bias: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((w * r.holds(x) for w, r in zip(self.weights, self.rules, strict=True)), np.zeros(len(x)))

    def column(self, features: list[Column]) -> Column:
        z = F.lit(self.bias)
        for w, r in zip(self.weights, self.rules, strict=True):
            z = z + F.when(r.column(features), float(w)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """One regression tree on gradients: the rules of all its nodes, and its output for each row."""
    out, rules = np.zeros(len(x)), []

    def node(rows: np.ndarray, box: dict[int, tuple[float, float]], level: int) -> None:
        if box:
            rules.append(Rule(tuple((f, *b) for f, b in sorted(box.items()))))
        best = (1e-9, -1, -1)
        if level < depth and len(rows) >= 2 * least:
            total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = bins[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, v, len(e) + 1))[:-1] for v in (g[rows], h[rows], None))
                gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - total
                gain[(ns < least) | (len(rows) - ns < least)] = 0
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), f, k))
        _, f, k = best
        if f < 0:
            out[rows] = -g[rows].sum() / (h[rows].sum() + 1)
            return
        cut, (low, high) = float(edges[f][k]), box.get(f, (-np.inf, np.inf))
        left = bins[rows, f] <= k
        node(rows[left], box | {f: (low, min(high, cut))}, level + 1)
        node(rows[~left], box | {f: (max(low, cut), high)}, level + 1)

    node(np.arange(len(x)), {}, 0)
    return rules, out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradients; the bias is free."""
    a1 = np.column_stack([np.ones(len(a)), a])
    step = 4 * len(y) / max(np.linalg.norm(a1, 2) ** 2, 1e-9)
    w = v = np.zeros(a1.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = v - step * (a1.T @ (sigmoid(a1 @ v) - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (old - 1) / t * (new - w), new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 10, penalty: float = 5e-4) -> Ensemble:
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Ensemble(float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 49))) for c in x.T]
    bins = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[Rule, None] = {}
    for _ in range(trees):
        p = sigmoid(z)
        rules, out = grow(x, bins, edges, p - y, p * (1 - p), depth, min(least, max(1, len(y) // 20)))
        z += rate * out
        found |= dict.fromkeys(rules)
    seen, rules, columns = set(), [], []
    for r in found:  # rules that hold for the same rows are one
        c = r.holds(x)
        if (k := c.tobytes()) not in seen and 0 < c.sum() < len(c):
            seen.add(k)
            rules.append(r)
            columns.append(c)
    if not rules:
        return Ensemble(float(z[0]))
    bias, w = lasso(np.column_stack(columns).astype(float), y, penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-4)
    return Ensemble(bias, [rules[i] for i in keep], [float(w[i]) for i in keep])


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, train_rows: int, folds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most train_rows labelled documents outside fold 0, those of the smallest id hashes.

    The sample is bounded, so that its ids are broadcast to the one scan of the texts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where(F.col("label").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != 0))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    rows = statistics(some, "text").select("label", *ratios().values()).toPandas().to_numpy(float)
    rows = rows[np.lexsort(rows.T)] if len(rows) else rows.reshape(0, 1 + len(RATIOS))
    return rows[:, 1:], rows[:, 0]


def score(docs: DataFrame, model: Ensemble, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every document."""
    given = docs.select("doc_id", "text")
    found = statistics(given, "text").select("doc_id", *[c.alias(k) for k, c in ratios().items()])
    found = found.select("doc_id", model.column([F.col(k) for k in RATIOS]).alias("score"))
    return found.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_rulefit(spark: SparkSession, sf_dir: str, train_rows: int = 10_000) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(*training_rows(docs, table(spark, sf_dir, "labels"), "quality", train_rows))
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
