"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans (email, ip, card, phone). The field then labels the candidate tokens of each
document: a candidate holds a digit or an at sign; every other token is fixed to "no personal data", which splits the chain
there and keeps the graph as small as the document's candidates. Neighbouring candidates share a chain edge; candidates
that repeat the same normal form (letters and digits only) or, with seven or more digits, the same trailing digits
share skip edges, so that evidence at one place carries to the others. Tokens count whole, however long they are. Sum-product messages run round these loops;
a run of tokens with the same label of enough posterior probability, outside the base spans, becomes an added span.

Unary weights are a multinomial logistic regression, chain and skip potentials smoothed log ratios, all fitted on a bounded
sample of documents (train_rows) of any length that the base patterns label; executors count them, and the driver gets counts only. Defined results: null or empty text has no spans; repeated
rows each give the same row; an empty table gives no rows; a corpus without personal data gives a field that adds nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, ship, smallest_hashes, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: Lookbehinds and possessive repeats keep each scan linear; they skip only starts at which the contract's pattern can't match first.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"\S+")
HAS = re.compile(r"[0-9@]")
NO_DIGITS = {ord(c): None for c in "0123456789"}
EDGE = "\"'`.,;:!?#*$%&|<>[]{}()~^=/\\_-"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the local part is the longest run before an at sign, as far as the last match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, last := m.end()))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    if not HAS.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-3:]) < 256 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


@dataclass
class Field:
    """Potentials as logarithms: unary [feature, label], chain [label, label], skip: the bonus for equal labels."""

    unary: np.ndarray
    chain: np.ndarray
    skip: float


N_FEATURES = 30


def n_digits(text: str) -> int:
    return len(text) - len(text.translate(NO_DIGITS))


def features(token: str, before: str, after: str) -> list[int]:
    """Indices of the binary features of a token; what its neighbours look like counts, its place doesn't."""
    core = token.strip(EDGE)
    digits = n_digits(token)
    letters = sum(map(str.isalpha, core))
    dots = core.count(".")
    at = core.find("@")
    out = [0, 1 + min(digits, 16) // 2]
    if at > 0:
        out.append(10 + (dots > 0 and "." in core[at:]))
    elif "@" in token:
        out.append(12)
    if dots == 3 and digits and not letters:
        out.append(13)
    if token.lstrip("\"'(").startswith("+"):
        out.append(14)
    if token.startswith("(") and digits == 3:
        out.append(15)
    if "-" in core and not letters:
        out.append(16)
    if digits == len(core) == 4:
        out.append(17)
    if digits == len(core):
        out.append(18)
    if letters and digits:
        out.append(19)
    if letters > 8:
        out.append(20)
    d_before, d_after = n_digits(before), n_digits(after)
    out.append(21 if not d_before else 22 if d_before < 4 else 23)
    out.append(24 if not d_after else 25 if d_after < 4 else 26)
    if before.startswith("+"):
        out.append(27)
    if d_after == 7 and "-" in after:
        out.append(28)
    if dots > 3 or dots in (1, 2):
        out.append(29)
    return out


@dataclass
class Graph:
    """Candidates of many documents at once: rows are nodes, edges join nodes of the same document only."""

    spans: list[tuple[int, int, int]]  # document, start, end
    feats: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def graph(texts: list[str | None]) -> Graph:
    g = Graph([], [], [], [])
    for d, text in enumerate(texts):
        if not text or not HAS.search(text):
            continue
        found = [(m.start(), m.end()) for m in TOKEN.finditer(text) if HAS.search(text, m.start(), m.end())]
        seen: dict[str, int] = {}
        for i, (s, e) in enumerate(found):
            node, token = len(g.spans), text[s:e]
            before = text[found[i - 1][0] : found[i - 1][1]] if i and s - found[i - 1][1] <= 2 else ""
            after = text[found[i + 1][0] : found[i + 1][1]] if i + 1 < len(found) and found[i + 1][0] - e <= 2 else ""
            g.spans.append((d, s, e))
            g.feats.append(features(token, before, after))
            if before:
                g.chain.append((node - 1, node))
            form = "".join(c for c in token.lower() if c.isalnum())
            digits = "".join(c for c in form if "0" <= c <= "9")
            for key in {form, *([f"#{digits[-7:]}"] if len(digits) >= 7 else [])}:
                if len(key) > 3:
                    if key in seen and (seen[key], node) not in g.skip[-2:]:
                        g.skip.append((seen[key], node))
                    seen[key] = node
    return g


def matrix(feats: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(feats), N_FEATURES), np.float32)
    for i, f in enumerate(feats):
        x[i, f] = 1
    return x


def token_labels(g: Graph, base: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Label of each node: the base span that it shares a character with."""
    out = np.zeros(len(g.spans), np.int64)
    at, doc = 0, -1
    for i, (d, s, e) in enumerate(g.spans):
        if d != doc:
            at, doc = 0, d
        while at < len(base[d]) and base[d][at][2] <= s:
            at += 1
        if at < len(base[d]) and base[d][at][0] < e:
            out[i] = 1 + base[d][at][1]
    return out


@dataclass
class Evidence:
    """What a field is fitted on: how often each set of features bears each label, labels at the ends of chain edges, and of skip edges."""

    nodes: Counter  # (features, label)
    chain: Counter  # (label, label)
    skip: Counter  # whether the labels are equal

    def rows(self) -> list[tuple[int, str, int]]:
        """(kind, key, count), as add() takes them back."""
        return [(i, " ".join(map(str, (*k[0], k[1]) if i == 0 else k)), n) for i, c in enumerate((self.nodes, self.chain, self.skip)) for k, n in c.items()]

    def add(self, kind: int, key: str, n: int) -> None:
        parts = tuple(map(int, key.split()))
        (self.nodes, self.chain, self.skip)[kind][(parts[:-1], parts[-1]) if kind == 0 else parts] += n


def evidence(texts: list[str]) -> Evidence:
    g = graph(texts)
    y = token_labels(g, [base_spans(t) for t in texts]).tolist()
    return Evidence(Counter(zip(map(tuple, g.feats), y, strict=True)), Counter((y[a], y[b]) for a, b in g.chain), Counter((int(y[a] == y[b]),) for a, b in g.skip))


def fit(found: Evidence, rounds: int = 200, rate: float = 1.0, penalty: float = 1e-3) -> Field:
    """Weights from the labels that the base patterns gave."""
    k = len(LABELS)
    unary = np.zeros((N_FEATURES, k))
    unary[0, 0] = 4.0
    chain, skip = np.zeros((k, k)), 0.0
    if found.nodes:
        known = sorted(found.nodes.items())
        n = np.array([c for _, c in known], float)[:, None]
        x, goal = matrix([f for (f, _), _ in known]).astype(float), np.eye(k)[[y for (_, y), _ in known]]
        for _ in range(rounds):
            z = x @ unary
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            unary -= rate * (x.T @ (n * (p - goal)) / n.sum() * 4 + penalty * unary)
        if found.chain:
            pairs = np.full((k, k), 0.5)
            for (a, b), c in found.chain.items():
                pairs[a, b] += c
            share = pairs / pairs.sum()
            chain = np.clip(0.5 * np.log(share / (share.sum(1, keepdims=True) * share.sum(0, keepdims=True))), -2, 2)
        if found.skip:
            same = (found.skip[(1,)] + 1) / (sum(found.skip.values()) + 2)
            skip = float(np.clip(np.log(same / (1 - same)), 0.5, 3))
    return Field(unary, chain, skip)


def posteriors(g: Graph, field: Field, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Loopy sum-product: [node, label] beliefs. Messages are kept as normalised logarithms."""
    n, k = len(g.spans), len(LABELS)
    local = matrix(g.feats) @ field.unary
    edges = np.array(g.chain + g.skip, np.int64).reshape(-1, 2)
    if len(edges):
        pair = np.concatenate([np.broadcast_to(field.chain, (len(g.chain), k, k)), np.broadcast_to(np.eye(k) * field.skip, (len(g.skip), k, k))])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pot = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        said = np.zeros((len(source), k))
        for _ in range(rounds):
            belief = local.copy()
            np.add.at(belief, target, said)
            z = (belief[source] - said[back])[:, :, None] + pot
            top = z.max(1, keepdims=True)
            new = top[:, 0] + np.log(np.exp(z - top).sum(1))
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - said).max()
            said = damping * said + (1 - damping) * new
            if moved < 1e-3:
                break
        np.add.at(local, target, said)
    p = np.exp(local - local.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True) if n else p


#: What a run of tokens must hold to become a span of its kind.
def fits(kind: int, text: str) -> bool:
    digits = sum("0" <= c <= "9" for c in text)
    if kind == 0:
        return 0 < text.find("@") < len(text) - 1
    if any(c.isalpha() for c in text):
        return False
    return digits >= 4 and text.count(".") == 3 if kind == 1 else 12 <= digits <= 19 if kind == 2 else 9 <= digits <= 15


def spans_of(texts: list[str | None], field: Field, least: float = 0.5) -> tuple[list, list]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) if t else [] for t in texts]
    g = graph(texts)
    every = [list(b) for b in base]
    if g.spans:
        p = posteriors(g, field)
        label = np.where(p.max(1) >= least, p.argmax(1), 0)
        linked = {b: a for a, b in g.chain}
        hit = np.flatnonzero((label > 0) & (token_labels(g, base) == 0))
        runs: list[list[int]] = []
        for i in hit.tolist():
            if runs and linked.get(i) == runs[-1][-1] and label[i] == label[runs[-1][-1]]:
                runs[-1].append(i)
            else:
                runs.append([i])
        for run in runs:
            d, s, e = g.spans[run[0]][0], g.spans[run[0]][1], g.spans[run[-1]][2]
            text = texts[d] or ""
            while s < e and text[s] in EDGE.replace("(", ""):
                s += 1
            while s < e and text[e - 1] in EDGE.replace(")", ""):
                e -= 1
            kind = int(label[run[0]]) - 1
            if s < e and fits(kind, text[s:e]):
                every[d].append((s, kind, e))
    return base, [sorted(x) for x in every]


def _find(field: Field, redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in [whole.slice(i, 512) for i in range(0, whole.num_rows, 512)]:
                texts = batch.column(0).to_pylist()
                base, every = spans_of(texts, field)
                columns = [pa.array([sum(k == j for _, k, _ in b) for b in base], pa.int64()) for j in range(4)]
                columns += [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]), pa.array([joined(x) for x in every])]
                names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
                if redact:
                    columns, names = [pa.array([hidden(t, x) for t, x in zip(texts, every, strict=True)], pa.string())], [batch.schema.names[0]]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*batch.schema.names[1:], *names])

    return run


def hidden(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            rows = evidence([text.as_py()]).rows()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64()))], names=["kind", "key", "n"])


def train(docs: DataFrame, text_col: str = "text", train_rows: int = 800) -> Field:
    """Fits the field on at most 2 * train_rows documents that hold a candidate. The driver gets a row for each distinct set of features and label."""
    text = F.col(f"`{text_col}`").cast("string")
    some = smallest_hashes(docs.select(text.alias("t")).where(F.col("t").rlike("[0-9@]")), F.xxhash64("t"), train_rows)
    found = Evidence(Counter(), Counter(), Counter())
    for kind, key, n in some.mapInArrow(_evidence, "kind int, key string, n long").groupBy("kind", "key").agg(F.sum("n")).collect():
        found.add(kind, key, n)
    return fit(found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None, **training) -> DataFrame:
    """One row per document: doc_id, counts of base spans by kind, digest of the base spans, and all spans."""
    ship(docs.sparkSession)
    field = field or train(docs, text_col, **training)
    given = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    return given.mapInArrow(_find(field, False), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text", field: Field | None = None, **training) -> DataFrame:
    """docs with every span in its text replaced by the kind in brackets; all columns stay."""
    ship(docs.sparkSession)
    field = field or train(docs, text_col, **training)
    own = free_name(docs, "hidden")
    rest = [c for c in docs.columns if c != text_col]
    given = docs.select(F.col(f"`{text_col}`").cast("string").alias(own), *[F.col(f"`{c}`") for c in rest])
    schema = given.select(*[F.col(f"`{c}`") for c in rest], F.col(own)).schema
    done = given.mapInArrow(_find(field, True), schema)
    return done.select(*[F.col(own).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
