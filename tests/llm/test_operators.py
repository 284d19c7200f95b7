"""The text operators against brute force, round trips and held-out accuracy; nulls, empty and long texts, ties, empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lidarloom.llm import bpe, catalogue, components, langid, multiindex, packing, pii, rulefit, rules, simhash, suffixes, windows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
ODD = [(1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, "x", "en"), (5, "word " * 30000, "en"), (6, "same text here now", "en"), (7, "same text here now", "en"), (7, "same text here now", "en"), (None, "no id at all", None), (9, "é" * 5000, "fr")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"h": F.lit(1), "keep_id": F.lit("clash"), "w_doc": F.lit(2), "stat_n_words": F.lit(3), "hidden": F.lit(4), "kept": F.lit(True)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe(docs, texts):
    enc = bpe.encoding(bpe.rank_path(), bpe.default_pattern())
    rows = bpe.encode_documents(docs).collect()
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.decoded == texts[r.doc_id].encode() and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    text = "it's  a\n\n  test 123 — 'll \t" * 400
    assert [i for p in bpe.parts(text, 50) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text) and len(list(bpe.parts(text, 50))) > 50


def slow_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii(docs, texts, odd, empty):
    random.seed(1)
    for _ in range(5000):
        t = "".join(random.choice("ab@..1234+ -()é_") for _ in range(random.randint(0, 40)))
        assert slow_spans(t) == pii.base_spans(t)
    for r in pii.find(docs).collect():
        base = slow_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest() and (r.n_email, r.n_phone) == (sum(k == 0 for _, k, _ in base), sum(k == 3 for _, k, _ in base))
        assert set(pii.joined(base).split(",")) <= set(r.spans.split(","))
    field = pii.fit(pii.evidence([f"call +1 (743) 555-{i:04d} or mail user{i}@mail.example.com or 10.0.{i % 250}.1 now" for i in range(60)]))
    text = "first +1 (743) 555-3824 and later 743-555-3824 again"
    base, every = pii.spans_of([text], field)
    assert len(base[0]) == 1 and {text[s:e] for s, _, e in every[0]} == {"+1 (743) 555-3824", "743-555-3824"}
    assert pii.hidden(text, every[0]) == "first [PHONE] and later [PHONE] again"
    assert pii.redacted(odd).columns == odd.columns and pii.redacted(odd).count() == len(ODD)
    rows = {r.doc_id: r for r in pii.find(odd, field=field).collect()}
    assert len(pii.find(odd, field=field).collect()) == len(ODD) and rows[1].spans == rows[2].spans == "" and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(empty).count() == 0 and pii.train(empty).skip == 0
    # Whole tokens count: evidence behind thousands of characters, and long runs without blanks take linear time.
    assert pii.features("a" * 5000 + "1234", "", "") != pii.features("a" * 5000, "", "")
    began = time.process_time()
    for run in ("a" * 2_000_000 + " 1", "a1" * 1_000_000, "日" * 2_000_000 + "7", "1" * 2_000_000, "a@" * 500_000):
        assert len(pii.graph([run]).spans) == 1 and len(pii.spans_of([run], field)[0][0]) <= 1
    assert time.process_time() - began < 60


def test_pii_marginals():
    """Sum-product on a chain with one skip edge that closes no loop equals enumeration of all labellings."""
    g = np.random.default_rng(4)
    k = len(pii.LABELS)
    field = pii.Field(g.normal(size=(pii.N_FEATURES, k)), g.normal(size=(k, k)), 1.2)
    graph = pii.Graph([(0, 0, 1)] * 4, [[0, 2], [0, 5], [0, 7, 9], [0, 3]], [(0, 1), (2, 3)], [(1, 2)])
    local = pii.matrix(graph.feats) @ field.unary
    want = np.zeros((4, k))
    for y in itertools.product(range(k), repeat=4):
        w = np.exp(sum(local[i, y[i]] for i in range(4)) + field.chain[y[0], y[1]] + field.chain[y[2], y[3]] + field.skip * (y[1] == y[2]))
        for i in range(4):
            want[i, y[i]] += w
    want /= want.sum(1, keepdims=True)
    assert pii.posteriors(graph, field, rounds=60) == pytest.approx(want, abs=5e-3)


def test_rules(docs, texts, odd, empty, spark):
    for r in rules.score(docs).collect():
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(g)
        marked = {j for i, x in enumerate(g) if n[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked))
        assert r.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w)) and not (r.base_failed and r.kept)
    found = rules.score(docs).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed")
    assert found.where("kept = (quality = 1)").count() >= 0.95 * found.count()
    assert rules.score(odd).count() == len(ODD) and rules.score(empty).count() == 0 and rules.keep_good(empty).count() == 0
    assert rules.keep_good(odd).columns == odd.columns


def test_rulefit(spark, docs, odd):
    for size, least in (("0.01", 0.9), ("0.1", 0.97)):  # 320 and 3,160 labels to learn from
        d = f"/root/testdata/sf{size}"
        found = rulefit.op5_rulefit(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
        assert found.where("predicted = quality").count() >= least * found.count()
    x, y = np.random.default_rng(1).normal(size=(400, len(rulefit.RATIOS))), None
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    model = rulefit.fit(x, y)
    assert ((rulefit.sigmoid(model.margin(x)) > 0.5) == y).mean() > 0.95
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], list(rulefit.RATIOS))
    assert [r[0] for r in frame.select(model.column([F.col(k) for k in rulefit.RATIOS])).collect()] == pytest.approx(rulefit.sigmoid(model.margin(x[:50])).tolist())
    assert rulefit.score(odd, model).count() == len(ODD) and rulefit.fit(x[:0], y[:0]).bias == 0


def test_langid(spark, odd, empty):
    d = "/root/testdata/sf0.01"
    found = langid.op4_langid(spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id")
    assert found.where("lang_pred = lang").count() >= 0.97 * found.count()
    made = odd.withColumn("held_out", F.lit(True)).select("doc_id", "held_out", "text")
    rows = {r.doc_id: r for r in langid.predict(made, langid.train(odd)).collect()}
    assert (rows[1].lang_pred, rows[2].lang_pred, rows[3].score) == ("und", "und", 0.0) and rows[9].lang_pred in ("en", "fr")
    assert langid.predict(made.limit(0), langid.train(empty)).count() == 0 and langid.train(empty) is None
    g = np.random.default_rng(0)
    model = langid.Model(["a", "b", "c"], np.rint(g.normal(size=(langid.DIMS, 3)) * langid.UNIT).astype(np.int64), np.array([0.1, -0.2, 0.0]), 1.3)

    def slow(text):
        low = text.lower()
        found = [low[i : i + n] for n in langid.ORDERS for i in range(len(low) - n + 1)]
        total = sum(model.weights[int(langid.hashes(langid.codes(x), len(x))[0])] for x in found)
        return (total / langid.UNIT / len(found) + model.bias).tolist()

    texts = ["a", "ab", "the cat", "ΣΑΣ İs", "x\0\0y \0", "日本語 text", "é" * 700, "the cat sat " * 90]
    want = [slow(t) for t in texts]
    assert langid.logits(texts, model) == pytest.approx(np.array(want), abs=1e-9)
    for _ in range(20):  # any order, neighbours and size of the parts
        order = g.permutation(len(texts)).tolist()
        size, langid.WINDOW = langid.WINDOW, int(g.integers(1, 900))
        try:
            got = langid.logits([texts[i] for i in order], model).tolist()
        finally:
            langid.WINDOW = size
        assert got == langid.logits(texts, model)[order].tolist()
    alone = {t: langid.logits([t], model)[0].tolist() for t in texts}
    assert all(alone[t] == row for t, row in zip(texts, langid.logits(texts, model).tolist(), strict=True))
    long = "the cat " * 300_000
    assert langid.logits([long], model)[0] == pytest.approx(langid.logits(["the cat " * 100], model)[0], abs=1e-2)


def test_langid_row_order(spark):
    """The same documents in other orders and partitions have the same scores."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", F.lit(True).alias("held_out"))
    model = langid.train(d)
    first, second = ({r.doc_id: (r.lang_pred, r.score) for r in langid.predict(x, model).collect()} for x in (d, d.repartition(5).orderBy(F.desc("doc_id"))))
    assert first == second and len(first) == 1000


def components_of(nodes, edges):
    root = {n: n for n in nodes}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def test_components(spark):
    random.seed(5)
    edges = [(i, i + 1) for i in range(40)] + [(random.randint(100, 160), random.randint(100, 160)) for _ in range(40)] + [(200, 200 + i) for i in range(30)] + [(7, None), (9, 9)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components_of({x for e in edges for x in e if x is not None}, [e for e in edges if None not in e])
    assert all(got.get(n, n) == r for n, r in want.items())


@pytest.mark.parametrize("radius", [2, 3, 5])
def test_simhash_kernel(spark, radius):
    random.seed(radius)
    base = [random.getrandbits(64) for _ in range(5)]
    fps = sorted({b ^ sum(1 << k for k in random.sample(range(64), random.randint(0, 5))) for b in base for _ in range(40)})
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    assert components_of(range(len(fps)), simhash.links(fps, radius, tuple(range(64)))) == components_of(range(len(fps)), pairs)
    frame = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    for rows in (16, 256) if radius == 2 else (256,):  # small buckets take the way of hot ones
        got = [(r.a, r.b) for r in simhash.near(frame, radius, bucket_rows=rows).collect()]
        signed = [simhash.signed(f) for f in fps]
        assert components_of(signed, got) == components_of(signed, [(signed[i], signed[j]) for i, j in pairs])


def test_simhash(docs, texts, odd, empty):
    fps = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        fps[i] = sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))
    want = components_of(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    for r in simhash.classes(docs).collect():
        assert int(r.fingerprint, 16) == fps[r.doc_id] and r.component_id == want[r.doc_id]
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "9", "None"]
    assert simhash.classes(empty).count() == 0


def test_jaccard(spark, odd, empty):
    """Near copies from 0.7 to 0.95, chains, a family of variants whose values fill several blocks."""
    import corpus_pipeline
    from lidarloom.llm import jaccard

    random.seed(6)
    voc = ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    rows = []
    for _ in range(40):
        w = [random.choice(voc) for _ in range(random.randint(60, 400))]
        for _ in range(4):  # each an edit of the one before
            rows.append(" ".join(w))
            for k in random.sample(range(len(w)), max(1, len(w) // random.choice((40, 60, 120)))):
                w[k] = random.choice(voc)
    w = [random.choice(voc) for _ in range(150)]
    for _ in range(60):
        rows.append(" ".join(random.choice(voc) if random.random() < 0.02 else x for x in w))
    rows = [(i, t) for i, t in enumerate(rows)] + [(900, rows[5])]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = components_of(sets, edges)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(i for i in sets if root[i] == i)
    assert len(edges) > 100 and 40 < len(want) < len(rows) - 60
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, SF).collect()) == want
    assert sorted(r.doc_id for r in jaccard.keep_one(frame, block_rows=8).collect()) == want
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "9", "None"]
    assert jaccard.keep_one(empty).count() == 0


def test_near_duplicates_by_simhash(spark):
    """SimHash alone brings the close copies; sets without a shingle meet nothing."""
    from lidarloom.llm import jaccard

    g = random.Random(44)
    rows = []
    for _ in range(30):
        w = ["".join(g.choice("abcdefgh") for _ in range(7)) for _ in range(400)]
        rows += [" ".join(w), " ".join([*w[:-1], "other"])]
    texts = [*rows, "", None]
    prints = [(jaccard.set_name(jaccard.shingle_set(t, 5)), [1] if t else [], simhash.signed(simhash.fingerprint(simhash.shingle_hashes(t, 5)))) for t in texts]
    firsts = spark.createDataFrame(prints, "fp long, bands array<long>, sim long").dropDuplicates(["fp"])
    got = {(r.a, r.b) for r in jaccard.sim_pairs(firsts).collect()}
    close = [(a, b) for a, b in zip(prints[0:60:2], prints[1:60:2], strict=True) if ((a[2] ^ b[2]) & (2**64 - 1)).bit_count() <= jaccard.RADIUS]
    assert len(close) > 20 and got == {(max(a[0], b[0]), min(a[0], b[0])) for a, b in close}
    kept = jaccard.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 60, 2), 60]


def test_keep_one_ids(spark):
    """Null and repeated ids: no document without a duplicate is lost, and of copies one stays."""
    from lidarloom.llm import jaccard

    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, words(1)), (None, words(2)), (7, words(3)), (7, words(4)), (7, words(4)), (8, words(4)), (9, words(1)), (None, words(2)), (10, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"made": F.lit(1), "several": F.lit(2), "head_fp": F.lit(3), "keep_fp": F.lit(4)})
    want = sorted([(7, words(3)), (7, words(4)), (9, words(1)), (None, words(2)), (10, None)], key=str)
    for kept in (jaccard.keep_one(frame), simhash.keep_one(frame)):
        assert kept.columns == frame.columns and sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == want


def test_suffix_order():
    random.seed(4)
    for memory in (0, 64, 1 << 30):
        for _ in range(60):
            t = np.array([random.randint(0, 3) for _ in range(random.randint(1, 60))], np.int16)
            assert suffixes.suffix_order(t, 100, memory).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_suffixes(spark, empty):
    random.seed(2)
    rows = [(1, "ab" * 300), (2, None), (3, ""), (4, "x" * 99), (5, "x" * 100), (6, "x" * 150), (7, "ab" * 60 + "q" + "é" * 80), (7, "ab" * 60 + "q" + "é" * 80)]
    shared = ["".join(random.choice("abcd ") for _ in range(400)) for _ in range(3)]
    for i in range(8, 50):
        p, s = random.choice(shared), random.randint(0, 250)
        rows.append((i, "".join(random.choice("abcd ") for _ in range(random.randint(0, 90))) + p[s : s + random.randint(80, 150)] + random.choice(["", "zz", p[:130]])))
    seen: dict = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 99):
            seen[b[i : i + 100]] = min(seen.get(b[i : i + 100], (d, i)), (d, i))
    want = {}
    for d, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            if seen[b[i : i + 100]] < (d, i):
                mask[i : i + 100] = True
        want[d] = (len(b), int(mask.sum()), int((np.diff(np.append(0, mask.astype(int))) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest())
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for shard in (4 << 20, 4000, 300):  # small shards: anchors are split, down to single windows
        got = suffixes.dedup(frame, shard_bytes=shard).collect()
        assert len(got) == len(rows) and all(want[r.doc_id] == (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert suffixes.dedup(empty).count() == 0


def test_suffixes_frequent_line(spark, odd):
    """A line in thousands of contexts: shards stay small, results are those of brute force; clashing names and null ids do no harm."""
    random.seed(3)
    line = "the one line of fifty characters that all texts have"
    letters = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    ends = [letters(60) for _ in range(25)]
    rows = [(i if i % 50 else None, random.choice(ends) + line + random.choice(ends)) for i in range(1500)]
    seen: dict = {}
    key = lambda d: -(2**63) if d is None else d
    for d, t in rows:
        for i in range(len(t) - 99):
            seen[t[i : i + 100]] = min(seen.get(t[i : i + 100], (key(d), i)), (key(d), i))
    want = Counter()
    for d, t in rows:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - 99):
            if seen[t[i : i + 100]] < (key(d), i):
                mask[i : i + 100] = True
        want[d, int(mask.sum()), "".join(c for c, m in zip(t, mask, strict=True) if not m)] += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.dedup(frame.withColumns({"twin": F.lit(1), "spans": F.lit(2), "h": F.lit(3)}), shard_bytes=3000).collect()
    assert Counter((r.doc_id, r.n_removed, bytes(r.kept).decode()) for r in got) == want
    assert suffixes.halves(7) == [(i, i) for i in range(suffixes.SPOTS)] and suffixes.dedup(odd).count() == len(ODD)


def test_windows(spark, odd, empty):
    random.seed(2)
    v = np.array([random.randint(0, 10**9) for _ in range(150)])
    found = windows.compact_windows(v, 46)
    for i in range(150):
        for j in range(i + 45, 150):
            held = [w for w in found if w[0] <= i <= w[1] <= j <= w[2]]
            assert len(held) == 1 and held[0][1] == i + int(v[i : j + 1].argmin())
    began = time.process_time()
    for v in (np.zeros(2_000_000, np.uint64), np.arange(2_000_000, dtype=np.uint64) % 7):
        assert windows.compact_windows(v, 46)[0] == (0, 0, len(v) - 1)
    assert time.process_time() - began < 20
    voc = ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    para = lambda n: [random.choice(voc) for _ in range(n)]
    p, q, rows = para(80), para(120), []
    for i in range(40):
        w = para(random.randint(30, 200))
        w = w[:20] + p + w[20:] if i in (3, 9, 17) else w + q if i in (5, 25) else w
        if i == 30:
            w = q[:40] + ["zzz"] + q[41:90] + ["yyy"] + q[91:] + w
        rows.append((i, " ".join(w)))
    got = {(r.doc, r.start_word, r.end_word, r.source_doc) for r in windows.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(9, 20, 100, 3), (17, 20, 100, 3)} <= got and {(d, s) for d, _, _, s in got} == {(9, 3), (17, 3), (17, 9), (25, 5), (30, 5), (30, 25)}
    left = {r.doc_id: r.text.split() for r in windows.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[3] == rows[3][1].split() and left[9] == rows[9][1].split()[:20] + rows[9][1].split()[100:]
    assert windows.without_passages(odd).columns == odd.columns and windows.without_passages(odd).count() == len(ODD) and windows.find(empty).count() == 0


def test_windows_inserted_sentence(spark):
    """A passage of 98 words with 14 words put into its middle: 90 of 112 shingles are shared."""
    random.seed(12)
    para = lambda n: ["".join(random.choice("abcdefgh") for _ in range(8)) for _ in range(n)]
    p = para(98)
    rows = [(1, para(70) + p + para(30)), (2, para(40) + p[:49] + para(14) + p[49:] + para(60)), (3, para(9) + p + para(20) + p[:60] + para(5))]
    got = {(r.doc, r.start_word, r.end_word, r.source_doc, round(r.similarity, 3)) for r in windows.find(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"), hashes=16, agree=1).collect()}
    assert {(2, 40, 152, 1, round(90 / 112, 3)), (3, 9, 107, 1, 1.0), (3, 127, 187, 1, 1.0)} <= got


def test_windows_template(spark):
    """Exact copies amid variants of one template: in each family two of sixty documents, neither first nor neighbours, hold the same passage."""
    random.seed(21)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(8))
    rows, copies = [], []
    for f in range(12):
        p = [word() for _ in range(80)]
        at = sorted(random.sample(range(5, 60), 2))
        own = None
        for i in range(60):
            q = list(p)
            for k in random.sample(range(80), 5):
                q[k] = word()
            if i in at:
                q = own = own or q
            rows.append((100 * f + i, " ".join([word() for _ in range(20)] + q + [word() for _ in range(20)])))
        copies.append((100 * f + at[1], 100 * f + at[0]))
    got = {(r.doc, r.source_doc) for r in windows.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.similarity > 0.95}
    assert sum(c in got for c in copies) >= 11


def test_windows_near_copies_amid_variants(spark):
    """Values of many windows: near copies that lie between variants unlike both are joined, in one block and in several; copies take one pair each."""
    g = random.Random(33)
    word = lambda: "".join(g.choice("abcdefghij") for _ in range(8))
    rows, near = [], []
    for f in range(12):
        p = [word() for _ in range(80)]
        at = sorted(g.sample(range(5, 200), 2))
        own = None
        for i in range(200):
            q = list(p)
            for k in g.sample(range(80), 8):
                q[k] = word()
            if i in at:
                q = own = list(own or q)
                q[2 if i == at[0] else 77] = word()
            rows.append((1000 * f + i, " ".join([word() for _ in range(20)] + q + [word() for _ in range(20)])))
        near.append((1000 * f + at[1], 1000 * f + at[0]))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for block_rows in (2048, 64):
        got = {(r.doc, r.source_doc) for r in windows.find(frame, block_rows=block_rows).collect()}
        assert sum(c in got for c in near) >= 11
    # One value's windows against all pairs: classes, and a source for each document that has one.
    p = [g.randrange(1 << 32) for _ in range(90)]
    docs = []
    for i in range(80):
        q = [g.randrange(1 << 32) if g.random() < (0, 0.06, 0.12)[i % 3] else x for x in p]
        docs.append((i, i, 0, np.array([g.randrange(1 << 32) for _ in range(10)] + q, np.uint32)))
    links = [(a[0], b[0]) for a in docs for b in docs if b[0] < a[0] and windows.passages(a[3], b[3], 46, 0.8)]
    made = [(x[0], x[4]) for x in windows.met_in_block(docs, 46, 0.8)]
    assert len(links) > 300 > 2 * len(set(made)) and set(made) <= set(links)
    assert {a for a, _ in made} == {a for a, _ in links}
    assert components_of(range(80), made) == components_of(range(80), links)


def variants(g, n, length, edits):
    p = [g.randrange(1 << 32) for _ in range(length)]
    rows = []
    for i in range(n):
        q = list(p)
        for _ in range(edits):
            k = g.randrange(length - 5)
            q[k : k + 5] = [g.randrange(1 << 32) for _ in range(5)]
        rows.append((i, i, 0, np.array(q, np.uint32)))
    return rows


def test_windows_blocks_by_tokens(spark, monkeypatch):
    """Blocks are bounded by tokens, not by windows alone: 40 long texts under one value come in several, and still join as in one."""
    g = random.Random(5)
    word = lambda: "".join(g.choice("abcdefghij") for _ in range(8))
    p = [word() for _ in range(400)]
    rows = [(i, " ".join(p + [word() for _ in range(8)])) for i in range(120)]
    given = windows.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    met = given.selectExpr("1L AS key", "0 AS hash", "doc", "twin", "0 AS left", "399 AS right")
    whole = {(r.doc, r.s_doc) for r in windows.frequent(given, met, 46, 0.8, 4096).collect()}

    def sizes(least, similarity):
        def run(batches):
            held = {}
            for b in batches:
                for key, i, j, raw in zip(*(b.column(n).to_pylist() for n in ("key", "i", "j", "tokens")), strict=True):
                    held[key, i, j] = held.get((key, i, j), 0) + len(raw) // 4
            import pyarrow as pa

            names = [x.split()[0] for x in windows.PAIRS.split(", ")]
            n = len(held)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32() if c in ("hash", "left", "right", "s_left", "s_right") else pa.int64()) if c != "doc" else pa.array(list(held.values()), pa.int64()) for c in names], names=names)

        return run

    monkeypatch.setattr(windows, "BLOCK_TOKENS", 8000, raising=False)
    split = {(r.doc, r.s_doc) for r in windows.frequent(given, met, 46, 0.8, 4096).collect()}
    assert components_of(range(120), split) == components_of(range(120), whole) and len(set(components_of(range(120), split).values())) == 1
    monkeypatch.setattr(windows, "_blocks", sizes)
    most = [r.doc for r in windows.frequent(given, met, 46, 0.8, 4096).collect()]
    assert len(most) > 6 and max(most) < 4 * 8000


def test_windows_few_comparisons(monkeypatch):
    """Variants of one text that share much but mostly fail: the bounds leave few exact comparisons, and no document loses its class or its source."""
    g, calls, exact = random.Random(6), [0], windows.passages

    def counted(*a):
        calls[0] += 1
        return exact(*a)

    docs = variants(g, 160, 146, 5)
    links = [(a[0], b[0]) for a in docs for b in docs if b[0] < a[0] and exact(a[3], b[3], 46, 0.8)]
    monkeypatch.setattr(windows, "passages", counted)
    made = [(x[0], x[4]) for x in windows.met_in_block(docs, 46, 0.8)]
    assert set(made) <= set(links) and {a for a, _ in made} == {a for a, _ in links}
    assert components_of(range(160), made) == components_of(range(160), links)
    assert calls[0] < 4 * len(docs), calls
    # A common line of 30 tokens brings nothing together.
    line, calls[0] = [g.randrange(1 << 32) for _ in range(30)], 0
    rows = [(i, i, 0, np.array([*line, *(g.randrange(1 << 32) for _ in range(90))], np.uint32)) for i in range(3000)]
    own = docs[0][3]
    rows += [(5000 + i, i, 0, own) for i in range(2)]
    assert [(x[0], x[4]) for x in windows.met_in_block(rows, 46, 0.8)] == [(5001, 5000)] and calls[0] <= 1


def test_windows_copies_met():
    """Copies of a text take one pair each, across batches too; a row of the same id none; other texts meet the first copy only."""
    rows = [(7, 0, d, t, 0, 60) for t, ds in ((1, (3, 3, *range(10, 40))), (2, (1,)), (3, (20, 50))) for d in ds]
    batches = [windows._frame(list(np.array(rows[a : a + 9], np.int64).T), windows.WINDOWS) for a in range(0, len(rows), 9)]
    got = [(r["doc"], r["twin"], r["s_doc"], r["s_twin"]) for b in windows._met(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == sorted([(d, 1, 3, 1) for d in range(10, 40)] + [(50, 3, 20, 3), (3, 1, 1, 2), (20, 3, 1, 2), (20, 3, 3, 1)])


def test_windows_odd_ids(spark):
    """Null ids and repeated ids with other texts: spans are cut from the text that has them."""
    g = random.Random(8)
    para = lambda n: ["".join(g.choice("abcdefgh") for _ in range(8)) for _ in range(n)]
    p = para(70)
    rows = [(None, " ".join(p + para(10))), (5, " ".join(para(30))), (5, " ".join(para(12) + p)), (6, None), (6, "")]
    left = [r.text for r in windows.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(len(t.split()) for t in left if t) == [12, 30, 80]


def test_packing(docs, texts, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(docs).collect()
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in texts.items()}
    seqs, pieces = {}, {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and 4 * r.doc_tokens == len(ids[r.doc_id])
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for group in (*seqs.values(), *pieces.values()):
        at = 0
        for s, n in sorted(group):
            assert s == at
            at += n
    assert set(pieces) == set(ids) and max(sum(n for _, n in g) for g in seqs.values()) <= 4096
    assert sum(len(x) // 4 for x in ids.values()) >= 0.98 * 4096 * (len(seqs) - 1)
    assert packing.pack(odd).select("doc_id").count() >= len(ODD) and packing.pack(empty).count() == 0
    e = packing.Encoder(packing.tokenizer_path())
    e.words, e.plain = packing.Recent(50), packing.Recent(50)
    for t in [*list(texts.values())[:60], "it's  don't 'S ábé  x\x1cy\u0085z \xa0 12a3 <|endoftext|> ÀÉ, İstanbul ΣΑΣ ß... hello!!? WORLD", "́ ́x"]:
        assert e.encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_bin_slack():
    random.seed(5)
    for _ in range(500):
        room, counts = random.randint(0, 40), {random.randint(1, 20): random.randint(1, 3) for _ in range(random.randint(0, 6))}
        reach = {0}
        for k, n in counts.items():
            for _ in range(n):
                reach |= {x + k for x in reach if x + k <= room}
        use = packing.fill(counts, room)
        assert sum(k * n for k, n in use.items()) == max(reach) and all(n <= counts[k] for k, n in use.items())


def test_multiindex(spark):
    g = np.random.default_rng(3)
    base = g.normal(size=(60, 16))
    near = [b + g.normal(size=16) * 0.05 for b in base[:30] for _ in range(4)]
    rows = [(i, [float(x) for x in v], int(i % 3)) for i, v in enumerate([*base, *near, *base[:10]])]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None] * 8, 1), (904, rows[0][1], None), (905, [], 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (None, rows[0][1], 0)]
    got = multiindex.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cell_rows=8, reach=1.0).collect()
    ok = [(i, np.array(v), k) for i, v, k in rows if i is not None and v and None not in v and k is not None and np.isfinite(v).all() and np.any(v)]
    edges = [(a, b) for a, x, k in ok for b, y, m in ok if a < b and k == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98]
    want, n = components_of([r[0] for r in rows if r[0] is not None], edges), Counter(x for e in edges for x in e)
    assert len(got) == len(rows) and all((r.n_links, r.component_id, r.kept) == ((n[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id) if r.vec_id is not None else (0, None, True)) for r in got)
    assert len(edges) > 100
    assert multiindex.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    first, second = g.random(8), g.random(8)
    assert list(multiindex.traverse(first, second, 0.9)) == sorted([(i, j) for i in range(8) for j in range(8) if first[i] + second[j] <= 0.9], key=lambda c: first[c[0]] + second[c[1]])


def test_multiindex_registered(spark):
    """The setting that is registered, on pairs in a subspace of 4 dimensions, whose noise crosses borders."""
    g = np.random.default_rng(9)
    basis = np.linalg.qr(g.normal(size=(64, 4)))[0]
    z = g.normal(size=(500, 4))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    step = g.normal(size=z.shape)
    step -= (step * z).sum(1, keepdims=True) * z
    y = z + step / np.linalg.norm(step, axis=1, keepdims=True) * np.tan(np.arccos(g.uniform(0.981, 0.99, size=(500, 1))))
    x = np.concatenate([z, y]) @ basis.T
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = x @ x.T
    want = (cosine >= 0.98).sum(1) - 1
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in multiindex.link(frame, words=64, query_rows=400).collect()}
    assert sum(got.values()) >= 0.999 * want.sum() and want.sum() > 1000
    few = {r.vec_id: r.n_links for r in multiindex.link(frame.where("vec_id % 500 < 60"), words=16).collect()}
    at = [i for i in range(1000) if i % 500 < 60]
    assert few == {i: int((cosine[i, at] >= 0.98).sum() - 1) for i in at}


def in_duckdb(frame, name, sql):
    import duckdb

    con = duckdb.connect()
    con.register(name, frame)
    return con.execute(sql).df()


def same(got, want, key):
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(key).astype(str).to_numpy().tolist() for x in (got, want))
    assert a == b


def test_sql_of_suffixes(spark):
    """Repeats within and across documents, overlapping and adjacent spans, multi-byte characters, null and empty texts."""
    random.seed(8)
    letters = lambda n: "".join(random.choice("abcé日 ") for _ in range(n))
    shared = [letters(n) for n in (90, 140, 300, 2500)]
    texts = [None, "", "a" * 1500, "ab" * 99, letters(99)]
    texts += ["".join(random.choice([letters(random.randint(0, 80)), *shared]) for _ in range(random.randint(1, 6))) for _ in range(60)]
    docs = spark.createDataFrame([(7 * i % 101, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = suffixes.dedup(docs, full=False).toPandas()
    assert got.n_removed.sum() > 10_000 and (got.n_spans > 1).any()
    same(got, in_duckdb(docs.toPandas(), "documents", catalogue.oracle_sql()["op6_suffixes"]), "doc_id")


def test_sql_of_multiindex(spark):
    import pyarrow as pa

    g = np.random.default_rng(4)
    base = g.normal(size=(40, 16))
    vectors = [*base, *[b + g.normal(size=16) * 0.05 for b in base for _ in range(3)], *base[:10], np.zeros(16), None, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16, [], [1.0, 2.0]]
    vectors = [v if v is None else [x if x is None else float(x) for x in v] for v in vectors]
    table = pa.table({"vec_id": range(len(vectors)), "embedding": pa.array(vectors, pa.list_(pa.float64())), "label": [None if i == 3 else i % 2 for i in range(len(vectors))]})
    rows = spark.createDataFrame([tuple(r.values()) for r in table.to_pylist()], "vec_id long, embedding array<double>, label long")
    got = multiindex.link(rows, reach=1.0).toPandas()
    assert got.n_links.sum() > 100
    same(got, in_duckdb(table, "embeddings", catalogue.oracle_sql()["op10_multiindex"]), "vec_id")


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())
    assert {"pipeline"} | {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in catalogue.queries()}


def test_pipeline_by_hand(spark, tmp_path):
    """run() on planted documents against the five stages in plain Python."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    g = random.Random(31)
    voc = ["".join(g.choice("abcdefghijklmnoprstuvw") for _ in range(g.randint(3, 8))) for _ in range(4000)]

    def prose(n):
        w = [g.choice(voc) for _ in range(n)]
        for i in range(0, n, 10):
            w[i] = w[i].capitalize()
            w[min(i + 9, n - 1)] += "."
        return w

    shared, rows = prose(70), []
    for i in range(40):
        w = prose(g.randint(100, 300))
        if i in (4, 11, 30):
            w = w[:50] + shared + w[50:]
        if i % 6 == 0:
            w[20:20] = ["Mail", f"person{i}@office{i}.example.org", "today."]
        rows.append((i, " ".join(w)))
    near = rows[7][1].split()
    near[33] = "otherword"
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, " ".join(near)), (53, "too short to keep."), (54, None), (55, ""), (56, " ".join(["again and again"] * 60)), (None, " ".join(prose(120)))]
    folder = str(tmp_path / "in")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")

    def passes(t):
        w = (t or "").split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        repeated = {j for i, x in enumerate(grams) if n[x] > 1 for j in (i, i + 1, i + 2)}
        return len(w) >= 50 and 100 * len(repeated) <= 50 * len(w)

    kept = [(i, t) for i, t in rows if passes(t)]
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in kept}
    order = lambda i: (i is None, i or 0)
    gone = {b for a in sets for b in sets if order(a) < order(b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    kept = [(i, t) for i, t in kept if i not in gone]
    assert {50, 51, 52} == gone and {i for i, _ in kept} == {*range(40), None}
    whole = " ".join(shared)
    first = min(i for i, t in kept if i is not None and whole in t)
    kept = [(i, t if i == first else t.replace(whole + " ", "")) for i, t in kept]
    want = {}
    tok = Tokenizer.from_file(packing.tokenizer_path())
    for i, t in kept:
        for s, k, e in reversed(slow_spans(t)):
            t = t[:s] + f"[{pii.KINDS[k].upper()}]" + t[e:]
        assert "@" not in t
        want[i] = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in found} == set(want)
    for r in found:
        assert 4 * r.doc_tokens == len(want[r.doc_id]) and zlib.crc32(want[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    assert sum(r.length for r in found) * 4 == sum(map(len, want.values()))
