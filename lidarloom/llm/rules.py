"""Quality rules as weak supervision, in DataFrame functions alone.

Each rule votes +1 (good), -1 (bad) or abstains (0) on statistics of a document. Expectation-maximisation over the counts
of vote patterns (at most 3 to the power of the number of rules, whatever the corpus holds) estimates for each rule how it votes on
good and on bad documents, and the share of good ones; a document is kept if the posterior probability that it is
good reaches the threshold and the two base rules do not fail.

A null text has no words and fails the base rules; repeated rows each get the same row; an empty table gives no
rows (and the priors for a model). Windows are told apart by 64-bit hashes of their three words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, cut_table, free_name, let, table, words_of

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_ends", "n_distinct", "n_marks")


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more, every place included."""
    zero = F.lit(0).cast("long")

    def marked(sorted_windows: Column) -> Column:
        """Places of windows that equal a neighbour in the order of their hashes."""
        last = F.size(sorted_windows) - 1
        same = lambda x, i: sorted_windows[i]["h"] == x["h"]
        return F.transform(F.filter(sorted_windows, lambda x, i: ((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))) | ((i < last) & same(x, F.least(i + 1, last)))), lambda x: x["at"])

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, w[i + 1], w[i + 2]).alias("h"), i.alias("at")))

    def covered(places: Column) -> Column:
        """Each place covers itself and the next two words, less what earlier places cover."""
        start = F.struct(zero.alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + (p + 3 - F.greatest(a["end"], p)).cast("long")).alias("n"), (p + 3).alias("end"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    found = let(words, lambda w: let(F.sort_array(windows(w)), lambda s: covered(F.sort_array(marked(s)))))
    return F.when(F.size(words) < 4, zero).otherwise(found)


def kept_chars(text: Column, drop: str) -> Column:
    """Number of characters left of a text without those that the pattern matches."""
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def statistics(docs: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """docs with the counts in STATS and MORE; each name gets the prefix."""
    text, words, lines = (free_name(docs, f"{prefix}{n}") for n in ("t_", "w_", "l_"))
    has_word = lambda x: x.rlike("[^\\x20\\x09-\\x0D]")
    t, w, ln = F.col(text), F.col(words), F.col(lines)
    made = {
        "n_words": F.size(w).cast("long"),
        "word_chars": kept_chars(t, "[\\x20\\x09-\\x0D]+"),
        "n_symbols": kept_chars(t, "[^#*$%&|<>]+"),
        "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
        "n_repeat_words": repeat_words(w),
        "n_lines": F.size(ln).cast("long"),
        "n_upper": kept_chars(t, "[^\\p{Lu}]+"),
        "n_ends": kept_chars(t, "[^.!?;:]+"),
        "n_distinct": F.size(F.array_distinct(w)).cast("long"),
        "n_marks": kept_chars(t, "[\\p{L}\\p{M}\\p{N}\\x20\\x09-\\x0D]+"),
    }
    base = docs.withColumn(text, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    base = base.withColumns({words: words_of(t), lines: F.filter(F.split(t, "\n"), has_word)})
    return base.withColumns({f"{prefix}{k}": c for k, c in made.items()}).drop(text, words, lines)


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def votes(prefix: str = "") -> dict[str, Column]:
    """The rules: name to vote. Each looks at one ratio: bad beyond one bound, good within another, else no vote."""
    c = {k: F.col(f"{prefix}{k}").cast("double") for k in (*STATS, *MORE)}
    some = F.greatest(c["n_words"], F.lit(1.0))
    chars, lines = F.greatest(c["word_chars"], F.lit(1.0)), F.greatest(c["n_lines"], F.lit(1.0))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    mean, ends = c["word_chars"] / some, c["n_ends"] / some
    return {
        "length": vote(c["n_words"] < 20, c["n_words"] >= 80),
        "symbols": vote(c["n_symbols"] > 0.1 * some, c["n_symbols"] <= 0.01 * some),
        "word_length": vote((mean < 2.5) | (mean > 11), (mean >= 3.5) & (mean <= 8)),
        "lines": vote(c["n_dup_lines"] > 0.3 * lines, (c["n_dup_lines"] == 0) & (c["n_words"] >= 20)),
        "repeats": vote(c["n_repeat_words"] > 0.3 * some, (c["n_repeat_words"] <= 0.1 * some) & (c["n_words"] >= 20)),
        "capitals": vote(c["n_upper"] > 0.3 * chars, c["n_upper"] < 0.1 * chars),
        "ends": vote((ends > 0.5) | ((ends < 0.005) & (c["n_words"] >= 40)), (ends >= 0.02) & (ends <= 0.3)),
        "marks": vote(c["n_marks"] > 0.6 * some, c["n_marks"] <= 0.4 * some),
        "variety": vote((c["n_distinct"] < 0.2 * F.least(some, F.lit(300.0))), (c["n_distinct"] > 0.5 * F.least(some, F.lit(300.0)))),
    }


def pattern(prefix: str = "") -> Column:
    """The votes as one number in base 3."""
    return sum(((v + 1) * 3**i for i, v in enumerate(votes(prefix).values())), F.lit(0)).cast("int")


@dataclass
class Model:
    """good: share of good documents; said[rule][good]: how likely a vote is bad, on bad (0) and good (1) documents.

    That a rule abstains tells nothing.
    """

    good: float
    said: list[list[float]]

    def posterior(self, number: int) -> float:
        odds = math.log(self.good / (1 - self.good))
        for rule in self.said:
            number, v = divmod(number, 3)
            if v != 1:
                bad, good = (x if v == 0 else 1 - x for x in rule)
                odds += math.log(good / bad)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def estimate(counts: dict[int, int], n_rules: int, rounds: int = 100, prior: float = 2.0) -> Model:
    """Expectation-maximisation on counts of vote patterns, begun from bad votes that are rare on good documents.

    Weak counts (prior, shaped like the start) keep which side is "good" and every probability over 0.
    """
    first = (0.45, 0.03)
    model, total = Model(0.8, [list(first) for _ in range(n_rules)]), sum(counts.values())
    for _ in range(rounds):
        votes_bad = [[prior * p for p in first] for _ in range(n_rules)]
        votes_all = [[prior, prior] for _ in range(n_rules)]
        good = prior * 0.8
        for number, n in counts.items():
            p = model.posterior(number)
            good += n * p
            for bad, every in zip(votes_bad, votes_all, strict=True):
                number, v = divmod(number, 3)
                if v != 1:
                    for side, share in enumerate((n * (1 - p), n * p)):
                        every[side] += share
                        bad[side] += share * (v == 0)
        said = [[b / a for b, a in zip(bad, every, strict=True)] for bad, every in zip(votes_bad, votes_all, strict=True)]
        new = Model(min(max(good / (total + prior), 0.01), 0.99), said)
        done = abs(new.good - model.good) < 1e-9
        model = new
        if done:
            break
    return model


def judge(model: Model, patterns: list[int], number: Column, least: float) -> tuple[Column, Column]:
    """Posterior probability and verdict as columns: a bounded list of literals by pattern."""
    known = F.create_map(*[F.lit(x) for p in sorted(patterns) for x in (p, model.posterior(p))]) if patterns else F.lit(None).cast("map<int,double>")
    p = F.coalesce(F.try_element_at(known, number), F.lit(0.0))
    return p, p >= least


def counted(numbers: DataFrame) -> dict[int, int]:
    """Counts by pattern of the documents that pass the base rules; their number is bounded by the rules."""
    return {r[0]: r[1] for r in numbers.where(~F.col("base_failed")).groupBy("votes").count().collect()}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed, kept and the posterior quality.

    The statistics are computed once and cut to the checkpoint folder (some 60 bytes a document), since the model needs the counts of all.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    some = cut(statistics(given, "text").drop("text").select("doc_id", *STATS, base_failed().alias("base_failed"), pattern().alias("votes")))
    counts = counted(some)
    p, good = judge(estimate(counts, len(votes())), list(counts), F.col("votes"), least)
    return some.select("doc_id", *STATS, "base_failed", (~F.col("base_failed") & good).alias("kept"), p.alias("p_good"))


def keep_good(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that the rules keep, with their own columns. An empty table gives no rows.

    One pass over the text: documents go to the checkpoint folder with their votes, and the verdict is a filter on the way back.
    """
    tag = "stat_"
    while any(c.lower().startswith(tag) for c in docs.columns):
        tag += "_"
    own = [F.col(f"`{c}`") for c in docs.columns]
    failed, number = f"{tag}failed", f"{tag}votes"
    seen = cut_table(statistics(docs, text_col, tag).select(*own, base_failed(tag).alias(failed), pattern(tag).alias(number)))
    counts = {r[0]: r[1] for r in seen.where(~F.col(failed)).groupBy(number).count().collect()}
    _, good = judge(estimate(counts, len(votes())), list(counts), F.col(number), least)
    return seen.where(~F.col(failed) & good).select(*own)


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
