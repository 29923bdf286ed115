"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes for a good text, against it, or abstains. Texts are counted by
their votes; expectation-maximisation over these counts (at most 3 to the
number of rules rows) estimates the share of good texts and, for good and bad
texts apart, how often each rule votes either way. A text is kept if its
posterior probability of being good is at least one half. No label takes part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._util import SPACE, stash, text_or_empty

WINDOW = 5
ROUNDS = 100
#: What expectation-maximisation starts from: the share of good texts, and how often a rule votes against, abstains
#: and votes for a good and a bad text. So many imagined texts of these shares are added to the counts.
GOOD, ON_GOOD, ON_BAD, PSEUDO = 0.8, (0.05, 0.15, 0.8), (0.4, 0.3, 0.3), 10.0
KEPT_FROM = 0.5
#: A word without a letter.
BARE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]+(?![^\x20\x09-\x0D])"


def features(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts over each whole text of docs (doc_id, text): the columns doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_upper, n_ended, n_bare (words without a letter) and those in `keep`.

    A null or empty text has zero of everything, a very long one is counted
    whole. Windows of five words are compared by a 64-bit hash within their own
    text only. Rows that repeat count each for itself. Columns of docs that are
    not in `keep` are left out, whatever their names.
    """
    text = text_or_empty()
    rows = docs.select(F.col("doc_id"), *keep, text.alias("_text"), F.filter(F.split(text, SPACE), lambda w: w != "").alias("_words"))
    n = F.size("_words")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW)))))
    size = F.length("_text")
    rows = rows.select(
        "doc_id", *keep, n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        (size - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (size - F.length(F.regexp_replace("_text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.size(F.filter("_words", lambda w: w.substr(F.length(w), F.lit(1)).isin(".", "!", "?", "…", "。"))).cast("long").alias("n_ended"),
        F.regexp_count("_text", F.lit(BARE)).cast("long").alias("n_bare"),
        lines.alias("_lines"), windows.alias("_windows"))
    # One column a step: a column that a lambda refers to has to be there, or it would be computed for each element.
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")) \
        .withColumn("_sorted", F.when(repeats, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_lines", "_windows")
    same = lambda e, i: F.when((e["h"] == F.get("_sorted", i - 1)["h"]) | (e["h"] == F.get("_sorted", i + 1)["h"]), e["i"])
    rows = rows.withColumn("_at", F.array_sort(F.filter(F.transform("_sorted", same), lambda x: x.isNotNull()))).drop("_sorted")
    covered = F.aggregate(F.transform("_at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")


def rules() -> dict[str, tuple[Column, Column]]:
    """Of each rule, what a good text meets and what a bad one meets; between the two it abstains."""
    n = F.col("n_words")
    per_word = lambda c: F.try_divide(F.col(c), n)
    per_char = lambda c: F.try_divide(F.col(c), F.col("word_chars"))
    return {
        "length": (n >= 50, n < 20),
        "word_length": (per_word("word_chars").between(4, 6.5), ~per_word("word_chars").between(3, 7)),
        "symbols": (per_char("n_symbols") < 0.01, per_char("n_symbols") > 0.04),
        "letters": (per_word("n_bare") < 0.05, per_word("n_bare") > 0.2),
        "sentences": (per_word("n_ended").between(0.04, 0.3), ~per_word("n_ended").between(0.02, 0.5)),
        "upper_case": (per_char("n_upper") < 0.06, per_char("n_upper") > 0.2),
        "lines": (F.col("n_dup_lines") == 0, F.col("n_dup_lines") >= 3),
        "repeats": (per_word("n_repeat_words") < 0.02, per_word("n_repeat_words") > 0.1),
    }


def vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0)


def estimate(counts: dict[tuple[int, ...], int], n_rules: int, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """The share of good texts, and for bad and good texts how often each rule votes -1, 0 and 1, from how many texts have each tuple of votes."""
    start = np.stack([np.tile(ON_BAD, (n_rules, 1)), np.tile(ON_GOOD, (n_rules, 1))])
    good, rates = GOOD, start.copy()
    votes = np.array(sorted(counts), np.int64).reshape(-1, n_rules) + 1
    n = np.array([counts[k] for k in sorted(counts)], float)
    for _ in range(rounds if len(n) else 0):
        p = posterior(votes, good, rates)
        weight = np.stack([n * (1 - p), n * p])
        good = (weight[1].sum() + GOOD * PSEUDO) / (n.sum() + PSEUDO)
        rates = PSEUDO * start
        for v in range(3):
            rates[:, :, v] += weight @ (votes == v)
        rates /= rates.sum(axis=2, keepdims=True)
    return float(good), rates


def posterior(votes: np.ndarray, good: float, rates: np.ndarray) -> np.ndarray:
    """The probability of a good text for each row of votes (0 against, 1 abstains, 2 for)."""
    odds = np.log(good / (1 - good)) + np.log(rates[1] / rates[0])[np.arange(rates.shape[1]), votes].sum(axis=1)
    return 1 / (1 + np.exp(-odds))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The counts of features() with base_failed, the votes, probability (null if base_failed) and kept.

    base_failed texts have under 10 words, or more than a fifth of their words
    in repeated windows; they are not kept and teach the estimate nothing. A
    null or empty text is one of them. Rows that repeat count each for itself
    and get the same verdict; a probability of exactly one half is kept. An
    empty table gives no rows.
    """
    rows = stash(features(docs).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))), "rules-features")
    named = rules()
    rows = rows.withColumns({f"vote_{k}": vote(*v) for k, v in named.items()})
    names = [f"vote_{k}" for k in named]
    counts = {tuple(r[c] for c in names): r["n"] for r in rows.where("NOT base_failed").groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 3 ** 8 rows
    good, rates = estimate(counts, len(names))
    odds = F.lit(float(np.log(good / (1 - good))))
    for c, (against, abstains, in_favour) in zip(names, np.log(rates[1] / rates[0]).tolist(), strict=True):
        odds = odds + F.when(F.col(c) > 0, in_favour).when(F.col(c) < 0, against).otherwise(abstains)
    p = F.when(~F.col("base_failed"), 1 / (1 + F.exp(-odds)))
    return rows.withColumn("probability", p).withColumn("kept", ~F.col("base_failed") & (F.coalesce("probability", F.lit(0.0)) >= KEPT_FROM))


def op6_weak_supervision(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents, and probability; nulls, repeated rows and the like as in filter_quality()."""
    rows = filter_quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
