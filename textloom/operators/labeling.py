"""Deterministic labeling against a taxonomy, and cleaning of outside annotations."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

SUBJECT_WEIGHT, EXCLUSION_WEIGHT, NAME_WEIGHT = 2, -0.6, 3
#: Leaf weights are whole numbers of this fraction, so that scores do not depend on the order of summation.
UNIT = 1_000_000


def leaf_terms(taxonomy: list[dict], stopwords: tuple[str, ...] = T.STOPWORDS) -> list[tuple[str, str, int]]:
    """(leaf, term, weight) of a taxonomy, a short configuration: rarer terms weigh more, excluded ones against."""
    split = lambda parts: [w for p in parts for w in re.findall(T.TOKEN, p.lower()) if len(w) > 2 and w not in stopwords]
    good, bad = {}, {}
    for leaf in taxonomy:
        good[leaf["name"]] = Counter(split([leaf["definition"], *leaf["inclusion_criteria"], *leaf["boundary_examples"]])) + Counter(split([leaf["name"]]) * NAME_WEIGHT)
        bad[leaf["name"]] = Counter(split(leaf["exclusion_criteria"]))
    seen = Counter(t for bag in good.values() for t in bag)
    idf = {t: math.log((len(good) + 1) / (n + 1)) + 1 for t, n in seen.items()}
    out = []
    for leaf, bag in good.items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items())) or 1.0
        for t in sorted({*bag, *bad[leaf]} & idf.keys()):
            out.append((leaf, t, round((bag[t] + EXCLUSION_WEIGHT * bad[leaf][t]) * idf[t] / norm * UNIT)))
    return out


def label(docs: DataFrame, weights: list[tuple[str, str, int]], leaves: list[str], stopwords: tuple[str, ...] = T.STOPWORDS) -> DataFrame:
    """doc_id, label, score, margin of each of docs (doc_id, subject, body): the leaf of the greatest score, ties by name.

    A subject token counts twice, once however often it is there; each body
    token counts once. Leaves without a common term score zero, and a text
    without a positive score has margin zero. Only terms of the taxonomy are
    looked up, in a literal map of them, so no rows are shuffled.
    """
    by_term: dict[str, dict[str, int]] = {}
    for leaf, term, w in weights:
        by_term.setdefault(term, {})[leaf] = w
    known = F.create_map(*[x for t, ws in by_term.items() for x in (F.lit(t), F.array(*[F.lit(ws.get(leaf, 0)).cast("long") for leaf in leaves]))])
    add = lambda times: lambda acc, t: F.zip_with(acc, F.coalesce(F.try_element_at(known, t), F.array(*[F.lit(0).cast("long")] * len(leaves))), lambda a, w: a + w * times)
    zero = F.array(*[F.lit(0).cast("long")] * len(leaves))
    rows = docs.select("doc_id", F.array_distinct(T.tokens(F.coalesce("subject", F.lit("")), stopwords)).alias("_s"), T.tokens(F.coalesce("body", F.lit("")), stopwords).alias("_b"))
    rows = rows.withColumn("_scores", F.aggregate("_b", F.aggregate("_s", zero, add(SUBJECT_WEIGHT)), add(1)))
    ranked = F.array_sort(F.transform(F.arrays_zip("_scores", F.array(*map(F.lit, leaves)).alias("leaf")), lambda x: F.struct((-x["_scores"]).alias("minus"), x["leaf"].alias("leaf"))))
    rows = rows.select("doc_id", ranked.alias("_r"))
    best, second = -F.col("_r")[0]["minus"], -F.col("_r")[1]["minus"]
    margin = F.when(best <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(best - second, best))))
    return rows.select("doc_id", F.col("_r")[0]["leaf"].alias("label"), best.alias("score"), margin.alias("margin"))


def clean(rows: DataFrame, vocabulary: list[str], most_words: int = 25) -> DataFrame:
    """Annotations (doc_id, label, confidence, rationale, abstain) made valid: no label outside the vocabulary, confidence
    from 0 to 1, rationale of at most `most_words` words."""
    good = ~F.coalesce("abstain", F.lit(False)) & F.col("label").isin(*vocabulary)
    words = F.split(F.trim(F.regexp_replace(F.coalesce("rationale", F.lit("")), r"\s+", " ")), " ")
    return rows.select(
        "doc_id", F.when(good, F.col("label")).alias("label"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))).alias("confidence"),
        F.array_join(F.slice(words, 1, most_words), " ").alias("rationale"), (~F.coalesce(good, F.lit(False))).alias("abstain"))


def fill_missing(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """One annotation for each of docs; those without are abstained from with confidence 0."""
    return docs.select("doc_id").join(annotations, "doc_id", "left").select("doc_id", "label", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("abstain", F.lit(True)).alias("abstain"))


def leaves_of(alignment: dict[str, list[str] | str | None], label: Column) -> Column:
    """The leaves that a label covers: none for an unknown label."""
    lists = {k: [v] if isinstance(v, str) else [x for x in v or [] if x] for k, v in alignment.items()}
    empty = F.array().cast("array<string>")
    table = F.create_map(*[x for k, v in lists.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return F.coalesce(F.try_element_at(table, label), empty)


def split_cache(requests: DataFrame, cache: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Requests that a cache (cache_key, response) answers, with the answer, and those it does not."""
    keyed = requests.withColumn("cache_key", key)
    return keyed.join(cache, "cache_key"), keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def annotate_missing(misses: DataFrame, provider, schema: str) -> DataFrame:
    """Answers of a provider (an iterator of pandas frames to another) for the requests that no cache answers."""
    return misses.mapInPandas(provider, schema)
