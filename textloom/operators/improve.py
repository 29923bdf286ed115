"""The second version of a dataset: adjudications, merged duplicates and scrubbed bodies, and the difference to the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T


def latest_adjudications(log: DataFrame) -> DataFrame:
    """The last decision on each document that is no skip, by place in the log."""
    last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("ordinal")))
    return log.where("decision <> 'skip'").withColumn("_n", last).where("_n = 1").drop("_n")


def first_version(rows: DataFrame) -> DataFrame:
    """doc_id and label: the first annotator's, null where abstained."""
    return rows.select("doc_id", F.when(~F.col("a_abstain"), F.col("a_label")).alias("label"))


def second_version(docs: DataFrame, v1: DataFrame, adjudications: DataFrame, second: DataFrame, clusters: DataFrame) -> DataFrame:
    """doc_id, before, label, alt_label, status, reason, body, spans of docs (doc_id, text).

    In this order: decisions, then merging, then scrubbing. An ambiguous row
    keeps its label and gets the second annotator's (second: doc_id, other) as
    alternate, or is quarantined where that is none or the same. An accepted
    vendor label (adjudications: doc_id, decision, final_label, covered) keeps a
    label that it covers, else becomes the only leaf it covers. Of each cluster
    (doc_id, component) all but the smallest doc_id are merged, unless they are
    quarantined.
    """
    rows = docs.select("doc_id", F.col("text").alias("body")).join(v1.select("doc_id", F.col("label").alias("before")), "doc_id", "left") \
        .join(adjudications, "doc_id", "left").join(second, "doc_id", "left").join(clusters, "doc_id", "left")
    d, before = F.coalesce("decision", F.lit("")), F.col("before")
    ambiguous = d == "ambiguous_both"
    alternate = F.when(ambiguous & F.col("other").isNotNull() & ~F.col("other").eqNullSafe(before), F.col("other"))
    covered = F.coalesce("covered", F.array().cast("array<string>"))
    vendor = F.when(F.coalesce(F.array_contains(covered, before), F.lit(False)), before).when(F.size(covered) == 1, covered[0]).otherwise(before)
    final = F.when(F.col("final_label") != "", F.col("final_label"))
    after = F.when(d.isin("", "ambiguous_both"), None).when((d == "accept_vendor") & final.isNotNull(), vendor).otherwise(final)
    changed = after.isNotNull() & ~after.eqNullSafe(before)
    quarantined = ambiguous & alternate.isNull()
    merged = ~quarantined & F.col("component").isNotNull() & (F.col("component") != F.col("doc_id"))
    spans = T.pii_spans(F.col("body"))
    rows = rows.select(
        "doc_id", "before", F.when(changed, after).otherwise(before).alias("label"), alternate.alias("alt_label"),
        F.when(quarantined, "quarantined").when(merged, "merged_duplicate").otherwise("kept").alias("status"),
        F.when(merged, F.concat(F.lit("near duplicate of "), F.col("component").cast("string"))).when(quarantined, "ambiguous without another label")
        .when(alternate.isNotNull(), "ambiguous, two labels").when(changed, F.concat(F.lit("adjudicated: "), d)).alias("reason"), spans.alias("spans"), F.col("body").alias("old_body"))
    return rows.withColumn("body", F.when(F.size("spans") > 0, T.scrub(F.col("old_body"), F.col("spans"))["text"]).otherwise(F.col("old_body")))


def difference(v2: DataFrame) -> DataFrame:
    """doc_id, field, before, after of everything that the second version changed."""
    s = lambda f, b, a: F.struct(F.lit(f).alias("field"), b.cast("string").alias("before"), a.cast("string").alias("after"))
    c, null = F.col, F.lit(None)
    changes = F.array_compact(F.array(
        F.when(c("label").isNotNull() & ~c("label").eqNullSafe(c("before")), s("label", c("before"), c("label"))),
        F.when(c("alt_label").isNotNull(), s("alt_label", null, c("alt_label"))),
        F.when(c("status") != "kept", s("status", F.lit("kept"), c("status"))),
        F.when(F.size("spans") > 0, s("body", F.concat(F.size("spans").cast("string"), F.lit(" spans")), F.lit("scrubbed")))))
    return v2.select("doc_id", F.explode(changes).alias("x")).select("doc_id", "x.*")
