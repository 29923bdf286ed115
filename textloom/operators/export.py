"""Stratified export that refuses personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.ranking import rank_within

TRAIN_SHARE, SEED = 0.85, 20260904
FIELDS = ("doc_id", "subject", "body", "channel", "customer_tier", "created_at", "label", "acceptable_alt_label")


class Leak(Exception):
    """Personal data in what was to be exported."""


def usable(v2: DataFrame) -> DataFrame:
    return v2.where("status = 'kept' AND label IS NOT NULL")


def exclusions(v2: DataFrame) -> DataFrame:
    """Rows left out, by status or as kept_without_label."""
    out = v2.where("NOT (status = 'kept' AND label IS NOT NULL)")
    return out.groupBy(F.when(F.col("status") != "kept", F.col("status")).otherwise("kept_without_label").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def leaks(rows: DataFrame, columns: tuple[str, ...] = ("body",), most: int = 20) -> DataFrame:
    """The first ids whose text still has personal data."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | T.has_pii(F.col(c))
    return rows.where(hit).select("doc_id").orderBy("doc_id").limit(most)


def split(rows: DataFrame, share: float = TRAIN_SHARE, seed: int = SEED) -> DataFrame:
    """rows (doc_id, label, ...) and split: of each label, in a seeded order, the first round-half-even of `share` are train, and at least one."""
    ranked = rank_within(rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("doc_id").cast("string")))), ["label"], [F.asc("_h"), F.asc("doc_id")], "_i")
    sizes = ranked.groupBy(F.col("label").alias("_l")).agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * share).cast("long")).alias("_cut"))
    return ranked.join(sizes, F.col("label").eqNullSafe(F.col("_l"))).select(*rows.columns, F.when(F.col("_i") <= F.col("_cut"), "train").otherwise("eval").alias("split"))


def records(rows: DataFrame, tickets: DataFrame) -> DataFrame:
    """Export records of rows (doc_id, label, alt_label, body scrubbed, split) with the fields of tickets (doc_id, subject, channel,
    tier, created_at). The subject is scrubbed too; a null alternate leaves no field in JSON."""
    subject = F.coalesce("subject", F.lit(""))
    clean = T.scrub(subject, T.pii_spans(subject))["text"]
    named = tickets.select("doc_id", clean.alias("subject"), "channel", F.col("tier").alias("customer_tier"), "created_at")
    return rows.withColumnRenamed("alt_label", "acceptable_alt_label").join(named, "doc_id").select(*FIELDS, "split")


def write(rows: DataFrame, folder: str) -> None:
    """Both splits as JSON lines; nothing is written if any row has personal data."""
    if found := [r["doc_id"] for r in leaks(rows, tuple(c for c in ("subject", "body") if c in rows.columns)).collect()]:
        raise Leak(f"personal data in {found}")
    for name in ("train", "eval"):
        part = rows.where(F.col("split") == name).drop("split")
        part.select(*sorted(part.columns)).write.mode("overwrite").json(f"{folder}/{name}")
