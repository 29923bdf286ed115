"""Defects of a labeled set: suspected errors, granularity, ambiguity, duplicates in contest, and who has to look at them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators.ranking import global_rank

TWO_ANNOTATORS, ONE_ANNOTATOR, LOW_CONFIDENCE = 0.70, 0.90, 0.55
QUEUE_BAND = (60, 100)
PRIORITY = {"suspected_label_error": 0, "ambiguity": 1, "duplicate": 2}


def outside() -> Column:
    """The first annotator's label is not among the vendor's leaves, and there are such."""
    return (F.size("leaves") > 0) & F.col("a_label").isNotNull() & F.col("b_label").isNotNull() & ~F.col("a_abstain") & ~F.array_contains("leaves", F.col("a_label"))


def suspected(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, leaves, a_label, a_conf, a_abstain, b_label) whose vendor label is doubted: two annotators agree against
    it with 0.70, or the first alone with 0.90."""
    two = (F.col("a_label") == F.col("b_label")) & (F.col("a_conf") >= TWO_ANNOTATORS)
    found = rows.where(outside() & (two | (F.col("a_conf") >= ONE_ANNOTATOR)))
    return found.select("doc_id", F.array_join(F.sort_array("leaves"), "|").alias("vendor_leaves"), F.col("a_label").alias("proposed"), F.col("a_conf").alias("confidence"),
                        F.when(two, "two annotators").otherwise("single high confidence").alias("route"))


def split_by_reach(found: DataFrame, reachable: list[str]) -> tuple[DataFrame, DataFrame]:
    """Suspected errors ranked by confidence, and findings on leaves that no vendor label reaches, likewise."""
    order = [F.desc("confidence"), F.asc("doc_id")]
    reached = F.col("proposed").isin(*reachable)
    return global_rank(found.where(reached), order, "rank"), global_rank(found.where(~reached), order, "rank")


def ambiguous(rows: DataFrame, low: float = LOW_CONFIDENCE) -> DataFrame:
    """doc_id and reasons: abstained, or else low confidence; and three labels that all disagree. A missing confidence is 0."""
    a, b = F.col("a_label"), F.col("b_label")
    unsure = F.when(F.col("a_abstain"), "abstained").when(F.coalesce("a_conf", F.lit(0.0)) < low, "low_confidence")
    three = F.when((F.size("leaves") > 0) & a.isNotNull() & b.isNotNull() & ~F.array_contains("leaves", a) & ~F.array_contains("leaves", b) & (a != b), "three_way_disagreement")
    return rows.select("doc_id", F.array_compact(F.array(unsure, three)).alias("reasons")).where(F.size("reasons") > 0)


def contested(members: DataFrame) -> DataFrame:
    """Of clusters' members (component, doc_id, label, leaves): the clusters with several labels, or labels both in and out of the vendor's leaves."""
    conflict = F.when((F.size("leaves") > 0) & F.col("label").isNotNull(), ~F.array_contains("leaves", F.col("label")))
    return members.groupBy("component").agg(F.count_distinct("label").alias("labels"), F.count_distinct(conflict).alias("sides"), F.count(F.lit(1)).alias("members")).where("members > 1 AND (labels > 1 OR sides > 1)").select("component", "labels", "sides", "members")


def route(*reasons: tuple[DataFrame, str]) -> DataFrame:
    """doc_id and the first of its reasons, in the order given."""
    every = None
    for i, (rows, reason) in enumerate(reasons):
        part = rows.select("doc_id", F.lit(reason).alias("reason"), F.lit(i).alias("p"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("doc_id").agg(F.min_by("reason", "p").alias("reason"))


def queue(routed: DataFrame, ranks: DataFrame, limit: int | None = None) -> DataFrame:
    """The review queue (doc_id, reason, rank) with its place: by reason, rank, doc_id."""
    priority = F.coalesce(*[F.when(F.col("reason") == k, v) for k, v in PRIORITY.items()], F.lit(9))
    rows = routed.join(ranks, "doc_id", "left").withColumn("_priority", priority)
    order = [F.asc("_priority"), F.asc_nulls_first("rank"), F.asc("doc_id")]
    if limit:  # only so many rows are ever sorted together
        return rows.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("_priority")
    return global_rank(rows, order, "place").drop("_priority")


def queue_ratio(routed: DataFrame, docs: DataFrame, band: tuple[int, int] = QUEUE_BAND) -> DataFrame:
    return routed.agg(F.count_distinct("doc_id").alias("routed")).join(docs.agg(F.count(F.lit(1)).alias("total")), F.lit(True)).select(
        "routed", "total", F.try_divide("routed", "total").alias("ratio"), F.col("routed").between(*band).alias("in_band"))


def detailed(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with detail, these columns as JSON."""
    return rows.withColumn("detail", F.to_json(F.struct(*columns)))


def flags(parts: dict[str, DataFrame], routed: DataFrame | None = None) -> DataFrame:
    """All findings (doc_id; rank and detail where they have them) as one table by flag type; with routed (doc_id, reason),
    whether each finding is what its document was routed for."""
    out = None
    for kind, rows in parts.items():
        optional = lambda c, t, rows=rows: (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c)
        part = rows.select("doc_id", F.lit(kind).alias("flag_type"), optional("rank", "int"), optional("detail", "string"))
        out = part if out is None else out.unionByName(part)
    if routed is None:
        return out
    return out.join(routed.select("doc_id", "reason"), "doc_id", "left").select("doc_id", "flag_type", "rank", "detail", F.coalesce(F.col("reason") == F.col("flag_type"), F.lit(False)).alias("routed"))
