"""Scores of a labeled set against truth, and the gates of a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GATES = {"delta_points": (">=", 5.0), "seeded_recall": (">=", 0.85), "leaks": ("<=", 0.0), "duplicate_recall": (">=", 0.80), "cost_usd": ("<=", 3.00)}


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))


def correct(label: str = "label", targets: str = "targets", truth: str = "truth", alternate: str | None = None) -> Column:
    """The leaves that a label stands for hold the true one, or the acceptable alternate."""
    hit = F.coalesce(F.array_contains(targets, F.col(truth)), F.lit(False))
    return hit | F.coalesce(F.array_contains(targets, F.col(alternate)), F.lit(False)) if alternate else hit


def accuracy(rows: DataFrame, name: str, ok: Column) -> DataFrame:
    """name, n, hits, value; value is 0 for no rows."""
    return rows.agg(F.count(F.lit(1)).alias("n"), _sum(ok).alias("hits")).select(F.lit(name).alias("name"), "n", "hits", F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)).alias("value"))


def recall_precision(rows: DataFrame, planted: Column, found: Column) -> DataFrame:
    """planted, found, both, recall, precision; zero where nothing is planted or found."""
    return rows.agg(_sum(planted).alias("planted"), _sum(found).alias("found"), _sum(planted & found).alias("both")).select(
        "*", F.coalesce(F.try_divide("both", "planted"), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide("both", "found"), F.lit(0.0)).alias("precision"))


def seeded_errors(rows: DataFrame, planted: Column, flagged: Column, corrected: Column) -> DataFrame:
    """planted, flagged (planted errors that were flagged), recall, corrected (flagged ones that the labels now have right) and the share of those flagged."""
    sums = rows.agg(_sum(planted).alias("planted"), _sum(planted & flagged).alias("flagged"), _sum(planted & flagged & corrected).alias("corrected"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select("planted", "flagged", ratio("flagged", "planted").alias("recall"), "corrected", ratio("corrected", "flagged").alias("correction_rate"))


def unreachable(rows: DataFrame, leaves: list[str], truth: str = "truth") -> DataFrame:
    """n and unreachable: how many rows have a truth that no leaf stands for; each of them is an error whatever its label."""
    return rows.agg(F.count(F.lit(1)).alias("n"), _sum(F.col(truth).isin(*leaves)).alias("unreachable"))


def delta_points(accuracies: DataFrame, before: str = "v1", after: str = "v2") -> DataFrame:
    """delta_points, from accuracies (name, value): null where either is missing."""
    value = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    return accuracies.agg((100 * (value(after) - value(before))).alias("delta_points"))


def pair_recall(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """How many planted pairs (pair_id, doc_id) lie in one cluster (doc_id, component) whole."""
    inside = pairs.join(clusters, "doc_id").groupBy("pair_id", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = pairs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("size"))
    hit = inside.join(sizes, "pair_id").where("n = size").select("pair_id").distinct().withColumn("hit", F.lit(True))
    return sizes.join(hit, "pair_id", "left").agg(F.count(F.lit(1)).alias("pairs"), _sum(F.col("hit")).alias("found")).select("*", F.coalesce(F.try_divide("found", "pairs"), F.lit(0.0)).alias("recall"))


def cluster_scores(pairs: DataFrame, clusters: DataFrame, shapes: DataFrame) -> DataFrame:
    """pair_recall, and of the clusters (doc_id, component): how many there are, the share that holds a planted pair whole
    (precision), how many do not (unmatched), and how many of these have one shape (doc_id, shape) throughout (explained)."""
    sizes = pairs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("size"))
    inside = pairs.join(clusters, "doc_id").groupBy("pair_id", "component").agg(F.count(F.lit(1)).alias("n"))
    matched = inside.join(sizes, "pair_id").where("n = size").select("component").distinct().withColumn("matched", F.lit(True))
    each = clusters.join(shapes, "doc_id", "left").groupBy("component").agg((F.count_distinct("shape") == 1).alias("one"), F.bool_and(F.col("shape").isNotNull()).alias("all"))
    sums = each.join(matched, "component", "left").withColumn("matched", F.coalesce("matched", F.lit(False))).agg(
        F.count(F.lit(1)).alias("clusters"), _sum(F.col("matched")).alias("_matched"), _sum(~F.col("matched")).alias("unmatched"), _sum(~F.col("matched") & F.col("one") & F.col("all")).alias("explained"))
    sums = sums.select("clusters", F.coalesce(F.try_divide("_matched", "clusters"), F.lit(0.0)).alias("precision"), "unmatched", "explained")
    return pair_recall(pairs, clusters).join(sums, F.lit(True))


def abstention(rows: DataFrame, ambiguous: Column, other_ok: Column) -> DataFrame:
    """Whether the first annotator abstains where it is hard: the share of ambiguous rows among abstained ones against all,
    and the second annotator's accuracy where the first abstained and where it answered."""
    a = F.col("a_abstain")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), _sum(a).alias("abstained"), _sum(ambiguous).alias("ambiguous"), _sum(a & ambiguous).alias("both"), _sum(a & other_ok).alias("ok_abstained"), _sum(~a & other_ok).alias("ok_answered"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    base, share = ratio("ambiguous", "n"), ratio("both", "abstained")
    return sums.select("n", "abstained", base.alias("base_rate"), share.alias("share"), F.coalesce(F.try_divide(share, base), F.lit(0.0)).alias("concentration"),
                       ratio("ok_abstained", "abstained").alias("accuracy_abstained"), ratio(F.col("ok_answered"), F.col("n") - F.col("abstained")).alias("accuracy_answered"))


def gates(metrics: DataFrame) -> DataFrame:
    """name, value, bound, result of metrics (name, value): pass, FAIL, or not evaluable for a missing value."""
    bound = F.create_map(*[x for k, (_, v) in GATES.items() for x in (F.lit(k), F.lit(v))])
    least = F.col("name").isin(*[k for k, (op, _) in GATES.items() if op == ">="])
    rows = metrics.where(F.col("name").isin(*GATES)).withColumn("bound", bound[F.col("name")])
    ok = F.when(least, F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return rows.select("name", "value", "bound", F.when(F.col("value").isNull(), "not evaluable").when(ok, "pass").otherwise("FAIL").alias("result"))


def failed(results: DataFrame) -> bool:
    """Whether any gate fails; what is not evaluable does not."""
    return not results.where("result = 'FAIL'").isEmpty()


def severity(delta_points: Column) -> Column:
    return F.when(delta_points >= GATES["delta_points"][1], "green").otherwise("attention")
