"""Agreement between annotators: raw agreement, kappa, confusion, per-class counts, compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(rows: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """pair (a/b), x, y, n: in one scan, how many rows have both labels of each pair of columns (a, b)."""
    each = F.array(*[F.struct(F.lit(f"{a}/{b}").alias("pair"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs])
    return rows.select(F.explode(each).alias("c")).select("c.*").where("x IS NOT NULL AND y IS NOT NULL").groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def _every(counts: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """The counts with a row of none for each pair, so that pairs without rows are not lost."""
    none = F.array(*[F.lit(f"{a}/{b}") for a, b in pairs])
    one = counts.sparkSession.range(1).select(F.explode(none).alias("pair"), F.lit(None).cast("string").alias("x"), F.lit(None).cast("string").alias("y"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(one)


def _same() -> Column:
    return F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n"))), F.lit(0))


def agreements(rows: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """pair, n, matches, agreement over rows where both labels are there; agreement is null for n = 0."""
    sums = _every(cells(rows, pairs), pairs).groupBy("pair").agg(F.sum("n").alias("n"), _same().alias("matches"))
    return sums.select("pair", "n", "matches", F.try_divide("matches", "n").alias("agreement"))


def kappas(rows: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """Cohen's kappa of each pair of columns from one pass of counts: pair, n, observed, expected, kappa (null where expected is 1 or there are no rows)."""
    counts = _every(cells(rows, pairs), pairs)
    # Each count once for its row and once for its column; what both sum to for a label is multiplied.
    ends = counts.select("pair", F.explode(F.array(F.struct(F.col("x").alias("k"), F.col("n").alias("nx"), F.lit(0).cast("long").alias("ny")), F.struct(F.col("y").alias("k"), F.lit(0).cast("long").alias("nx"), F.col("n").alias("ny")))).alias("e"))
    margins = ends.groupBy("pair", "e.k").agg(F.sum("e.nx").alias("nx"), F.sum("e.ny").alias("ny"))
    chance = margins.groupBy("pair").agg(F.sum(F.col("nx") * F.col("ny")).alias("chance"))
    total = counts.groupBy("pair").agg(F.sum("n").alias("n"), _same().alias("same"))
    observed, expected = F.try_divide("same", "n"), F.try_divide(F.col("chance"), F.col("n") * F.col("n"))
    return total.join(chance, "pair").select("pair", "n", observed.alias("observed"), expected.alias("expected"), F.when(F.col("chance") < F.col("n") * F.col("n"), (observed - expected) / (1 - expected)).alias("kappa"))


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rows by both labels."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("label_a"), F.col(b).alias("label_b")).agg(F.count(F.lit(1)).alias("n"))


def top_confusions(rows: DataFrame, a: str, b: str, k: int = 10) -> DataFrame:
    return confusion(rows, a, b).where("label_a <> label_b").orderBy(F.desc("n"), "label_a", "label_b").limit(k)


def per_class(rows: DataFrame, given: str, reference: str) -> DataFrame:
    """Of each label: tp, n_given, n_ref and tp over either (zero where that is zero)."""
    cells = confusion(rows, given, reference)
    per = cells.select(F.explode(F.array(
        F.struct(F.col("label_a").alias("label"), F.col("n").alias("g"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("t")),
        F.struct(F.col("label_b").alias("label"), F.lit(0).cast("long").alias("g"), F.col("n").alias("r"), F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0).cast("long").alias("t")))).alias("x")).select("x.*")
    sums = per.groupBy("label").agg(F.sum("t").alias("tp"), F.sum("g").alias("n_given"), F.sum("r").alias("n_ref"))
    return sums.select("*", F.coalesce(F.try_divide("tp", "n_ref"), F.lit(0.0)).alias("tp_over_ref"), F.coalesce(F.try_divide("tp", "n_given"), F.lit(0.0)).alias("tp_over_given"))


def compatibility(rows: DataFrame, label: str, leaves: str) -> DataFrame:
    """How many labels lie in the set that the other label covers, of those that can be compared; and what can't."""
    comparable = F.col(label).isNotNull() & (F.size(leaves) > 0)
    inside = comparable & F.array_contains(leaves, F.col(label))
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return rows.agg(total(comparable).alias("comparable"), total(inside).alias("compatible"), total(F.size(leaves) > 1).alias("coarse"), total(F.size(leaves) == 0).alias("unmappable"), total(F.col(label).isNull()).alias("unlabeled")).select(
        "*", F.try_divide("compatible", "comparable").alias("rate"))


def distribution(rows: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Labels by source; a source with a set of labels counts once for each, an empty set as (none)."""
    parts = []
    for source, column in sources.items():
        kind = rows.schema[column].dataType.typeName()
        label: Column = F.explode_outer(column) if kind == "array" else F.col(column)
        parts.append(rows.select(F.lit(source).alias("source"), label.alias("label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source", F.coalesce("label", F.lit("(none)")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def mean_confidence(rows: DataFrame, confidence: str, abstain: str) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(F.col(abstain).cast("long")), F.lit(0)).alias("abstained"), F.avg(F.when(~F.col(abstain), F.col(confidence))).alias("mean_confidence"))
