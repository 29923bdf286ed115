"""Ranks over a whole table, or within keys of any size, without putting them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.sources.tables import shuffle_partitions, written


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `name`, the place of each row from 1 by `order`, which should be total.

    Rows are dealt into ranges and written; each range ranks its own rows from
    where the ranges before it end. Only one count per range meets in a task.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "rank")
    starts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_start")
    return dealt.join(F.broadcast(starts), "_p").withColumn(name, place.cast("int")).drop("_p", "_start")


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds `name`, the place of each row from 1 by `order` among the rows with its keys, though one key may hold any share of the rows.

    The table is ranked as a whole by keys and order, and each key's first place taken off.
    """
    ranked = written(global_rank(df, [*[F.asc(k) for k in keys], *order], "_place"), "rank")
    first = ranked.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_place").alias("_first"))
    on = [ranked[k].eqNullSafe(first[f"_k{i}"]) for i, k in enumerate(keys)]
    return ranked.join(first, on).select(*[ranked[c] for c in df.columns], (F.col("_place") - F.col("_first") + 1).alias(name))


def group_rank(df: DataFrame, keys: list[str], order: Column, name: str) -> DataFrame:
    """Adds `name`, a gapless rank from 0 within `keys`, though one key may hold any share of the rows.

    Each key is split by a hash of `order` into several times as many buckets as
    there are shuffle partitions; ranks are counted within buckets and start at
    the sum of the buckets before. df is read twice, so pass a written table.
    Rows that tie in `order` get their ranks in any order.
    """
    buckets = 8 * max(8, shuffle_partitions(df.sparkSession))
    dealt = df.withColumn("_o", order).withColumn("_b", F.pmod(F.xxhash64("_o"), F.lit(buckets)).cast("int"))
    starts = (
        dealt.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), F.col("_n"))
    )
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_kb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_o")))
    on = [within["_b"] == starts["_kb"], *[within[k].eqNullSafe(starts[f"_k{i}"]) for i, k in enumerate(keys)]]
    return within.join(starts, on).select(*[within[c] for c in df.columns], (F.col("_start") + F.col("_r") - 1).alias(name))
