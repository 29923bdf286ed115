"""Runs, costs and review times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators.ranking import rank_within

COST_CAP = 3.00
FAST_RUN, FAST_FLOOR, FLOOR_BAND = 3, 1.0, (0.5, 3.0)


def by_stage(costs: DataFrame, runs: DataFrame) -> DataFrame:
    """calls, tokens and usd by stage of costs (run_id, tokens_in, tokens_out, usd) and runs (run_id, stage)."""
    return costs.join(runs, "run_id").groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("usd").alias("usd"))


def running(costs: DataFrame, by: list[str], usd: str = "usd") -> DataFrame:
    """costs (call_id, ts, usd, ...) with what was spent before each call within `by`."""
    before = Window.partitionBy(*by).orderBy("ts", "call_id").rowsBetween(Window.unboundedPreceding, -1)
    return costs.withColumn("spent_before", F.coalesce(F.sum(usd).over(before), F.lit(0)))


def over_cap(costs: DataFrame, by: list[str], cap: float = COST_CAP, usd: str = "usd") -> DataFrame:
    """Calls that would pass the cap, at their worst-case cost."""
    return running(costs, by, usd).where(F.col("spent_before") + F.col(usd) > cap)


def latest_runs(runs: DataFrame, ok_only: bool = True) -> DataFrame:
    """The latest run of each stage (runs: run_id, stage, started_at, status), ties by the larger run_id."""
    rows = runs.where("status = 'ok'") if ok_only else runs
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("started_at"), F.desc("run_id")))).where("_n = 1").drop("_n")


def run_states(events: DataFrame) -> DataFrame:
    """Of an event log (run_id, ts, status, usd): each run's last status, start, end and cost."""
    return events.groupBy("run_id").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.sum("usd").alias("usd"))


def nth_of(rows: DataFrame, by: list[str], value: str, place, name: str) -> DataFrame:
    """The value at a place (from 0, a function of how many there are) of each group's sorted values."""
    rows = rows.select(*by, F.col(value).alias(name))
    ranked = rank_within(rows, by, [F.asc(name)], "_i")
    sizes = ranked.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(by)]).agg(F.count(F.lit(1)).alias("n"))
    on = [ranked[k].eqNullSafe(sizes[f"_g{i}"]) for i, k in enumerate(by)]
    return ranked.join(sizes, on).where(F.col("_i") - 1 == place(F.col("n"))).select(*by, "n", name)


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value in the middle, the upper of two; not interpolated."""
    return nth_of(rows, by, value, lambda n: F.floor(n / 2), "upper_median")


def fast_floor(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Seconds below which a decision is fast: the fifth percentile by place, from 0.5 to 3; 1 for fewer than 20."""
    at = nth_of(rows, by, value, lambda n: F.greatest(F.lit(0), F.floor(n * 5 / 100) - 1), "at")
    return at.select(*by, "n", F.when(F.col("n") < 20, FAST_FLOOR).otherwise(F.greatest(F.lit(FLOOR_BAND[0]), F.least(F.lit(FLOOR_BAND[1]), F.col("at")))).alias("floor"))


def fast_runs(rows: DataFrame, by: str, order: str, decision: str, seconds: str, floor: float = FAST_FLOOR, least: int = FAST_RUN) -> DataFrame:
    """Stretches of at least `least` decisions in a row that are the same and fast: by, first and last order value, decision, length."""
    w = Window.partitionBy(by).orderBy(order)
    rows = rows.withColumn("_fast", F.col(seconds) < floor)
    breaks = ~F.col("_fast") | ~F.lag("_fast").over(w).eqNullSafe(F.lit(True)) | ~F.lag(decision).over(w).eqNullSafe(F.col(decision))
    rows = rows.withColumn("_break", breaks.cast("int"))
    rows = rows.withColumn("_island", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("_fast").groupBy(by, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.min(decision).alias("decision"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).drop("_island")


def decisions(rows: DataFrame) -> DataFrame:
    """count, seconds, minutes and mean seconds by decision."""
    return rows.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds")).select("*", (F.col("seconds") / 60).alias("minutes"), (F.col("seconds") / F.greatest(F.lit(1), F.col("n"))).alias("mean_seconds"))
