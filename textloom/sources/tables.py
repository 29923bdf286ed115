"""Reading and writing tables: keyed upserts, JSON lines, written intermediate tables, key-value and JSON documents."""

from __future__ import annotations

import gc
import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMAS = {
    "tickets": "ticket_id string, subject string, body string, channel string, tier string, created_at timestamp, vendor_label string",
    "runs": "run_id string, stage string, model string, started_at timestamp, finished_at timestamp, status string, cost_usd double, note string",
    "labels": "run_id string, ticket_id string, source string, label string, confidence double, rationale string, abstain boolean",
    "adjudications": "ticket_id string, decision string, final_label string, reviewer string, ts timestamp, seconds double",
    "costs": "call_id string, run_id string, model string, tokens_in long, tokens_out long, usd double, ts timestamp",
    "cache": "cache_key string, model string, response string, tokens_in long, tokens_out long, created_at timestamp",
    "dataset": "ticket_id string, label string, alt_label string, body string, status string, reason string",
}


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    if ":" not in base:  # a path in the cluster's default store
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", base).rstrip("/")


#: With it, Spark deletes a query's shuffles as the query ends; else they stay until the driver's JVM has collected its plan, which may be several queries later.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that later uses neither recompute it nor depend on an executor. It is deleted when the driver ends, its shuffles now."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before) if before else spark.conf.unset(FREED)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, and shuffles of plans that are no longer held.

    What was made of the tables must be written by then.
    """
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Deletes shuffles of plans that are no longer held: Spark deletes those of what the driver's JVM has collected."""
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame, per_core: int = 8 << 20) -> DataFrame:
    """Deals out the rows of a small table that has fewer files than there are cores; any other table stays as it is.

    A single file of one row group is read by one task, which work on texts would then keep to.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * per_core and len(df.inputFiles()) < cores else df


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the last by `order`, which should be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[o.desc() for o in order]))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def without(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """rows except those with a key of targets."""
    return rows.join(targets.select(*keys).distinct(), keys, "left_anti")


def read_json_lines(spark: SparkSession, path: str, schema: str, drop: Column | None = None) -> DataFrame:
    """Rows of a file of JSON lines, without blank lines; `drop` names rows to leave out."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows.where(~F.coalesce(drop, F.lit(False))) if drop is not None else rows


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> None:
    """JSON lines with sorted keys; null fields are left out."""
    rows = df.select(*sorted(df.columns))
    (rows.coalesce(files) if files else rows).write.mode(mode).json(path)


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.trim("value") != "").count()


def write_labels(df: DataFrame, path: str) -> None:
    """Labels by source and run, which later reads prune by; a run that is written again replaces its own rows only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "run_id").parquet(path)


def labels_of(spark: SparkSession, path: str, source: str, run_id: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["labels"]).parquet(path).where((F.col("source") == source) & (F.col("run_id") == run_id))


def newest_runs(labels: DataFrame, runs: DataFrame) -> DataFrame:
    """source and run_id: of each source of labels (run_id, source) the newest successful run (runs: run_id, started_at, status), ties by the larger run_id."""
    ok = labels.select("source", "run_id").distinct().join(runs.where("status = 'ok'").select("run_id", "started_at"), "run_id")
    return ok.groupBy("source").agg(F.max(F.struct("started_at", "run_id")).alias("m")).select("source", F.col("m.run_id").alias("run_id"))


def latest_labels(labels: DataFrame, runs: DataFrame, source: str | None = None) -> DataFrame:
    """The labels of each source's newest successful run, or of one source's; labels of other runs are not read beyond their partition."""
    some = labels if source is None else labels.where(F.col("source") == source)
    return some.join(F.broadcast(newest_runs(some, runs)), ["source", "run_id"], "left_semi")


def metrics_document(df: DataFrame) -> str:
    """A one-row table as a JSON document with sorted keys."""
    row = df.select(F.to_json(F.struct(*sorted(df.columns))).alias("j")).first()
    return json.dumps(json.loads(row["j"]), indent=2, sort_keys=True, ensure_ascii=False) if row else "{}"


def markdown(title: str, tables: dict[str, DataFrame], limit: int = 50) -> str:
    """A report of small tables."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in df.limit(limit).collect()] + [""]
    return "\n".join(out)
