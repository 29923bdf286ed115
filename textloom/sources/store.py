"""A folder of tables that a run of the loop reads and writes: tables by name, runs and their costs, labels by run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources import tables

#: A run is what its events say: the last status, the first and the last time.
RUN_EVENTS = "run_id string, stage string, model string, ts timestamp, status string, note string"
META = "key string, value string"


class Store:
    """Tables below a folder of any store that Spark writes to; missing ones are empty.

    `replace` writes a new version and then names it in a pointer table, so a
    reader sees the old rows or the new ones; `append` adds to a log.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas = tables.SCHEMAS | {"run_events": RUN_EVENTS, "meta": META}

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{at}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def _versions(self, name: str) -> list[str]:
        """Finished versions, oldest first."""
        fs = self._fs()
        if not fs.exists(self._path(name)):
            return []
        found = [f.getPath().getName() for f in fs.listStatus(self._path(name))]
        return sorted(v for v in found if v.startswith("v=") and fs.exists(self._path(f"{name}/{v}/_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        """The newest version, or all rows of a log."""
        if versions := self._versions(name):
            return self.spark.read.parquet(f"{self.root}/{name}/{versions[-1]}")
        if self.exists(name):
            return self.spark.read.parquet(f"{self.root}/{name}")
        return self.spark.createDataFrame([], self.schemas[name])

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows as the table's only ones, however often this is done; the version before the last is deleted."""
        versions = self._versions(name)
        number = int(versions[-1][2:]) + 1 if versions else 1
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v={number:08d}")
        for old in versions[:-1]:
            self._fs().delete(self._path(f"{name}/{old}"), True)
        return self.read(name)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        return self.replace(name, tables.upsert(self.read(name), rows, keys))

    # Runs

    def _event(self, run_id: str, stage: str, model: str | None, status: str, note: str | None) -> None:
        row = self.spark.createDataFrame([(run_id, stage, model, status, note)], "run_id string, stage string, model string, status string, note string").withColumn("ts", F.current_timestamp())
        self.append("run_events", row.select("run_id", "stage", "model", "ts", "status", "note"))

    def start(self, stage: str, model: str | None = None) -> str:
        run_id = f"{stage}-{uuid.uuid4().hex[:12]}"
        self._event(run_id, stage, model, "running", None)
        return run_id

    def finish(self, run_id: str, status: str = "ok", note: str | None = None) -> None:
        self._event(run_id, run_id.rpartition("-")[0], None, status, note)

    def runs(self) -> DataFrame:
        """run_id, stage, model, started_at, finished_at (null while it runs), status, cost_usd, note."""
        order = F.struct("ts", F.col("status") != "running")
        events = self.read("run_events").groupBy("run_id").agg(
            F.min("stage").alias("stage"), F.max("model").alias("model"), F.min("ts").alias("started_at"), F.max(F.when(F.col("status") != "running", F.col("ts"))).alias("finished_at"),
            F.max_by("status", order).alias("status"), F.max_by("note", order).alias("note"))
        costs = self.read("costs").groupBy("run_id").agg(F.sum("usd").alias("usd"))
        return events.join(costs, "run_id", "left").select("run_id", "stage", "model", "started_at", "finished_at", "status", F.coalesce("usd", F.lit(0.0)).alias("cost_usd"), "note")

    def spent(self) -> float:
        return self.read("costs").agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd")).first()["usd"]

    def record_costs(self, run_id: str, costs: DataFrame) -> None:
        """Costs of calls (call_id, model, tokens_in, tokens_out, usd, ts); a call that is recorded again replaces itself."""
        self.upsert("costs", costs.select("call_id", F.lit(run_id).alias("run_id"), "model", "tokens_in", "tokens_out", "usd", "ts"), ["call_id"])

    # Labels and settings

    def write_labels(self, rows: DataFrame) -> None:
        tables.write_labels(rows, f"{self.root}/labels")

    def latest_labels(self, source: str) -> DataFrame:
        return tables.latest_labels(self.read("labels"), self.runs(), source)

    def set_meta(self, key: str, value: str) -> None:
        self.upsert("meta", self.spark.createDataFrame([(key, value)], META), ["key"])

    def meta(self, key: str) -> str | None:
        row = self.read("meta").where(F.col("key") == key).first()
        return row["value"] if row else None
