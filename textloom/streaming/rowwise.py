"""Structured Streaming forms of what works on one row at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions import text as T
from textloom.operators import labeling


def scrubbed(stream: DataFrame, column: str = "text") -> DataFrame:
    """The stream with personal data replaced in `column`, and how many spans there were."""
    spans = T.pii_spans(F.col(column))
    found = stream.withColumn("_spans", spans)
    return found.withColumn(column, F.when(F.size("_spans") > 0, T.scrub(F.col(column), F.col("_spans"))["text"]).otherwise(F.col(column))).withColumn("n_spans", F.size("_spans")).drop("_spans")


def labeled(stream: DataFrame, weights: list[tuple[str, str, int]], leaves: list[str], stopwords: tuple[str, ...] = T.STOPWORDS) -> DataFrame:
    """Labels of a stream of doc_id, subject, body; needs no state."""
    return labeling.label(stream, weights, leaves, stopwords)


def write(stream: DataFrame, path: str, checkpoint: str, per_batch: Callable[[DataFrame, int], DataFrame] | None = None) -> StreamingQuery:
    """Appends what is there now to a Parquet folder; each batch is written once under its number, so a repeated one replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        (per_batch(batch, number) if per_batch else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
