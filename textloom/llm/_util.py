"""Helpers that the training-data operators share: bounded batches and what workers keep."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.ranking import group_rank
from textloom.sources.tables import discard, shuffle_partitions
from textloom.sources.tables import shared_folder as scratch
from textloom.sources.tables import written as stash

__all__ = ["batches", "caches", "discard", "group_rank", "release", "scratch", "shuffle_partitions", "stash", "text_or_empty"]

#: Bytes of an Arrow batch where the session sets no bound.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Between words, which are runs of any other characters.
SPACE = r"[\x20\x09-\x0D]+"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def batches(df: DataFrame) -> DataFrame:
    """Bounds the bytes that one Arrow batch carries into Python, so that whole long texts fit into a worker.

    The session's own bound stands where it has one; it is the same for every plan.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) is None:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df


#: What workers keep between tasks of one operator; any other operator's tasks clear it first.
caches: list[dict] = []


def release(*keep: dict) -> None:
    """Drops what earlier tasks of other operators have kept, and gives freed memory back to the system where the libraries can."""
    for cache in caches:
        if not any(cache is k for k in keep):
            cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
