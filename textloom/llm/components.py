"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._util import stash


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) for every id of edges (a, b), both long and not null.

    Every round takes the least label of an id's neighbours and then that
    label's own label, and is written to the shared folder, so a lost executor
    costs at most a round. Nothing but a count reaches the driver. No edges
    give no rows.
    """
    both = stash(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "components-edges")
    labels = stash(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "components-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        met = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = met.join(labels.select(F.col("id").alias("label"), F.col("label").alias("next")), "label", "left")
        found = stash(jumped.select("id", "old", F.least(F.col("label"), F.coalesce("next", "label")).alias("label")), "components-labels")
        labels = found.select("id", "label")
        if found.where("old <> label").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
