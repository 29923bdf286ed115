"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id). Splitters that cut this order
into shards of equal bytes are found by counting: each round, every partition
counts exact bytes between candidate boundaries, and the boundaries around
each target are moved together until a splitter is within tolerance. Only
then do the rows move, once, dealt by hashes within their shard to be counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._util import group_rank, stash, text_or_empty

SHARDS = 24
#: A splitter may be off its target by this share of a shard's bytes.
TOLERANCE = 0.01
FIRST_BITS, STEP_BITS = 16, 8
LOW, HIGH = -(2**63), 2**63 - 1


def finer(rows: DataFrame, column: str, shift: int, parents: dict[tuple[int | None, int], int] | None, parent_shift: int) -> dict[tuple[int | None, int], tuple[int, int]]:
    """Exact bytes and rows between probes that are 2 ** shift apart, inside the given brackets only: {(h or None, probe): (bytes, rows)}."""
    fixed = F.col("h") if column == "g" else F.lit(None).cast("long")
    if parents is not None:
        rows = rows.where(F.shiftright(column, parent_shift).isin(sorted({p for _, p in parents}))) if parent_shift < 64 else rows
        rows = rows.where(F.col("h").isin(sorted({h for h, _ in parents}))) if column == "g" else rows
    counts = rows.groupBy(fixed.alias("fixed"), F.shiftright(column, shift).alias("probe")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return {(r["fixed"], r["probe"]): (r["bytes"], r["n"]) for r in counts.collect()}


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Sorted boundaries (h, g), one between any two shards: a row belongs below a boundary if its (h, g) is at most it.

    Probes start 2 ** FIRST_BITS to the key range; the bracket that holds a target
    is then probed STEP_BITS finer, for all targets at once, until one of its
    ends is within tolerance or it holds a single row. A bracket that has shrunk
    to one h (a group of copies) goes on with g. A round brings at most
    2 ** STEP_BITS rows for each target to the driver, whatever the corpus.
    """
    first = rows.agg(F.sum("size").alias("bytes"), F.min("g").alias("low"), F.max("g").alias("high")).first()
    total = first["bytes"] or 0
    if not total:
        return [(LOW, LOW)] * (shards - 1)
    goal = {i: total * i / shards for i in range(1, shards)}
    slack = total / shards * tolerance
    done: dict[int, tuple[int, int]] = {}
    column, shift, above = "h", 64 - FIRST_BITS, 64
    around = {i: (None, 0, 0) for i in goal}  # the h that g is searched in, the bracket, bytes below it
    while around:
        found = finer(rows, column, shift, None if above == 64 and column == "h" else {(h, p): 0 for h, p, _ in around.values()}, above)
        inside: dict[tuple[int | None, int], list[int]] = {}
        for h, p in sorted(found, key=lambda x: (x[0] or 0, x[1])):
            inside.setdefault((h, p >> (above - shift) if above < 64 else 0), []).append(p)
        for i, (h, bracket, below) in list(around.items()):
            for p in inside[h, bracket]:
                size, count = found[h, p]
                if below + size > goal[i] or p == inside[h, bracket][-1]:
                    break
                below += size
            low, high = (p << shift) - 1, ((p + 1) << shift) - 1
            if min(goal[i] - below, abs(below + size - goal[i])) <= slack or count == 1 or shift == 0 and column == "g":
                x = low if goal[i] - below <= below + size - goal[i] else high
                done[i] = (h, max(x, LOW)) if column == "g" else (max(x, LOW), HIGH if x >= LOW else LOW)
                del around[i]
            else:
                around[i] = (h, p, below)
        if shift:
            above, shift = shift, max(0, shift - STEP_BITS)
        elif around:
            column, above = "g", 64
            shift = max(0, (int(first["high"]) - int(first["low"])).bit_length() - STEP_BITS)
            around = {i: (p, 0, below) for i, (_, p, below) in around.items()}
    return sorted(done.values())


def shard_of(bounds: list[tuple[int, int]]) -> Column:
    """The number of boundaries below a row's (h, g)."""
    longs = lambda x: F.array(*[F.lit(int(v)) for v in x]).cast("array<long>")
    below = F.size(F.filter(longs(h for h, _ in bounds), lambda b: b < F.col("h")))
    if cut := [b for b in bounds if b[1] != HIGH]:  # boundaries within a group of copies
        below = below + F.size(F.filter(F.arrays_zip(longs(h for h, _ in cut).alias("h"), longs(g for _, g in cut).alias("g")), lambda b: (b["h"] == F.col("h")) & (b["g"] < F.col("g"))))
    return below.cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Deals docs (doc_id, text) into shards of near equal bytes, equal texts together.

    Returns doc_id, size (UTF-8 bytes of the text and 8), text_crc32, law
    (`bytes`), shard, slot (gapless from 0 in each shard) and grown_shard
    (null under this law). A null text counts as empty, a null doc_id orders
    first, a very long text is one row that a shard may exceed its share by.
    Equal texts stay in one shard unless a shard boundary would then miss
    its target by more than `tolerance` of a shard; such a group is cut by
    doc_id. Rows equal in both stay together and take their slots in any order.
    Other columns are not read. An empty table gives no rows.
    """
    text = text_or_empty()
    rows = stash(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("g")), "sharding-rows")
    dealt = rows.withColumn("shard", shard_of(splitters(rows, shards, tolerance)) if shards > 1 else F.lit(0))
    return group_rank(dealt, ["shard"], F.xxhash64("h", "g"), "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_histogram_sharding(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents; nulls, repeated rows and the like as in shard()."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
