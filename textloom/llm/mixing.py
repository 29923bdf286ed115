"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length. For each source the
target is made of whole passes over all its documents and a remaining budget.
Of each length, the budget's share of documents is taken; what then remains is
met by a bounded-knapsack programme over the lengths that are left. Seeded
hashes select the documents of each length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._util import SPACE, group_rank, stash, text_or_empty

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
SEED = 20260904
#: The remaining budget that the knapsack programme takes over; it needs an eighth of so many bytes for each step.
KNAPSACK = 1 << 16


def words(text):
    """Number of runs of characters other than ASCII white space."""
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Shares of the sum of all sizes by weight; none above `most` times its size, what is over goes to the others by weight."""
    named = sorted((s for s in sizes if s[0] is not None), key=lambda s: [ord(c) for c in s[0]]) + [s for s in sizes if s[0] is None]
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(named)}
    size = dict(named)
    budget, free, out = float(sum(size.values())), list(size), {}
    while free:
        share = budget / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > most * size[s]]
        if not over:
            return out | {s: share * weight[s] for s in free}
        for s in over:
            out[s] = float(most * size[s])
            budget -= out[s]
        free = [s for s in free if s not in out]
    return out


def fit(size: np.ndarray, count: np.ndarray, budget: int, seed: int, times: int = 1, knapsack: int = KNAPSACK) -> np.ndarray:
    """How many copies of documents of each size to take for a sum as near the budget as can be: once each, in proportion,
    and up to `times` for what the proportional share leaves."""
    order = np.argsort(size, kind="stable")
    size, count = size[order].astype(np.int64), count[order].astype(np.int64)
    whole = int((size * count).sum())
    out = np.zeros(len(size), np.int64)
    if budget >= whole:
        out[order] = count
        return out
    room = count * times
    take = np.floor(count * (budget / whole)).astype(np.int64) if whole else np.zeros(len(size), np.int64)
    left = budget - int((size * take).sum())
    # One more of some lengths, in seeded order, until the programme below can cover the rest.
    for i in np.random.default_rng(seed).permutation(len(size)):
        if left <= knapsack // 2:
            break
        n = min(int(room[i] - take[i]), (left - knapsack // 4) // max(1, int(size[i])), 1)
        if n > 0:
            take[i] += n
            left -= n * int(size[i])
    i = len(size) - 1
    while left > knapsack // 2 and i >= 0:  # few lengths, many documents: more of the longest
        n = min(int(room[i] - take[i]), left // max(1, int(size[i])))
        take[i] += n
        left -= n * int(size[i])
        i -= 1
    # Bounded knapsack: bit s of `sums` says that s can be made of the documents not yet taken, in binary bundles.
    top = int(min(2 * left + (size[0] if len(size) else 0), 2 * knapsack))
    mask, sums, steps = (1 << (top + 1)) - 1, 1, []
    for i in range(len(size)):
        rest, bundle, s = int(room[i] - take[i]), 1, int(size[i])
        if not 0 < s <= top:
            continue
        rest = min(rest, top // s)
        while rest and not sums >> left & 1:
            n = min(bundle, rest)
            grown = (sums | sums << (n * s)) & mask
            if grown != sums:
                steps.append((i, n, sums))
                sums = grown
            rest, bundle = rest - n, bundle * 2
        if sums >> left & 1:
            break
    below = (sums & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = sums >> (left + 1)
    above = left + 1 + ((above & -above).bit_length() - 1) if above else None
    goal = above if above is not None and above - left < left - below else below
    larger = next((i for i in range(len(size)) if size[i] > top and room[i] > take[i]), None)
    if larger is not None and abs(int(size[larger]) - left) < abs(goal - left):  # one document beyond the programme's range
        take[larger] += 1
        goal = 0
    for i, n, before in reversed(steps):
        if not before >> goal & 1:
            take[i] += n
            goal -= n * int(size[i])
    out[order] = take
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """How often each document of docs (doc_id, text, source) takes part in the mix.

    Returns doc_id, source, size (words), source_size, target, taken (size times
    repeats), copies (that number) and the columns in `keep`. A null text has
    size 0, a null source is a source of its own and comes last. Documents of
    size 0 take no part (copies 0). Rows that repeat count each for itself. Which
    documents of a length are taken follows a seeded hash of doc_id and text, so
    reruns agree whatever the order of rows; of rows equal in both it makes no
    difference which is taken. Very long texts count whole. Other columns of
    docs are not read, whatever their names. An empty table gives no rows. Any
    number of sources is fitted in parallel, from one histogram row per source
    and distinct length.
    """
    size = words(text_or_empty())
    rows = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.col("source").cast("string").alias("source"), *keep, F.xxhash64(F.lit(seed), "doc_id", text_or_empty()).alias("_seeded")), "mixing-rows")
    lengths = stash(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mixing-lengths")
    by_source = [(r["source"], r["s"]) for r in lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()]  # one row per source
    goal = targets(by_source, weights, most)
    per_source = rows.sparkSession.createDataFrame([(s, int(n), float(goal[s])) for s, n in by_source], "source string, source_size long, target double")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        passes = min(most, int(target // whole)) if whole else 0
        rest = min(whole, round(target - passes * whole)) if passes < most else 0
        part = part.sort_values("size", ignore_index=True)
        more = fit(part["size"].to_numpy(np.int64), part["n"].to_numpy(np.int64), rest, seed, most - passes)
        return pd.DataFrame({"source": part["source"], "size": part["size"], "source_size": whole, "target": target, "passes": np.int32(passes), "n": part["n"], "more": more})

    # Lengths are few however many the documents; the source of most documents has no more of them than any other.
    plan = lengths.join(per_source, lengths["source"].eqNullSafe(per_source["source"])).select(lengths["*"], "source_size", "target") \
        .groupBy("source").applyInPandas(run, "source string, size long, source_size long, target double, passes int, n long, more long")
    plan = stash(plan, "mixing-plan")
    ranked = group_rank(rows, ["source", "size"], F.col("_seeded"), "_rank")
    extra = F.floor(F.col("more") / F.col("n")) + (F.col("_rank") < F.col("more") % F.col("n")).cast("int")
    copies = F.when(F.col("p.size") == 0, 0).otherwise(F.col("passes") + extra).cast("int")
    return ranked.alias("r").join(plan.alias("p"), (F.col("r.size") == F.col("p.size")) & F.col("r.source").eqNullSafe(F.col("p.source"))).select(
        "r.doc_id", "r.source", "r.size", "source_size", "target", (F.col("r.size") * copies).alias("taken"), copies.alias("copies"), *[F.col(f"r.{c}") for c in keep])


def op9_subset_sum_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents, and source; nulls, repeated rows and the like as in mix()."""
    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source")
