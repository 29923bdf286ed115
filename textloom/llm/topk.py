"""Exact top-k search by inner product over vector-approximation files.

Every component is quantised to one of 256 cells of its dimension, a byte. The
codes stay where they are: a block of queries of bounded size goes to every
task, where cell edges bound each score from both sides; a candidate stays if
its upper bound reaches the k-th lower bound. The exact vectors of those that
stay are then taken in the order of their bounds until no bound reaches the
k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm._util import stash
from textloom.operators.ranking import global_rank

K = 10
CELLS = 256
#: Components of the queries that go to every task in one round, those that meet a batch of codes at once, and candidates that a task holds.
ROUND, AT_ONCE, HELD = 1 << 19, 64, 1 << 18
#: The candidates of a query are read in so many groups.
SALTS = 8
BOUNDS = "query long, row long, lower double, upper double"


def integers(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """row (a number of its own), vec_id and v, the components times scale, floored; without vectors that are null or have null or non-finite components.

    Rows without a vec_id take no part; rows that share one stand each for itself. Written.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return stash(rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")), "topk-vectors")


def edges(vectors: DataFrame, cells: int = CELLS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension count: the least component and the cell width of each dimension."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part in parts:
            for d, rows in part.groupby(part["v"].map(len))["v"]:
                x = np.stack(rows.to_list()) if d else np.zeros((len(rows), 0), np.int64)
                low, high = seen.get(d, (x[0], x[0]))
                seen[d] = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        yield pd.DataFrame([(d, i, int(a), int(b)) for d, (low, high) in seen.items() for i, (a, b) in enumerate(zip(low, high, strict=True))], columns=["d", "i", "low", "high"])

    found = vectors.select("v").mapInPandas(run, "d long, i long, low long, high long").groupBy("d", "i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d", "i").collect()
    out: dict[int, tuple[list, list]] = {}
    for r in found:  # one row per dimension
        low, width = out.setdefault(r["d"], ([], []))
        low.append(r["low"]), width.append((r["high"] - r["low"]) // cells + 1)
    return {d: (np.array(low, np.int64), np.array(width, np.int64)) for d, (low, width) in out.items()}


def search(embeddings: DataFrame, is_query: Column, k: int = K, scale: int = 1024) -> DataFrame:
    """For each query row, its k best other rows of embeddings (vec_id, embedding): query_id, rank, vec_id, score.

    is_query is a condition on vec_id. Ties go to the smaller vec_id; with fewer
    other rows, all are returned. Only vectors of equal dimension are compared.
    Rows that repeat are queries and candidates each for itself, so one of them
    finds the other. Of equal vectors only the k + 1 smallest vec_ids can be
    among the best, so the others are left out beforehand. Other columns are
    not read. An empty table gives no rows.
    """
    vectors = integers(embeddings, scale)
    same = Window.partitionBy("v").orderBy("vec_id", "row")
    codes_of = edges(vectors)

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            code = [((np.asarray(v) - codes_of[len(v)][0]) // codes_of[len(v)][1]).astype(np.uint8).tobytes() for v in part["v"]]
            yield pd.DataFrame({"row": part["row"], "d": part["v"].map(len).astype("int64"), "code": code})

    kept = vectors.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).select("row", "v")
    codes = stash(kept.mapInPandas(encode, "row long, d long, code binary"), "topk-codes")
    asked = stash(global_rank(vectors.where(is_query).select("row", "v"), [F.asc("row")], "place"), "topk-queries")
    found = vectors.sparkSession.createDataFrame([], BOUNDS)
    at, n = 0, asked.count()
    while at < n:
        some = max(1, ROUND // max(codes_of, default=1))
        block = asked.where((F.col("place") > at) & (F.col("place") <= at + some)).collect()  # at most ROUND components
        found = found.unionByName(stash(bounded(codes, codes_of, {r["row"]: np.array(r["v"], np.int64) for r in block}, k), "topk-bounds"))
        at += some
    best = Window.partitionBy("query").orderBy(F.desc("lower"))
    certain = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k).select(F.col("query").alias("_q"), F.col("lower").alias("_least"))
    near = found.join(certain, found["query"] == certain["_q"], "left").where(F.col("_least").isNull() | (F.col("upper") >= F.col("_least"))).select("query", "row", "upper")

    def exact(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("upper", ascending=False, ignore_index=True)
        q, found = np.asarray(part["q"].iloc[0], np.int64), []
        for i in range(0, len(part), 4 * k):
            if len(found) >= k and part["upper"].iloc[i] < found[k - 1][0]:
                break
            some = part.iloc[i : i + 4 * k]
            scores = np.stack(some["v"].to_list()).astype(np.int64) @ q
            found = sorted([*found, *zip(scores.tolist(), some["vec_id"].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
        return pd.DataFrame({"query": part["query"].iloc[0], "query_id": part["query_id"].iloc[0], "vec_id": [x[1] for x in found], "score": [x[0] for x in found]})

    questions = vectors.where(is_query).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    named = near.join(vectors, "row").join(questions, "query").withColumn("_s", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    scored = named.groupBy("query", "_s").applyInPandas(exact, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec_id")))
    return scored.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def bounded(codes: DataFrame, codes_of: dict[int, tuple[np.ndarray, np.ndarray]], queries: dict[int, np.ndarray], k: int) -> DataFrame:
    """query, row, lower, upper: the candidates of each task for each query, by the codes alone."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_size = {d: ids for d in codes_of if (ids := [i for i, v in queries.items() if len(v) == d])}
        matrix = {d: np.stack([queries[i] for i in ids]).astype(float).reshape(len(ids), d) for d, ids in by_size.items()}
        least = {d: np.full((len(ids), k), -np.inf) for d, ids in by_size.items()}  # the k best lower bounds so far
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def leave() -> pd.DataFrame:
            out = [pd.DataFrame({"query": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "lower": np.zeros(0), "upper": np.zeros(0)})]
            for d, at, row, lower, upper in held:
                good = upper >= least[d][at].min(axis=1)
                out.append(pd.DataFrame({"query": np.array(by_size[d], np.int64)[at[good]], "row": row[good], "lower": lower[good], "upper": upper[good]}))
            held.clear()
            return pd.concat(out, ignore_index=True)

        for part in parts:
            for d, right in part.groupby("d"):
                if d not in by_size:
                    continue
                low, width = codes_of[d]
                ids = right["row"].to_numpy(np.int64)
                cell = low + width * np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), d).astype(np.int64)
                a, b = cell.astype(float).T, (cell + width - 1).astype(float).T
                for i in range(0, len(by_size[d]), AT_ONCE):
                    q = matrix[d][i : i + AT_ONCE]
                    up, down = np.maximum(q, 0), np.minimum(q, 0)
                    upper, lower = up @ b + down @ a, up @ a + down @ b
                    slack = 1 + 1e-12 * (np.abs(upper) + np.abs(lower))  # of sums beyond 2**53
                    upper, lower = upper + slack, lower - slack
                    own = np.array(by_size[d][i : i + AT_ONCE])[:, None] == ids
                    lower[own], upper[own] = -np.inf, -np.inf
                    both = np.hstack([least[d][i : i + AT_ONCE], lower])
                    least[d][i : i + AT_ONCE] = best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                    at, to = np.nonzero((upper >= best.min(axis=1, keepdims=True)) & ~own)
                    held.append((d, at + i, ids[to], lower[at, to], upper[at, to]))
                    size += len(at)
                if size > HELD:
                    rows = leave()
                    size = 0
                    yield rows
        yield leave()

    return codes.mapInPandas(run, BOUNDS)


def op5_va_file_topk(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for the queries of embeddings; nulls, repeated rows, ties and the like as in search()."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


#: The same rows by comparing every query with every row.
OP5_SQL = """
WITH valid AS (
  SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), ints AS MATERIALIZED (
  SELECT row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM valid
), scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id % 100 = 0 AND q.row <> c.row AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
