"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct words, pairs, triples and pairs with one
word between, as 64-bit hashes. One task learns from a bounded sample of
labelled rows, with a rate for each coordinate and an L1 penalty that leaves
most weights at zero; models of either half of the sample score the other half,
which calibrates the score. What it returns is a short list of hashes and
weights, at most one for each of 2 ** BITS slots, which every task gets to score
its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._util import batches, release, stash, text_or_empty
from textloom.llm.bytewords import PLAIN, chunks, mix, words

#: Labelled documents to learn from at most, those of smallest hash, and the bytes of their texts together: the bounds of the sample.
MOST_ROWS, MOST_BYTES = 12_000, 64 << 20
BITS = 22
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 15.0, 1.0, 8
#: Keeps the calibration's slope near 1 and its shift near 0 where the sample says little.
SHRINK = 1.0
TOXIC_FROM = 0.7


def grams(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts i to j: the feature hashes, and the text (from i) that each is in."""
    for i, j, raw in chunks(texts):
        h, _, _, first = words(raw, PLAIN)
        doc = np.repeat(np.arange(j - i), np.diff(first))
        out, of = [h], [doc]
        for far, salt in (((0, 1), 3), ((0, 2), 5), ((0, 1, 2), 7)):
            n = len(h) - far[-1]
            if n > 0:
                x = np.full(n, np.uint64(salt))
                for k in far:
                    x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
                same = doc[:n] == doc[far[-1] :]
                out.append(x[same]), of.append(doc[:n][same])
        yield i, j, np.concatenate(out), np.concatenate(of)


def learn(texts: list[str], labels: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, and the hashes and weights of the features whose weight is not zero."""
    slot = lambda x: (x >> np.uint64(64 - BITS)).astype(np.int64)
    rows: list[np.ndarray] = []
    for i, j, h, of in grams(texts):
        order = np.argsort(of, kind="stable")
        rows += [np.unique(slot(x)).astype(np.int32) for x in np.split(h[order], np.searchsorted(of[order], np.arange(1, j - i)))]
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    bias_z = bias_n = 0.0
    bias = lambda: -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at = rows[k]
            zs, ns = z[at], n[at]
            w = -np.sign(zs) * np.maximum(np.abs(zs) - L1, 0) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias(), -30, 30))) - labels[k]
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias()
            bias_n += g * g
    w = -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    # Each slot's weight goes to the feature that the sample has there most often, so that others of the slot don't count.
    seen = np.concatenate([h[w[slot(h)] != 0] for _, _, h, _ in grams(texts)] or [np.zeros(0, np.uint64)])
    keys, times = np.unique(seen, return_counts=True)
    order = np.lexsort((-times, slot(keys)))
    _, first = np.unique(slot(keys)[order], return_index=True)
    keys = np.sort(keys[order[first]])
    return float(bias()), keys, w[slot(keys)].astype(np.float64)


def logits(texts: list[str], bias: float, keys: np.ndarray, weights: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """The log odds of each text; `known` says which slots have a weight."""
    slot = lambda x: (x >> np.uint64(64 - BITS)).astype(np.int64)
    if known is None:
        known = np.zeros(1 << BITS, bool)
        known[slot(keys)] = True
    total = np.full(len(texts), bias)
    for i, j, h, of in grams(texts):
        hit = np.flatnonzero(known[slot(h)])
        at = np.searchsorted(keys, h[hit])
        real = keys[np.minimum(at, len(keys) - 1)] == h[hit] if len(keys) else np.zeros(0, bool)
        once = np.unique(of[hit][real] * (len(keys) + 1) + at[real])
        total[i:j] += np.bincount(once // (len(keys) + 1), weights[once % (len(keys) + 1)], j - i)
    return total


def calibration(odds: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift by which logistic regression turns log odds into those of the labels; 1 and 0 without both labels."""
    slope, shift = 1.0, 0.0
    if len(set(labels.tolist())) < 2:
        return slope, shift
    x = np.clip(odds, -30, 30)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        w = p * (1 - p)
        gradient = np.array([((p - labels) * x).sum() + SHRINK * (slope - 1), (p - labels).sum() + SHRINK * shift])
        curve = np.array([[(w * x * x).sum() + SHRINK, (w * x).sum()], [(w * x).sum(), w.sum() + SHRINK]])
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 1.0 / np.abs(step).max()) if np.abs(step).max() else 1.0
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(slope), float(shift)) if slope > 0 else (1.0, 0.0)


def learn_calibrated(texts: list[str], labels: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
    """As learn(), with log odds that either half's model, scoring the other half, shows to be right."""
    y, half = np.array(labels), np.arange(len(texts)) % 2
    odds = np.zeros(len(texts))
    for k in (0, 1):
        own, other = np.flatnonzero(half == k), np.flatnonzero(half != k)
        odds[other] = logits([texts[i] for i in other], *learn([texts[i] for i in own], y[own].tolist()))
    slope, shift = calibration(odds, y)
    bias, keys, weights = learn(texts, labels)
    return slope * bias + shift, keys, slope * weights


def sample(docs: DataFrame, labels: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """_id, text and _y of labelled documents, in the order of a hash as many as the bounds allow; of several texts of one doc_id the least."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    chosen = stash(chosen, "toxicity-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.first("_y").alias("_y"))
    texts = stash(texts, "toxicity-texts")
    sizes = [(r["_id"], r["n"]) for r in texts.select("_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("_id"), "_id").collect()]  # at most most_rows
    kept, size = [], 0
    for i, n in sizes:
        if size + n <= most_bytes:
            kept.append((i,))
            size += n
    return texts if len(kept) == len(sizes) else texts.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "_id long")), "_id")


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> tuple[float, np.ndarray, np.ndarray]:
    """The model from labels (doc_id, toxic) and the texts of docs. Rows without a label are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        rows = pd.concat([pd.DataFrame({"_id": [], "text": [], "_y": []}), *parts], ignore_index=True).sort_values("_id", ignore_index=True)
        bias, keys, w = learn_calibrated(rows["text"].to_list(), rows["_y"].to_list())
        del rows
        release()
        yield pd.DataFrame({"bias": [bias], "keys": [keys.tobytes()], "weights": [w.tobytes()]})

    rows = sample(docs, labels, most_rows, most_bytes)
    found = batches(rows).repartition(1).mapInPandas(run, "bias double, keys binary, weights binary").collect()  # one row; 16 bytes for each weight, at most 64 MB
    return (found[0]["bias"], np.frombuffer(found[0]["keys"], np.uint64), np.frombuffer(found[0]["weights"], np.float64)) if found else (0.0, np.zeros(0, np.uint64), np.zeros(0))


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` and score, the probability that the whole text is toxic. A null text counts as empty."""
    bias, keys, weights = model

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        known = np.zeros(1 << BITS, bool)
        known[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
        for part in parts:
            total = logits(part["_text"].to_list(), bias, keys, weights, known)
            yield part[list(keep)].assign(score=1 / (1 + np.exp(-np.clip(total, -30, 30))))

    rows = docs.select(*keep, text_or_empty().alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return batches(rows).mapInPandas(run, f"{schema}, score double")


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text).

    Learns from labels whose doc_id is not held out; of several labels of one
    doc_id the largest counts, of several texts the least. A null doc_id is not
    held out, a null text counts as empty, a very long one is scored whole. Rows
    that repeat are scored alike; a score of exactly TOXIC_FROM is predicted 1.
    Other columns of docs and labels are not read. Without any label the score
    is 0.5. An empty table gives no rows.
    """
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op2_ftrl_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents; nulls, repeated rows and the like as in classify()."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
