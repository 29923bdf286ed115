"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Statistics of each whole text are standardised and mapped to cosines whose
inner products approximate a Gaussian kernel. Each partition sums its share of
the normal equations; the sums give the ridge weights. Isotonic regression on
other labelled rows turns the fitted values into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._util import batches, release, stash, text_or_empty
from textloom.llm.bytewords import SPACES, chunks, words
from textloom.llm.toxicity import held_out

FEATURES, GAMMA, RIDGE, SEED = 192, 0.05, 1e-3, 20260904
#: Tasks that add up the sums of all partitions and send theirs to the driver, and bins of fitted values that isotonic regression counts in.
SUMMANDS, BINS = 8, 1000
GOOD_FROM = 0.5
STATISTICS = ("log_words", "word_length", "word_spread", "upper", "digits", "symbols", "punctuation", "other_bytes", "line_feeds", "ends", "distinct", "line_repeats", "pair_repeats", "longest_word")

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[48:58] = 1, 2
_CLASS[[ord(c) for c in "#*$%&|<>@^~_={}[]\\+/"]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[128:] = 5


def statistics(texts: list[str]) -> np.ndarray:
    """A row for each whole text, STATISTICS in its columns; all zero for a text without words."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for i, j, raw in chunks(texts):
        n_docs = j - i
        h, start, end, first = words(raw, ~SPACES)
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
        kinds = _CLASS[data]
        kinds[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] = 1  # capitals with accents
        count = lambda mask: np.add.reduceat(mask.astype(np.int64), begin[:-1])
        n = np.diff(first)
        doc = np.repeat(np.arange(n_docs), n)
        size = (end - start).astype(float)
        some = np.maximum(n, 1)
        chars = np.maximum(np.bincount(doc, size, n_docs), 1)

        def distinct(key: np.ndarray, of: np.ndarray) -> np.ndarray:
            order = np.lexsort((key, of))
            new = np.ones(len(key), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (of[order][1:] != of[order][:-1])
            return np.bincount(of[order][new], minlength=n_docs)

        with np.errstate(over="ignore"):
            pair = h[:-1] * np.uint64(3) + (h[1:] ^ np.uint64(0x5851F42D4C957F2D))
            same = doc[:-1] == doc[1:]
            ends = np.flatnonzero(data == 10)
            line_of = np.searchsorted(ends, start)  # the line of each word
            line_first = np.flatnonzero(np.diff(line_of, prepend=-1))
            line_hash = np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - np.repeat(line_first, np.diff(np.append(line_first, len(h)))).astype(np.uint64) + np.uint64(1)), line_first) if len(h) else h
        lines = np.bincount(doc[line_first], minlength=n_docs)
        mean = np.bincount(doc, size, n_docs) / some
        longest = np.zeros(n_docs)
        np.maximum.at(longest, doc, size)
        last = data[np.maximum(end - 1, 0)] if len(end) else data[:0]
        pairs = np.bincount(doc[:-1][same], minlength=n_docs)
        block = np.stack([
            np.log1p(n), mean, np.sqrt(np.maximum(np.bincount(doc, size**2, n_docs) / some - mean**2, 0)),
            *[count(kinds == k) / chars for k in (1, 2, 3, 4, 5)], (count(data == 10) - 1) / some,
            np.bincount(doc, np.isin(last, [33, 46, 63]), n_docs) / some, distinct(h, doc) / some,
            1 - distinct(line_hash, doc[line_first]) / np.maximum(lines, 1), 1 - distinct(pair[same], doc[:-1][same]) / np.maximum(pairs, 1), np.log1p(longest)], axis=1)
        block[n == 0] = 0
        out[i:j] = block
    return out


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of each whole text of docs (doc_id, text)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "x": list(statistics(part["text"].to_list()))})

    return batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))).mapInPandas(run, "doc_id long, x array<double>")


def fourier(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Random cosines of the standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, np.sqrt(2 * GAMMA), (len(STATISTICS), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / spread, -8, 8)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])


def isotonic(value: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step function nearest to good / count at each sorted value (pooled adjacent violators)."""
    blocks: list[list[float]] = []
    for v, g, n in zip(value, good, count, strict=True):
        blocks.append([v * n, g, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def sums(rows: DataFrame, run, size: int) -> np.ndarray:
    """The sum of run(x, y) over rows (x, y): a vector of `size` numbers from each partition, added up in SUMMANDS tasks."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for part in parts:
            if len(part):
                total += run(np.stack(part["x"].to_list()), part["y"].to_numpy(float))
        yield pd.DataFrame({"total": [total]})

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for part in parts:
            for x in part["total"]:
                total += x
        yield pd.DataFrame({"total": [total]})

    found = batches(rows).mapInPandas(each, "total array<double>").repartition(SUMMANDS).mapInPandas(add, "total array<double>").collect()  # SUMMANDS vectors
    return np.sum([np.array(r["total"]) for r in found], axis=0) if found else np.zeros(size)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text).

    Learns from labels (doc_id, quality) that are not held out: two thirds of
    them fit the ridge, one third the calibration. Rows without a label are left
    out; of several labels of one document the largest counts. A null text
    counts as empty, a very long one is read whole, a null doc_id is not held
    out, rows that repeat are scored alike, a score of exactly GOOD_FROM is
    predicted 1. Other columns of docs and labels are not read. Without labels
    the score is 0.5. An empty table gives no rows.
    """
    stats = stash(measure(docs), "quality-statistics")
    label = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    known = stash(stats.join(label, "doc_id").select("x", "y", (F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(3)) == 0).alias("later")), "quality-labelled")
    fit, later = known.where("NOT later"), known.where("later")

    k, d = len(STATISTICS), FEATURES + 1
    first = sums(fit, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]), 1 + 2 * k)
    n = max(first[0], 1)
    mean = first[1 : k + 1] / n
    spread = np.sqrt(np.maximum(first[k + 1 :] / n - mean**2, 0))
    spread[spread < 1e-9] = 1.0

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier(x, mean, spread)
        return np.concatenate([(z.T @ z).ravel(), z.T @ (2 * y - 1)])

    total = sums(fit, normal, d * d + d)
    weights = np.linalg.solve(total[: d * d].reshape(d, d) + RIDGE * n * np.eye(d) / d + 1e-9 * np.eye(d), total[d * d :])

    def bins(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((fourier(x, mean, spread) @ weights + 1.5) * BINS / 3).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    counted = sums(later, bins, 2 * BINS)
    full = np.flatnonzero(counted[BINS:])
    # One imagined row of either class at the ends keeps probabilities off 0 and 1.
    value = np.concatenate([[-1.5], (full + 0.5) * 3 / BINS - 1.5, [1.5]])
    knots, levels = isotonic(value, np.concatenate([[0], counted[full], [1]]), np.concatenate([[1], counted[BINS + full], [1]])) if len(full) else (np.array([0.0]), np.array([0.5]))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.stack(part["x"].to_list()) if len(part) else np.zeros((0, k))
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": np.interp(fourier(x, mean, spread) @ weights, knots, levels)})

    return stats.mapInPandas(run, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def op10_fourier_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents; nulls, repeated rows and the like as in classify()."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
