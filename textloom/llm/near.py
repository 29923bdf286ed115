"""Near-duplicate groups by SetSketch registers.

A document's set is its distinct five-word shingles. Its sketch holds, for
each register, the least of one exponential value per shingle on a scale of
powers, truncated at both ends; sketches of parts merge by the larger
register. Documents of equal sets form a class, of which one goes on. Bands of
registers bring classes together; within a bucket, all classes are compared
with one of them, then those that are not connected yet with everything left,
block by block. A pair is first estimated by the likelihood of its registers
given both set sizes, then confirmed on the full sets. Components of the
confirmed links are the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._util import batches, release, shuffle_partitions, stash, text_or_empty
from textloom.llm.bytewords import SPACES, chunks, mix, words
from textloom.llm.components import components

SHINGLE = 5
#: Linked if PERCENT_OF * intersection >= PERCENT * union.
PERCENT, PERCENT_OF = 75, 100
#: A pair at the threshold shares no band with probability (1 - 0.75 ** 4) ** 40, under one in four million.
BANDS, PER_BAND = 40, 4
REGISTERS = BANDS * PER_BAND
SCALE_BASE, SCALE_TOP = 1.02, 4094
#: Estimates this many standard deviations below the threshold are not confirmed: fewer than one in a million linked pairs.
DEVIATIONS = 5.0
BLOCK, PAIRS = 512, 20_000

_rng = np.random.default_rng(20260904)
_FACTOR = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2)


def shingles(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of all words together if they are fewer than five, none without words."""
    for _, _, raw in chunks(texts):
        h, _, _, first = words(raw, ~SPACES)
        n = len(h) - SHINGLE + 1
        s = np.zeros(max(n, 0), np.uint64)
        for k in range(SHINGLE if n > 0 else 0):
            s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= SHINGLE:
                yield np.unique(s[a : b - SHINGLE + 1])
            else:
                x = np.full(min(b - a, 1), np.uint64(b - a))
                for w in h[a:b]:
                    x = mix(x * np.uint64(0x9E3779B97F4A7C15) + w)
                yield x


def registers(s: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of hashes, 16 bits a register: larger for smaller minima; all zero for an empty set."""
    if not len(s):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 512):
        x = s[i : i + 512, None] * _FACTOR + _SHIFT
        x ^= x >> np.uint64(29)
        np.minimum(least, x.min(axis=0), out=least)
    x = -np.log1p(-np.minimum((least.astype(float) + 0.5) / 2.0**64, 1 - 1e-12))
    return np.clip(np.floor(1 - np.log(x) / np.log(SCALE_BASE)) + 200, 0, SCALE_TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def bands(regs: np.ndarray) -> np.ndarray:
    """For each row of registers its BANDS keys."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(regs), 0)
    parts = regs.reshape(len(regs), BANDS, PER_BAND).astype(np.uint64)
    for k in range(PER_BAND):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def similarity(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of greatest likelihood, given in how many registers the first set's is above and below, and both sizes."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (SCALE_BASE - 1) / SCALE_BASE) / np.log(SCALE_BASE)
    same = REGISTERS - above - below

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return above * np.log(a + 1e-12) + below * np.log(b + 1e-12) + same * np.log(np.maximum(1 - a - b, 1e-12))

    for _ in range(24):  # it has one peak
        x, y = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(x) > likelihood(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def likely(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Pairs whose sizes allow a link and whose estimate does not rule it out."""
    t = PERCENT / PERCENT_OF
    least = t - DEVIATIONS * np.sqrt(t * (1 - t) / REGISTERS)
    fits = PERCENT_OF * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
    out = np.zeros(len(n_a), bool)
    at = np.flatnonzero(fits)
    if len(at):
        a, b = regs_a[at], regs_b[at]
        out[at] = similarity((a > b).sum(1), (a < b).sum(1), n_a[at].astype(float), n_b[at].astype(float)) >= least
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return PERCENT_OF * both >= PERCENT * (len(a) + len(b) - both)


def _stack(column: pd.Series, dtype, width: int | None = None) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1 if width is None else width)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, same (a digest of the whole set, null if empty) and regs for each document."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for part in parts:
            rows = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, registers(s).tobytes()) for s in shingles(part["text"].to_list())]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_shingles": [r[0] for r in rows], "same": [r[1] for r in rows], "regs": [r[2] for r in rows]})

    return batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))).mapInPandas(run, "doc_id long, n_shingles long, same binary, regs binary")


def banded(classes: DataFrame) -> DataFrame:
    """band and id, for every band of every class (id, regs)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                keys = bands(_stack(part["regs"], np.uint16, REGISTERS))
                yield pd.DataFrame({"band": keys.ravel(), "id": np.repeat(part["id"].to_numpy(np.int64), BANDS)})

    return batches(classes.select("id", "regs")).mapInPandas(run, "band long, id long")


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sketches do not rule out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield part.loc[likely(_stack(part["ra"], np.uint16, REGISTERS), _stack(part["rb"], np.uint16, REGISTERS), part["na"].to_numpy(), part["nb"].to_numpy()), ["a", "b"]]

    side = lambda x: classes.select(F.col("id").alias(x), F.col("regs").alias(f"r{x}"), F.col("n").alias(f"n{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets (id, set)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            good = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(part["sa"], part["sb"], strict=True)]
            yield part.loc[good, ["a", "b"]]

    side = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"s{x}"))
    return batches(pairs.join(side("a"), "a").join(side("b"), "b")).mapInPandas(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and set (sorted shingle hashes) of the classes in wanted (id, first, same), each from a document whose doc_id is first."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(i, s.tobytes()) for i, same, s in zip(part["id"], part["same"], shingles(part["text"].to_list()), strict=True) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == bytes(same)]
            yield pd.DataFrame(out, columns=["id", "set"]).astype({"id": "int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("first"), text_or_empty().alias("text")).join(wanted, "first")
    # A doc_id may stand on several rows: only a text with the class's own set counts, once.
    return batches(rows).mapInPandas(run, "id long, set binary").dropDuplicates(["id"])


def leftover(members: DataFrame, parts: int) -> DataFrame:
    """Confirmed links among members (band, id, component, n, regs, set) of one bucket and different components.

    A bucket is cut into blocks by a hash; every two blocks meet in a group of
    at most about 2 * BLOCK rows, so that no task holds a bucket. A pair is
    looked at in the first band that it shares, and confirmed there; one link is
    enough between what a group has connected by then, so few pairs leave it.
    """
    sizes = members.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))

    def run(chunks_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        held = None
        for part in chunks_:
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            key = part[["band", "x", "y"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            held = part.iloc[cuts[-1] if len(cuts) else 0 :]
            if len(cuts):
                yield met(part.iloc[: cuts[-1]], cuts[:-1])
        if held is not None and len(held):
            yield met(held, np.zeros(0, np.int64))

    def met(part: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        ids, comp, own, n, band = (part[c].to_numpy() for c in ("id", "component", "own", "n", "band"))
        cross = (part["x"] != part["y"]).to_numpy()
        regs, sets, out = _stack(part["regs"], np.uint16, REGISTERS), [np.frombuffer(x, np.uint64) for x in part["set"]], []
        keys = bands(regs)
        over: dict[int, int] = {}

        def top(c: int) -> int:
            while c in over:
                c = over[c]
            return c

        def compare(i: np.ndarray, j: np.ndarray) -> None:
            first = keys[i, np.argmax(keys[i] == keys[j], axis=1)] == band[i]
            i, j = i[first], j[first]
            good = likely(regs[i], regs[j], n[i], n[j])
            for x, y in zip(i[good], j[good], strict=True):
                a, b = top(comp[x]), top(comp[y])
                if a != b and linked(sets[x], sets[y]):
                    over[max(a, b)] = min(a, b)
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))

        held, size = [], 0
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(part)), strict=True):
            step = max(1, PAIRS // (b - a))
            for k in range(a, b, step):
                i, j = np.arange(k, min(k + step, b))[:, None], np.arange(a, b)[None, :]
                at = np.nonzero((i < j) & (comp[i] != comp[j]) & (~cross[i] | (own[i] != own[j])))
                held.append((at[0] + k, at[1] + a))
                size += len(at[0])
                if size >= PAIRS:
                    compare(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            compare(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = dealt.select("band", "x", "y", "own", "id", "component", "n", "regs", "set").repartition(parts, "band", "x", "y").sortWithinPartitions("band", "x", "y")
    return batches(rows).mapInPandas(run, "a long, b long").distinct()


def group(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    A null or empty text has an empty set and is linked with nothing. Rows with
    the same text are linked, whatever their doc_id; a row with a null doc_id is
    its own group, has a null component_id and is kept. Rows that repeat are
    each returned. Should one doc_id stand on different texts, each of them is
    compared by itself; what is linked with neither other may then share a
    component_id, which is the smallest doc_id of a group. Very long texts are
    read whole, other columns not at all. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sketches = stash(sketch(docs), "near-sketches")
    named = sketches.where(F.col("doc_id").isNotNull() & F.col("same").isNotNull())
    classes = stash(named.groupBy("same").agg(F.min(F.struct("doc_id", "n_shingles", "regs")).alias("m"))
                    .select(F.col("m.doc_id").alias("first"), F.col("m.n_shingles").alias("n"), F.col("m.regs").alias("regs"), "same"), "near-classes")
    # A class goes by its smallest doc_id, or by a number of its own where one doc_id stands on several texts.
    clash = not classes.groupBy("first").count().where("count > 1").isEmpty()
    classes = stash(classes.withColumn("id", F.monotonically_increasing_id()), "near-classes") if clash else classes.withColumn("id", F.col("first"))
    buckets = banded(classes)
    shared = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    buckets = stash(buckets.join(shared, "band"), "near-buckets")
    wanted = buckets.select("id").distinct().join(classes.select("id", "first", "same"), "id")
    sets = stash(full_sets(docs, wanted), "near-sets")

    # Every bucket's classes with its smallest.
    centre = buckets.groupBy("band").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("size"))
    pairs = buckets.join(centre, "band").where("id <> b").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    links = stash(confirmed(estimated(pairs, classes), sets), "near-links")
    labels = components(links)
    # Where that leaves more than one component, all that is left; of two classes the one pair has been compared.
    members = buckets.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = members.groupBy("band").agg((F.min("component") != F.max("component")).alias("apart"), F.count(F.lit(1)).alias("size")).where("apart AND size > 2").select("band")
    members = members.join(apart, "band").join(classes.select("id", "n", "regs"), "id").join(sets, "id")
    more = stash(leftover(members, shuffle_partitions(spark)), "near-links")
    if not more.isEmpty():
        labels = components(links.union(more))

    near = classes.select("id", "same", "first").join(labels, "id")
    if clash:
        near = near.join(near.groupBy("component").agg(F.min("first").alias("least")), "component").select("same", F.col("least").alias("component"))
    near = near.select("same", "component")
    of = classes.select("same", "first")
    of = of.join(near, "same", "left").select("same", F.coalesce("component", "first").alias("found"))
    out = sketches.drop("regs").join(of, "same", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op4_setsketch_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents; nulls, repeated rows and the like as in group()."""
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same rows by joining all shingles.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE CAST([] AS VARCHAR[]) END AS sh FROM w
), p AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) + any_value(b.n) - count(*) AS total FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM pairs WHERE 100 * shared >= 75 * total UNION ALL SELECT b, a FROM pairs WHERE 100 * shared >= 75 * total
), reach(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM reach r JOIN e ON r.y = e.a), least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, len(sh) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(y, doc_id)) AS kept FROM s LEFT JOIN least_of ON x = doc_id
"""
