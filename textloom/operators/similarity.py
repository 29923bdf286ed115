"""Near-duplicate tickets: cosine of weighted terms by an exact prefix filter, token-set ratio, clusters."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.sources.tables import discard, release, written

COSINE, RATIO, SLACK = 0.85, 90, 1e-9


#: Bytes of normalised text that are counted at once, and for each bucket of terms; ids of documents that may be broadcast.
CHUNK, TERMS, MOST_IDS = 8 << 20, 32 << 20, 1 << 20
#: Documents of one t that are compared at once; a group of pairs has about twice as many.
BLOCK = 1024
#: Terms of prefixes in a block; blocks that a block meets in one shuffle; products of weights at once.
BLOCK_TERMS, AT_ONCE, STEP_PRODUCTS = 4 << 20, 8, 1 << 18
#: The df from which terms count as equally frequent, the bits of a term's hash in a key, a weight of one in a prefix, and what sums of squares may lack by rounding.
RARE, HASHED, WHOLE, SUMS = (1 << 22) - 1, (1 << 40) - 1, (1 << 15) - 1, 1e-12


def _dealt(docs: DataFrame, firsts: DataFrame | None = None) -> tuple[DataFrame, int, int]:
    """chunk, doc_id, text (normalised) and times of docs (doc_id, text), how many docs there are, and in how many buckets their terms go.

    All rows of a doc_id are in one chunk, of about CHUNK bytes. firsts (doc_id,
    times) names documents that stand for several; they come as rows of their own, without text.
    """
    spark = docs.sparkSession
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    least = 4 * spark.sparkContext.defaultParallelism
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(max(least, -(-size // CHUNK)))).cast("int").alias("chunk")
    rows = docs.select(chunk, "doc_id", T.normalize(F.coalesce("text", F.lit(""))).alias("text"), F.lit(None).cast("long").alias("times"))
    rows = rows if firsts is None else rows.unionByName(firsts.select(chunk, "doc_id", F.lit(None).cast("string").alias("text"), "times"))
    return rows, n, max(least, -(-size // TERMS))


def _postings(rows: pa.Table, named_only: bool) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[pa.Array, np.ndarray]]:
    """The documents and the terms of a chunk; each posting's document and term by their numbers, in this order, and tf; how many documents each one stands for; the texts and their documents.

    `named_only` leaves out documents that have no row with times, and of equal doc_ids all but one.
    """
    given = pc.is_null(rows["text"]).combine_chunks()
    texts, named = rows.filter(pc.invert(given)), rows.filter(given)
    ids = pc.dictionary_encode(texts["doc_id"].combine_chunks(), null_encoding="encode")
    number, ids = ids.indices.to_numpy(), ids.dictionary
    times = np.ones(len(ids), np.int64)
    if named_only:
        at = pc.index_in(ids, value_set=named["doc_id"].combine_chunks()).fill_null(-1).to_numpy()
        times = np.append(named["times"].to_numpy(), 0)[at]
        once = np.zeros(len(number), bool)
        first = np.unique(number, return_index=True)[1]
        if len(first) < len(number):  # the smallest text, whatever order rows come in
            order = np.lexsort((_places(texts["text"].combine_chunks()), number))
            first = order[np.searchsorted(number[order], np.arange(len(ids)))]
        once[first] = True
        once &= times[number] > 0
        texts, number = texts.filter(pa.array(once)), number[once]
    lists = pc.split_pattern(texts["text"].combine_chunks(), " ")
    doc, words = np.repeat(number, pc.list_value_length(lists).to_numpy()), lists.flatten()
    long = pc.greater(pc.utf8_length(words), 2)
    coded = words.filter(long).dictionary_encode()
    key, tf = np.unique(doc[long.to_numpy(zero_copy_only=False)].astype(np.int64) * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_counts=True)
    doc, word = np.divmod(key, max(1, len(coded.dictionary)))
    return ids, coded.dictionary, doc, word, tf, times, (texts["text"].combine_chunks(), number)


def _dealt_terms(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, the numbers of words by bucket and then in their order, and where each bucket ends there."""
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)
    bucket = (hashes >> np.uint64(40)) % np.uint64(buckets)
    return (hashes & np.uint64(HASHED)).astype(np.int64), np.lexsort((_places(words), bucket)), np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))


def _found(dealt: DataFrame, buckets: int, out: Callable[[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str, named_only: bool = False) -> DataFrame:
    """out(chunk, terms, number, ends, df) of buckets of terms, in order of chunks: chunk[i] has the terms number[ends[i - 1] : ends[i]], and df tells in how many documents a term is.

    A chunk sends one row to a bucket, with all its terms there and in how many of its documents they are.
    """
    def sent(key: tuple, rows: pa.Table) -> pa.Table:
        _, words, doc, word, _, times, _ = _postings(rows, named_only)
        n = np.bincount(word, times[doc], len(words)).astype(np.int32)
        _, order, ends = _dealt_terms(words, buckets)
        some = np.flatnonzero(np.diff(ends, prepend=0))
        cut = pa.array(np.append(0, ends[some]).astype(np.int32))
        terms = pc.binary_join(pa.ListArray.from_arrays(cut, words.take(pa.array(order))), " ")
        return pa.table({"bucket": some.astype(np.int32), "chunk": np.full(len(some), key[0].as_py(), np.int32), "terms": pa.array([zlib.compress(x.encode(), 1) for x in terms.to_pylist()], pa.binary()), "n": pa.ListArray.from_arrays(cut, pa.array(n[order]))})

    def summed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk").combine_chunks()
        lists = pc.split_pattern(pa.array([zlib.decompress(x).decode() for x in rows["terms"].to_pylist()], pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        number = coded.indices.to_numpy()
        df = np.bincount(number, pc.list_flatten(rows["n"]).to_numpy(), len(coded.dictionary)).astype(np.int64)
        return out(rows["chunk"].combine_chunks(), coded.dictionary, number, np.cumsum(pc.list_value_length(lists).to_numpy()), df)

    return dealt.groupBy("chunk").applyInArrow(sent, "bucket int, chunk int, terms binary, n array<int>").groupBy("bucket").applyInArrow(summed, schema)


def doc_freq(docs: DataFrame) -> DataFrame:
    """term, df of docs (doc_id, text): in how many documents it occurs. A chunk sends each of its terms once."""
    dealt, _, buckets = _dealt(docs)
    return _found(dealt, buckets, lambda chunk, terms, number, ends, df: pa.table({"term": terms, "df": df}), "term string, df long")


def _weighed(docs: DataFrame, schema: str, out: Callable[..., pa.Table], firsts: DataFrame | None = None) -> DataFrame:
    """out(ids, words, hashes, doc, word, df, w) of each chunk: its postings and their weights. With firsts, also the md5 of each document's text.

    Neither a posting nor a vector is shuffled: a chunk sends each of its terms
    once, packed by bucket, and gets their df in the same order. Texts are dealt out once.
    """
    dealt, n, buckets = _dealt(docs, firsts)
    named_only = firsts is not None

    def answered(chunk: pa.Array, terms: pa.Array, number: np.ndarray, ends: np.ndarray, df: np.ndarray) -> pa.Table:
        bucket = _dealt_terms(terms.slice(0, 1), buckets)[2].searchsorted(1)
        return pa.table({"chunk": chunk, "bucket": np.full(len(chunk), bucket, np.int32), "df": pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(df[number].astype(np.int32)))})

    found = _found(dealt, buckets, answered, "chunk int, bucket int, df array<int>", named_only)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        ids, words, doc, word, tf, _, (texts, number) = _postings(rows, named_only)
        # Both times a chunk's terms are the same, in whatever order its rows come.
        t, order, _ = _dealt_terms(words, buckets)
        df = np.empty(len(words), np.int64)
        df[order] = pc.list_flatten(found.sort_by("bucket")["df"]).to_numpy()
        w = _scaled(tf, df[word], n, doc, len(ids))
        if not named_only:
            return out(ids, words, t, doc, word, df, w)
        same = np.full(len(ids), None, object)
        for i, text in zip(number, texts.to_pylist(), strict=True):
            same[i] = hashlib.md5(text.encode()).hexdigest()
        return out(ids, words, t, doc, word, df, w, same)

    return dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, schema)


def _scaled(tf: np.ndarray, df: np.ndarray, n: int, doc: np.ndarray, docs: int) -> np.ndarray:
    """The weights of postings of docs documents, those of each document scaled to length one."""
    r = (1 + np.log(tf)) * (np.log((n + 1) / (df + 1)) + 1)
    norm = np.sqrt(np.bincount(doc, r * r, docs))
    return r / np.where(norm == 0, 1.0, norm)[doc]


def _order(words: pa.Array) -> pa.Array:
    """The numbers of words in their order."""
    return pc.array_sort_indices(words.cast(pa.binary()))


def _places(words: pa.Array) -> np.ndarray:
    """The place of each word in their order."""
    place = np.empty(len(words), np.int64)
    place[_order(words).to_numpy()] = np.arange(len(words))
    return place


def weights(docs: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, term, df, w: (1 + ln tf) * (ln((n + 1) / (df + 1)) + 1), scaled to length one; with `most`, each document's terms of greatest w, to nine places, then by term."""
    def out(ids: pa.Array, words: pa.Array, t: np.ndarray, doc: np.ndarray, word: np.ndarray, df: np.ndarray, w: np.ndarray) -> pa.Table:
        if most is not None:
            place = _places(words)
            order = np.lexsort((place[word], -np.round(w, 9), doc))
            starts = np.searchsorted(doc, doc)
            order = order[np.arange(len(doc)) - starts < most]
            doc, word, w = doc[order], word[order], w[order]
        return pa.table({"doc_id": ids.take(pa.array(doc)), "term": words.take(pa.array(word)), "df": df[word], "w": w})

    return _weighed(docs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, term string, df long, w double", out)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, first and n of docs (doc_id, text) that have terms: the smallest doc_id with the same normalised text, and how many there are; written."""
    plain = T.normalize(F.coalesce("text", F.lit("")))
    # One scan, in one projection, so that a text is normalised once; a term has three characters.
    rows = written(docs.select("doc_id", F.md5(plain).alias("same"), plain.rlike("[^ ]{3}").alias("any")), "similarity-texts").where("any")
    several = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return written(rows.join(several, "same").select("doc_id", "first", "n"), "similarity-classes")


def cosine_pairs(docs: DataFrame, least: float = COSINE, members: DataFrame | None = None) -> DataFrame:
    """a, b (a < b) and cosine of all pairs of classes at or above `least`; a and b are the smallest doc_ids of their classes."""
    return _cosine_pairs(docs, least, members)


def cosine_links(docs: DataFrame, least: float = COSINE, members: DataFrame | None = None) -> DataFrame:
    """Of cosine_pairs, pairs that connect the same classes: those between classes that others of a task connect are left out."""
    return _cosine_pairs(docs, least, members, linked=True)


def _cosine_pairs(docs: DataFrame, least: float, members: DataFrame | None, ratio: float | None = None, linked: bool = False) -> DataFrame:
    """a, b, cosine (and ratio, if there is a threshold for it) of cosine_pairs; `linked` leaves out pairs between what is connected already.

    Documents of equal normalised text form a class (members: classes(docs)),
    of which one is compared. Terms go from rare to common. Two vectors of
    length one that reach the threshold share a term among those before which
    each one's remaining length is still at least the threshold, so only these
    prefixes are compared, a tenth of all postings: frequent terms, the hot
    keys, stay out. Blocks of documents meet each other, so that all that two
    prefixes share is in one task and no shared term is shuffled. What they
    share and the lengths beyond rule out nearly all other pairs; the rest are
    confirmed on whole texts, whose terms' df were written with the prefixes.
    """
    members = classes(docs) if members is None else members
    firsts = members.where("doc_id = first").select("doc_id", F.col("n").alias("times")).dropDuplicates(["doc_id"])

    def rows(ids: pa.Array, words: pa.Array, t: np.ndarray, doc: np.ndarray, word: np.ndarray, df: np.ndarray, w: np.ndarray, same: np.ndarray) -> pa.Table:
        all_df = _lists(doc, df[word][np.lexsort((_places(words)[word], doc))].astype(np.int32), len(ids))
        # Terms of one document only count for its length but are shared with none.
        some = df[word] > 1
        doc, word, w = doc[some], word[some], w[some]
        key = (RARE - np.minimum(df[word], RARE) << 40) | t[word]
        order = np.lexsort((key, doc))
        doc, key, w = doc[order], key[order], w[order]
        # The vector up to a term is what remains of it from that term on, seen from the rare end.
        sums = np.cumsum(w * w)
        starts = np.searchsorted(doc, doc)
        before = np.where(starts > 0, sums[starts - 1], 0.0) if len(sums) else sums
        kept = np.sqrt(np.maximum(0, sums - before + SUMS)) >= least - SLACK
        # A prefix ends between keys, should terms share one.
        for i in np.flatnonzero((key[1:] == key[:-1]) & (doc[1:] == doc[:-1]))[::-1]:
            kept[i] |= kept[i + 1]
        left = np.bincount(doc[~kept], np.square(w[~kept]), len(ids))
        doc, key, w = doc[kept], key[kept], np.ceil(w[kept] * WHOLE).astype(np.int16)
        reach = pa.array(np.bincount(doc, minlength=len(ids)) > 0)
        return pa.table({"doc_id": ids, "same": pa.array(same, pa.string()), "df": all_df, "key": _lists(doc, key, len(ids)), "w": _lists(doc, w, len(ids)), "rest": np.sqrt(left + SUMS)}).filter(reach)

    spark = docs.sparkSession
    vectors = written(_weighed(docs, "doc_id long, same string, df array<int>, key array<long>, w array<short>, rest double", rows, firsts), "similarity-prefixes")
    release(spark)
    total = vectors.agg(F.coalesce(F.sum(F.size("key")), F.lit(0))).first()[0]
    blocks = max(math.isqrt(4 * spark.sparkContext.defaultParallelism - 1) + 1, -(-total // BLOCK_TERMS))
    rounds = -(-blocks // AT_ONCE)
    met = vectors.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    # Each block meets about AT_ONCE others in a round, whose shuffle is gone before the next one.
    parts = []
    for r in range(rounds):
        others = F.expr(f"explode(filter(sequence(0, {blocks - 1}), x -> (x + own) % {rounds} = {r}))")
        part = met.withColumn("other", others).select("doc_id", "key", "w", "rest", (F.least("own", "other") * blocks + F.greatest("own", "other")).alias("k"), (F.col("own") > F.col("other")).alias("second"))
        parts.append(written(part.groupBy("k").applyInArrow(lambda key, part: _candidates(part, key[0].as_py() // blocks == key[0].as_py() % blocks, least), "a long, b long"), "similarity-candidates"))
    pairs = reduce(DataFrame.union, parts)
    release(spark)
    # Pairs go by the smallest candidate of a, which the members of a group of near copies have in common.
    first = pairs.union(pairs.select("b", "a")).groupBy("a").agg(F.least("a", F.min("b")).alias("t"))
    pairs = written(pairs.join(first, "a"), "similarity-candidates")
    n = docs.count()

    def confirmed(pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        # Of a doc_id's texts that one whose df were written.
        rows = rows[[hashlib.md5(x.encode()).hexdigest() == y for x, y in zip(rows["text"], rows["same"], strict=True)]].drop_duplicates("doc_id")
        ids, words, doc, word, tf, _, _ = _postings(pa.table({"doc_id": pa.array(rows["doc_id"], pa.int64()), "text": pa.array(rows["text"], pa.string())}), False)
        order = np.lexsort((_places(words)[word], doc))
        doc, word, tf = doc[order], word[order], tf[order]
        w = _scaled(tf, np.concatenate([np.zeros(0, np.int64), *rows["df"]]), n, doc, len(ids))
        text = dict(zip(rows["doc_id"], rows["text"], strict=True)) if ratio is not None else None
        return _products(pairs, ids.to_numpy(zero_copy_only=False), np.searchsorted(doc, np.arange(len(ids) + 1)), word, w, len(words), least, text, ratio, linked)

    texts = docs.select("doc_id", T.normalize(F.coalesce("text", F.lit(""))).alias("text"))
    schema = "a long, b long, cosine double" + (", ratio double" if ratio is not None else "")
    found = written(_compared(pairs, texts, confirmed, schema, vectors.select("doc_id", "same", "df")), "similarity-pairs")
    discard(vectors)
    return found


def _lists(doc: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """values of n documents, which they follow in their order, as lists."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=n))).astype(np.int32)), pa.array(values))


def _candidates(part: pa.Table, alike: bool, least: float) -> pa.Table:
    """a and b (a < b) of the documents of one block with those of another (alike: with each other), whose prefixes (key, w, rest) do not rule out that they reach `least`.

    Shared terms before the nearer of two prefixes' ends are in both. Beyond it,
    the product is at most that of the lengths that remain there. Weights and
    rests are rounded up.
    """
    part = part.combine_chunks()
    ids, second = part["doc_id"].to_numpy(), part["second"].to_numpy()
    lists = pc.list_value_length(part["key"]).to_numpy()
    _, rank = np.unique(pc.list_flatten(part["key"]).to_numpy(), return_inverse=True)
    w = pc.list_flatten(part["w"]).to_numpy() / WHOLE
    n, terms = len(ids), int(rank.max(initial=-1)) + 1
    doc = np.repeat(np.arange(n, dtype=np.int32), lists)
    ends = np.cumsum(lists)
    starts = ends - lists
    rest = part["rest"].to_numpy()
    sums = np.append(0.0, np.cumsum(w * w))
    upto = np.sqrt(sums[1:] - sums[starts][doc] + np.square(rest)[doc] + SUMS)  # with the term
    beyond = np.sqrt(np.maximum(0, np.square(upto) - w * w) + SUMS)
    # Postings of the other side by term.
    b = np.arange(len(doc)) if alike else np.flatnonzero(second[doc])
    b = b[np.argsort(rank[b], kind="stable")].astype(np.int32)
    many = np.bincount(rank[b], minlength=terms)
    at = np.cumsum(many) - many
    a = np.arange(len(doc)) if alike else np.flatnonzero(~second[doc])
    size = many[rank[a]]
    a, size = a[size > 0], size[size > 0]
    found = [np.zeros((0, 2), np.int64)]
    place = rank + doc * np.int64(terms)  # ascending: a document's terms go from common to rare
    stop = np.flatnonzero(np.append(doc[a[1:]] != doc[a[:-1]], True)) + 1 if len(a) else np.zeros(0, np.int64)
    upon, begin = np.cumsum(size)[stop - 1], 0
    while begin < len(a):
        # Whole documents, of as many products as a step holds, one document at least.
        done = np.searchsorted(stop, begin, "right")
        reach = np.searchsorted(upon, (upon[done - 1] if done else 0) + STEP_PRODUCTS, "right")
        end = stop[max(reach - 1, done)]
        x, m = a[begin:end], size[begin:end]
        begin = end
        i = np.repeat(x, m)
        j = b[np.repeat(at[rank[x]] - np.cumsum(m) + m, m) + np.arange(len(i))]
        if alike:
            one = ids[doc[i]] < ids[doc[j]]
            i, j = i[one], j[one]
        products, code = w[i] * w[j], doc[i] * np.int64(n) + doc[j]
        # The rarest term that two vectors share bounds their product.
        some = np.unique(code[products + beyond[i] * beyond[j] >= least - SLACK])
        if not len(some):
            continue
        k = np.minimum(np.searchsorted(some, code), len(some) - 1)
        hit = some[k] == code
        shared = np.bincount(k[hit], products[hit], len(some))
        p, q = np.divmod(some, n)
        cut = np.maximum(rank[starts[p]], rank[starts[q]])
        lengths = []
        for y in (p, q):
            last = np.searchsorted(place, y * np.int64(terms) + cut) - 1
            lengths.append(np.where(last >= starts[y], upto[np.maximum(last, 0)], rest[y]))
        likely = shared + lengths[0] * lengths[1] >= least - SLACK
        found.append(np.stack([ids[p[likely]], ids[q[likely]]], axis=1))
    pairs = np.concatenate(found)
    return pa.table({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})


def _products(pairs: pd.DataFrame, ids: np.ndarray, at: np.ndarray, words: np.ndarray, w: np.ndarray, n: int, least: float, text: dict | None, ratio: float | None, linked: bool) -> pd.DataFrame:
    """a, b and cosine (and ratio) of the pairs (a, b) that reach `least` (and `ratio`); document ids[i] has the words and weights from at[i] to at[i + 1], of n words."""
    index = pd.Index(ids)
    full, pairs = np.zeros(n), pairs.sort_values(["a", "b"])
    root, out, last = list(range(len(ids))), [], -1

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b, i, j in zip(pairs["a"].tolist(), pairs["b"].tolist(), index.get_indexer(pairs["a"]).tolist(), index.get_indexer(pairs["b"]).tolist(), strict=True):
        if linked and top(i) == top(j):
            continue
        if i != last:
            if last >= 0:
                full[words[at[last] : at[last + 1]]] = 0.0
            full[words[at[i] : at[i + 1]]] = w[at[i] : at[i + 1]]
            last = i
        cosine = float(np.dot(full[words[at[j] : at[j + 1]]], w[at[j] : at[j + 1]]))
        if cosine < least - SLACK:
            continue
        alike = token_set_ratio(text[a], text[b], ratio) if ratio is not None else 0.0
        if ratio is None or alike >= ratio:
            out.append((a, b, cosine, alike))
            if linked:
                root[top(j)] = top(i)
    found = pd.DataFrame(out, columns=["a", "b", "cosine", "ratio"]).astype({"a": "int64", "b": "int64", "cosine": "float64", "ratio": "float64"})
    return found if ratio is not None else found[["a", "b", "cosine"]]


def _compared(pairs: DataFrame, rows: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, more: DataFrame | None = None) -> DataFrame:
    """run(pairs, rows) of groups of pairs (a, b, t; written) and the rows (doc_id), joined with `more` (doc_id), of their documents.

    A row goes to each group by t that has pairs of its document, and not to
    each pair. A t of more than BLOCK documents is split into pairs of blocks.
    """
    ends = lambda *x: pairs.select(*x, F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    large = written(ends("t").groupBy("t").agg(F.count(F.lit(1)).alias("m")), "similarity-blocks")
    total = large.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    block = lambda c: F.coalesce(F.pmod(F.xxhash64(c), F.ceil(F.col("m") / BLOCK)), F.lit(0))
    groups = max(2 * pairs.sparkSession.sparkContext.defaultParallelism, -(-total // (2 * BLOCK)))
    pairs = pairs.join(large.where(F.col("m") > BLOCK), "t", "left").withColumn("k", F.pmod(F.xxhash64("t", F.least(block("a"), block("b")), F.greatest(block("a"), block("b"))), F.lit(groups))).drop("m")
    pairs = written(pairs, "similarity-groups")
    ids = ends()
    few = ids.count() <= MOST_IDS
    of = lambda x: x.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    some = of(rows) if more is None else of(rows).join(of(more), "doc_id")
    return pairs.groupBy("k").cogroup(ends(F.col("k").alias("group")).join(some, "doc_id").groupBy("group")).applyInPandas(lambda a, b: run(a.drop(columns="k"), b), schema)


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit a character."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return (~s & full).bit_count()


def token_set_ratio(a: str, b: str, least: float = 0.0) -> float:
    """0 to 100: how alike the sets of words are, by insertions and deletions of characters; may return 0 if under `least`."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (not x - y or not y - x):
        return 100.0
    left, right, same = " ".join(sorted(x - y)), " ".join(sorted(y - x)), " ".join(sorted(both))
    n = len(same)
    gap = 1 if n else 0
    ratio = lambda p, q, d: 100.0 * (1 - d / (p + q)) if p + q else 100.0
    best = max(ratio(n, n + gap + len(left), gap + len(left)), ratio(n, n + gap + len(right), gap + len(right))) if n else 0.0
    total = 2 * (n + gap) + len(left) + len(right)
    if 100.0 * (1 - abs(len(left) - len(right)) / total) > max(best, least - SLACK):
        best = max(best, 100.0 * (1 - (len(left) + len(right) - 2 * _lcs(left, right)) / total))
    return best


def near_duplicates(docs: DataFrame, cosine: float = COSINE, ratio: float = RATIO, members: DataFrame | None = None, linked: bool = False) -> DataFrame:
    """a, b, cosine, ratio of the pairs of classes whose cosine and token-set ratio both reach their thresholds; `linked` leaves out pairs between classes that others of a task connect."""
    return _cosine_pairs(docs, cosine, members, ratio, linked)


def document_clusters(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id and component of all members (doc_id, first, n) of classes that pairs connect, or that have several members."""
    found = clusters(pairs).select(F.col("doc_id").alias("first"), "component")
    rows = members.join(found, "first", "left").where("component IS NOT NULL OR n > 1")
    return rows.select("doc_id", F.coalesce("component", "first").alias("component")).distinct()


def clusters(pairs: DataFrame) -> DataFrame:
    """doc_id and component (its smallest doc_id) of everything that pairs (a, b) connect; rounds are written, nothing is collected."""
    both = written(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "clusters-edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    while True:
        labels = written(labels, "clusters-labels")
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        met = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hop = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        found = written(met.join(hop, "label", "left").select("id", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "clusters-labels")
        labels = found.select("id", "label")
        if found.where("old <> label").isEmpty():
            return labels.select(F.col("id").alias("doc_id"), F.col("label").alias("component"))


def best_similarity(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Each document's greatest cosine with another: 1 with a member of its own class, else that of its class."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("first"), "cosine").groupBy("first").agg(F.max("cosine").alias("best"))
    return members.join(ends, "first", "left").where("best IS NOT NULL OR n > 1").select("doc_id", F.when(F.col("n") > 1, 1.0).otherwise(F.col("best")).alias("best"))
