"""Removal of byte strings that occur elsewhere, by external induced sorting of suffixes in shards.

Two equal strings of WINDOW bytes have the same least hash of GRAM bytes among
all that they hold, their anchor. So every text is cut into runs of windows
with one anchor; an anchor that occurs once in all texts needs no more than
its hash. Equal runs (copies) are counted, not compared. Of the others, one
each goes to the shard of its anchor, where suffixes are sorted with the length
of the prefix that neighbours share; windows that share WINDOW bytes or more
with a neighbour are marked. All equal windows meet in one shard, so the result
is that of sorting all texts at once. An anchor whose runs are too much for one
task is not sorted: blocks of its windows are counted by hashes, over all tasks.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._util import batches, discard, release, scratch, shuffle_partitions, stash, text_or_empty
from textloom.llm.bytewords import INVERSE, mix, powers, prefix_hash
from textloom.llm.induced import suffixes

WINDOW, GRAM = 400, 32
#: A repeated passage has at least this many bytes and whole words; words are rarely so short that the bytes would not let one through.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 51
#: Text that is sorted at once, unless one anchor has more; and what of a sort's queues and arrays stays in memory.
SHARD_BYTES, MEMORY = 1 << 19, 64 << 20
#: An anchor with more than this in its distinct runs is hot.
HOT_BYTES = 4 << 20
#: Windows of a hot anchor's blocks, from round to round.
BLOCKS = (64, 8, 1)
#: Rows that leave Python at once.
LEAVE = 1 << 16
RUNS = "doc_id long, key long, anchor long, run long, low int, high int, again boolean"


def least_of_each(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours."""
    n = len(h)
    x = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    x[:n] = h
    x = x.reshape(-1, width)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(text: bytes, window: int = WINDOW, gram: int = GRAM, marked: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: anchor, hash of its bytes, first and last window, whether the anchor occurs again in the text."""
    data = np.frombuffer(text, np.uint8)
    n = len(data) - gram + 1
    p, inverse = prefix_hash(data), powers(INVERSE, len(data) + 1)
    h = mix((p[gram:] - p[:n]) * inverse[:n])
    least = least_of_each(h, window - gram + 1)
    turn = np.flatnonzero(least[1:] != least[:-1]) + 1
    low, high = np.append(0, turn), np.append(turn, len(least)) - 1
    anchor, end = least[low], high + window
    marked = np.zeros(1 << 16, bool) if marked is None else marked
    slot = (anchor & np.uint64(0xFFFF)).astype(np.int64)
    marked[slot] = True
    near = h[marked[(h & np.uint64(0xFFFF)).astype(np.int64)]]
    marked[slot] = False
    kinds, times = np.unique(near, return_counts=True)
    content = np.array([xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(low.tolist(), end.tolist(), strict=True)], np.uint64)
    return anchor, content, low, high, times[np.searchsorted(kinds, anchor)] > 1


def all_runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The runs of every text (doc_id, key, text)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        marked = np.zeros(1 << 16, bool)
        for part in parts:
            ids, out, sizes = part["doc_id"].astype("Int64"), [], []
            for text in part["text"]:
                raw = _bytes(text)
                if len(raw) >= window:
                    out.append(runs(raw, window, gram, marked))
                sizes.append(len(out[-1][0]) if len(raw) >= window else 0)
            at = np.repeat(np.arange(len(part)), sizes)
            if len(at):
                anchor, content, low, high, again = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pd.DataFrame({"doc_id": ids.iloc[at].array, "key": part["key"].to_numpy()[at], "anchor": anchor.view(np.int64), "run": content.view(np.int64), "low": low.astype(np.int32), "high": high.astype(np.int32), "again": again})

    return batches(docs).mapInPandas(run, RUNS)


def marks(pieces: list[tuple[bytes, int, bool]], window: int, folder: str | None, memory: int = MEMORY) -> list[list[tuple[int, int]]]:
    """For each piece (bytes, windows, wanted): the stretches of windows that occur elsewhere in the pieces; none where not wanted."""
    sizes = np.array([len(p[0]) + 1 for p in pieces], np.int64)
    total, own = int(sizes.sum()) + 1, None
    try:
        if 2 * total > memory // 4 and folder:
            own = os.path.join(folder, f"text-{uuid.uuid4().hex}")
            os.makedirs(own)
            t = np.memmap(os.path.join(own, "t"), np.uint16, "w+", shape=(total,))
        else:
            t = np.zeros(total, np.uint16)
        at = np.cumsum(sizes) - sizes
        for (raw, _, _), a in zip(pieces, at, strict=True):
            t[a : a + len(raw)] = np.frombuffer(raw, np.uint8)
            t[a : a + len(raw)] += np.uint16(2)
            t[a + len(raw)] = 1
        t[-1] = 0
        again = np.zeros(total, bool)
        last = None
        for position, common in suffixes(t, window, folder, memory):
            i = np.flatnonzero(common >= window)
            again[position[i]] = True
            again[position[i[i > 0] - 1]] = True
            if len(i) and i[0] == 0 and last is not None:
                again[last] = True
            last = position[-1]
    finally:
        if own:
            shutil.rmtree(own, ignore_errors=True)
    for (raw, windows, wanted), a in zip(pieces, at.tolist(), strict=True):
        again[a + windows * wanted : a + len(raw) + 1] = False
    turns = np.flatnonzero(np.diff(again, prepend=False))
    low, high = turns[0::2], turns[1::2] - 1
    of = np.searchsorted(at, low, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    for i, a, z in zip(of.tolist(), (low - at[of]).tolist(), (high - at[of]).tolist(), strict=True):
        out[i].append((a, z))
    return out


def shared_stretches(pieces: list[tuple[int, int, bool, bytes]], window: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """Of pieces (anchor, windows, wanted, bytes): which piece, first and last window of the stretches that have to be sorted.

    Windows that lie alike towards their anchor, a quarter of a window at most
    apart, form a block. Equal windows lie in blocks that share the same bytes
    around the anchor, so a block whose bytes are in no other block, or only in
    those of pieces that are not wanted, holds nothing to be found.
    """
    width = max(1, window // 4)
    data = np.frombuffer(b"".join(x[3] for x in pieces), np.uint8)
    n = len(data) - gram + 1
    p, inverse = prefix_hash(data), powers(INVERSE, len(data) + 1)
    sizes = np.array([len(x[3]) for x in pieces], np.int64)
    anchor = np.array([x[0] for x in pieces], np.int64).view(np.uint64)
    windows, wanted = np.array([x[1] for x in pieces], np.int64), np.array([x[2] for x in pieces], bool)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    q = np.flatnonzero(mix((p[gram:] - p[:n]) * inverse[:n]) == np.repeat(anchor, sizes)[:n])
    piece = np.searchsorted(ends, q, "right")
    inside = q + gram <= ends[piece]
    q, piece = q[inside], piece[inside]
    # The windows whose first anchor is at q, and the blocks that they lie in.
    low = starts[piece]
    low[1:] = np.where(piece[1:] == piece[:-1], q[:-1] + 1, low[1:])
    high = np.minimum(q, starts[piece] + windows[piece] - 1)
    some = low <= high
    q, piece, low, high = q[some], piece[some], low[some], high[some]
    near, many = (q - high) // width, (q - low) // width - (q - high) // width + 1
    of = np.repeat(np.arange(len(q)), many)
    k = (near + many - 1)[of] - (np.arange(len(of)) - (np.cumsum(many) - many)[of])  # by place
    q, piece, low, high = q[of], piece[of], low[of], high[of]
    a, z = q - k * width, q - (k + 1) * width + 1 + window  # what all windows of a whole block share
    core = mix((p[z] - p[a]) * inverse[a] + mix(anchor[piece] + k.astype(np.uint64)))
    _, kind, times = np.unique(core, return_inverse=True, return_counts=True)
    kept = np.flatnonzero((times > 1)[kind] & (np.bincount(kind, wanted[piece], len(times)) > 0)[kind])
    piece, low, high = piece[kept], np.maximum(low, a - width + 1)[kept] - starts[piece[kept]], np.minimum(high, a)[kept] - starts[piece[kept]]
    turn = np.append(True, (piece[1:] != piece[:-1]) | (low[1:] != high[:-1] + 1))[: len(piece)]
    yield from zip(piece[turn].tolist(), low[turn].tolist(), high[np.append(turn[1:], True)[: len(piece)]].tolist(), strict=True)


def sort_shards(pieces: DataFrame, window: int, shard_bytes: int, folder: str, gram: int = GRAM) -> DataFrame:
    """anchor, run, low, high: the stretches (relative to the run) of windows that occur elsewhere, of pieces (anchor, run, n, windows, bytes)."""

    def flush(held: list) -> pd.DataFrame:
        place = folder.removeprefix("file://") if folder.startswith("file://") else None  # queues of this task only; in memory where the shared store has no files
        found = marks([(x[4], x[3], x[2]) for x in held], window, place)
        release()
        rows = [(x[0], x[1], x[5] + a, x[5] + b) for x, spans in zip(held, found, strict=True) for a, b in spans]
        return pd.DataFrame(rows, columns=["anchor", "run", "low", "high"]).astype({"anchor": "int64", "run": "int64", "low": "int32", "high": "int32"})

    def cut(rows: list) -> Iterator[tuple]:
        """What has to be sorted of all rows of some anchors: anchor, run, wanted, windows, bytes, first window."""
        for i, a, z in shared_stretches([(x[0], x[3], x[2] == 1, x[4]) for x in rows], window, gram):
            anchor, content, n, _, raw = rows[i]
            yield anchor, content, n == 1, z - a + 1, raw[a : z + window], a

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        rows, size, seen, held = [], 0, None, []
        for row in chain.from_iterable(part.itertuples(index=False, name=None) for part in parts):
            if row[:2] == seen:  # of a repeated row
                continue
            if size >= shard_bytes and row[0] != seen[0]:
                held += cut(rows)
                rows, size = [], 0
                if sum(len(x[4]) for x in held) >= shard_bytes:
                    yield flush(held)
                    held = []
            rows.append(row)
            size, seen = size + len(row[4]), row[:2]
        if held := [*held, *(cut(rows) if rows else ())]:
            yield flush(held)

    parts = shuffle_partitions(pieces.sparkSession)
    return batches(pieces.select("anchor", "run", "n", "windows", "bytes").repartition(parts, "anchor").sortWithinPartitions("anchor", "run")).mapInPandas(run, "anchor long, run long, low int, high int")


def blocks(raw: bytes, anchor: int, stretches: list[tuple[int, int]], width: int, window: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """Cuts stretches of a piece's windows into blocks that lie alike towards the anchor: first and last window, hashes of the core and of the hull.

    The core is what all windows of a whole block would share, the hull what
    the block's windows cover. Equal windows lie in blocks of equal cores; the
    windows of blocks with equal hulls are all equal.
    """
    data = np.frombuffer(raw, np.uint8)
    n = len(data) - gram + 1
    p, inverse = prefix_hash(data), powers(INVERSE, len(data) + 1)
    places = np.flatnonzero(mix((p[gram:] - p[:n]) * inverse[:n]) == np.uint64(anchor & 0xFFFFFFFFFFFFFFFF))
    for first, last in stretches:
        i = np.arange(first, last + 1)
        at = places[np.searchsorted(places, i)]  # the anchor's first place in each window
        block = (at - i) // width
        turn = np.flatnonzero((np.diff(at) != 0) | (np.diff(block) != 0)) + 1
        starts, ends = np.append(0, turn), np.append(turn, len(i)) - 1
        for a, z, q, k in zip(i[starts].tolist(), i[ends].tolist(), at[starts].tolist(), block[starts].tolist(), strict=True):
            core = raw[q - k * width : q - (k + 1) * width + 1 + window]
            yield a, z, xxhash.xxh3_64_intdigest(core, k), xxhash.xxh3_64_intdigest(raw[a : z + window], q - a)


def count_windows(pieces: DataFrame, window: int, gram: int) -> DataFrame:
    """As sort_shards, by hashes in place of a sort; no task holds more than one piece, whatever its anchor.

    A round counts blocks of windows. A block whose core is nowhere else holds
    no repeated window; one whose hull is elsewhere holds no other. The rest
    goes on in smaller blocks, and one block for each repeated hull with it.
    """
    schema = "piece long, anchor long, run long, wanted boolean, low int, high int, core long, hull long"
    held = stash(pieces.select(F.monotonically_increasing_id().alias("piece"), "anchor", "run", (F.col("n") == 1).alias("wanted"), "windows", "bytes"), "suffix-hot-pieces")
    asked, found, used = held.withColumn("asked", F.array(F.struct(F.lit(0).alias("low"), (F.col("windows") - 1).cast("int").alias("high")))), None, []
    for width in BLOCKS:
        def run(parts: Iterator[pd.DataFrame], width: int = width) -> Iterator[pd.DataFrame]:
            release()
            for part in parts:
                out = []
                for piece, anchor, content, wanted, raw, stretches in zip(*(part[c] for c in ("piece", "anchor", "run", "wanted", "bytes", "asked")), strict=True):
                    out += [(piece, anchor, content, wanted, *b) for b in blocks(raw, anchor, [(x["low"], x["high"]) for x in stretches], width, window, gram)]
                    if len(out) > LEAVE:
                        yield frame(out)
                        out = []
                yield frame(out)

        def frame(out: list) -> pd.DataFrame:
            rows = pd.DataFrame(out, columns=["piece", "anchor", "run", "wanted", "low", "high", "core", "hull"])
            return rows.astype({"wanted": bool, "core": np.uint64, "hull": np.uint64}).astype({"core": np.int64, "hull": np.int64})

        rows = stash(batches(asked.select("piece", "anchor", "run", "wanted", "bytes", "asked")).mapInPandas(run, schema), "suffix-blocks")
        place = F.struct("run", "low")  # of a repeated row the same
        hulls = rows.groupBy("anchor", "core", "hull").agg(F.min(place).alias("one"), F.max(place).alias("last"), F.min(F.struct("run", "low", "piece", "high")).alias("own"), F.max("wanted").alias("wanted"))
        hulls = stash(hulls.withColumn("again", F.col("one") != F.col("last")), "suffix-hulls")
        done = rows.where("wanted").join(hulls.where("again").select("anchor", "core", "hull"), ["anchor", "core", "hull"]).select("anchor", "run", "low", "high").distinct()
        found = done if found is None else found.unionByName(done)
        used += [rows, hulls]
        if width > 1:
            # Cores of several hulls, one of them of windows that are asked for and not yet known to repeat.
            cores = hulls.groupBy("anchor", "core").agg(F.count(F.lit(1)).alias("hulls"), F.max(F.col("wanted") & ~F.col("again")).alias("open"), F.max("again").alias("any")).where("open AND (hulls > 1 OR any)").select("anchor", "core")
            some = hulls.join(cores, ["anchor", "core"]).select("own.piece", "own.low", "own.high").groupBy("piece").agg(F.collect_list(F.struct("low", "high")).alias("asked"))
            asked = held.join(some, "piece")
    out = stash(found, "suffix-counted")
    discard(held, *used)
    return out


def whole_words(raw: bytes, low: int, high: int) -> int:
    """How many words of a text lie whole between two of its bytes."""
    some = raw[low:high].split()
    cut = bool(some) and low > 0 and not raw[low - 1 : low].isspace() and not raw[low : low + 1].isspace()
    cut_end = bool(some) and high < len(raw) and not raw[high - 1 : high].isspace() and not raw[high : high + 1].isspace()
    return max(0, len(some) - cut - cut_end)


def merged(stretches, window: int) -> list[list[int]]:
    """Stretches of windows (low, high) as the maximal runs of bytes that they cover: start and end."""
    out: list[list[int]] = []
    for low, high in sorted((x["low"], x["high"] + window) for x in (stretches if stretches is not None else ())):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def without(raw: bytes, gone: list[list[int]]) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *(g[1] for g in gone)], [*(g[0] for g in gone), len(raw)], strict=True)) if gone else raw


def _bytes(text: str | bytes) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["_d"]) & (a["key"] == b["_k"])


def repeats(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """_d, _k, spans: for each doc_id and key of rows (doc_id, key, text) the stretches of windows that also start elsewhere; written.

    text is a string or binary. Rows with the same doc_id and key must have the same text.
    """
    rows = rows.select("doc_id", "key", "text").where(F.octet_length("text") >= window)
    runs_ = stash(all_runs(rows, window, gram), "suffix-runs")
    often = runs_.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), F.max("again").alias("any")).where("times > 1 OR any").select("anchor")
    found = stash(runs_.join(often, "anchor"), "suffix-repeated")
    discard(runs_)
    kinds = stash(found.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"), F.min(F.struct("doc_id", "key", "low", "high")).alias("one")), "suffix-kinds")
    length = F.col("one.high") - F.col("one.low") + F.lit(window).cast("long")
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"), F.max("again").alias("any"), F.sum(length).alias("size")).where("least = 1 AND (kinds > 1 OR any)").select("anchor", "size")
    hot = stash(several.where(F.col("size") > hot_bytes).select("anchor"), "suffix-hot")
    several = several.where(F.col("size") <= hot_bytes).select("anchor")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text, asked in zip(part["text"], part["asked"], strict=True):
                raw = _bytes(text)
                out += [(x["anchor"], x["run"], x["n"], x["high"] - x["low"] + 1, raw[x["low"] : x["high"] + window]) for x in asked]
            yield pd.DataFrame(out, columns=["anchor", "run", "n", "windows", "bytes"])

    def pieces(anchors: DataFrame) -> DataFrame:
        ask = kinds.join(anchors, "anchor").select("anchor", "run", "n", "one.*").groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.collect_list(F.struct("anchor", "run", "n", "low", "high")).alias("asked"))
        return batches(rows.join(ask, _same(rows, ask)).select("text", "asked")).mapInPandas(cut, "anchor long, run long, n long, windows long, bytes binary")

    marked = sort_shards(pieces(several), window, shard_bytes, scratch(rows.sparkSession), gram)
    if not hot.isEmpty():
        marked = marked.unionByName(count_windows(pieces(hot), window, gram))

    whole = kinds.where("n > 1").select("anchor", "run").join(found, ["anchor", "run"]).select("doc_id", "key", "low", F.col("high"))
    partly = found.join(marked.select("anchor", "run", F.col("low").alias("a"), F.col("high").alias("b")), ["anchor", "run"]).select("doc_id", "key", (F.col("low") + F.col("a")).alias("low"), (F.col("low") + F.col("b")).alias("high"))
    spans = stash(whole.union(partly).groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.collect_set(F.struct("low", "high")).alias("spans")), "suffix-spans")
    discard(found, kinds, hot)
    return spans


def repeats_within(rows: DataFrame, spans: DataFrame, narrow: int, window: int, gram: int, shard_bytes: int, hot_bytes: int) -> DataFrame:
    """As repeats(), where `spans` has the stretches of windows of `narrow` bytes, fewer than `window`: what repeats lies within what these cover."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(d, k, a, raw[a:b]) for d, k, text, stretches in zip(part["doc_id"].astype("Int64"), part["key"], part["text"], part["spans"], strict=True)
                   for raw in [_bytes(text)] for a, b in merged(stretches, narrow) if b - a >= window]
            yield pd.DataFrame(out, columns=["doc_id", "_key", "start", "text"]).astype({"doc_id": "Int64"})

    cut = batches(rows.join(spans, _same(rows, spans)).select("doc_id", "key", "text", "spans")).mapInPandas(run, "doc_id long, _key long, start int, text binary")
    segments = stash(cut.withColumn("key", F.xxhash64("_key", "start")), "suffix-segments")
    inner = repeats(segments, window, gram, shard_bytes, hot_bytes)
    names = segments.select("doc_id", "key", "_key", "start").distinct()
    out = names.join(inner, _same(names, inner)).select("_d", "_key", F.explode(F.transform("spans", lambda x: F.struct((x["low"] + F.col("start")).alias("low"), (x["high"] + F.col("start")).alias("high")))).alias("x"))
    out = stash(out.groupBy("_d", F.col("_key").alias("_k")).agg(F.collect_list("x").alias("spans")), "suffix-spans")
    discard(segments, inner)
    return out


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: tuple[str, ...] = (), texts: bool = False, least_words: int = 0, passages: tuple[int, int] | None = None, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Removes from each text of docs (doc_id, text) every byte covered by a `window`-byte string that also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, the columns in
    `keep` and, if asked for, kept: the remaining text, without characters of
    which only some bytes remain. With `least_words`, runs of such bytes that
    hold fewer whole words stay. With `passages`, kept is instead the text
    without repeated passages of at least so many bytes (fewer than `window`)
    and whole words, whatever the other columns say. Strings are judged on the
    input, over all rows, the same row included. A null text counts as empty.
    Rows count each for itself, also those that share a doc_id or have none; a
    row that repeats thereby removes all of a text of `window` bytes or more.
    Very long texts are cut whole, never a prefix. Columns of other names than
    doc_id and text are left out unless in `keep`, whatever they are called.
    Nothing depends on the order of rows, so ties need no rule. An empty table
    gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep]).withColumn("key", F.xxhash64("text"))
    narrow, words = passages or (window, least_words)
    spans = repeats(rows, narrow, gram, shard_bytes, hot_bytes)
    both = spans.withColumn("wide", F.col("spans"))
    if passages:
        wide = repeats_within(rows, spans, narrow, window, gram, shard_bytes, hot_bytes)
        both = spans.join(wide.select(F.col("_d").alias("_e"), F.col("_k").alias("_l"), F.col("spans").alias("wide")), F.col("_d").eqNullSafe(F.col("_e")) & (F.col("_k") == F.col("_l")), "left").select("_d", "_k", "spans", "wide")
    names = [f"keep_{c}" for c in keep]

    def remove(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text, stretches, wide in zip(part["text"], part["spans"], part["wide"], strict=True):
                raw = _bytes(text)
                fit = [g for g in merged(stretches, narrow) if not words or whole_words(raw, *g) >= words]
                gone = merged(wide, window) if passages else fit
                kept = without(raw, gone)
                left = None if not texts else without(raw, fit).decode("utf-8", "ignore") if fit else text
                out.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), left))
            more = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            yield pd.concat([part[["doc_id", *names]].astype({"doc_id": "Int64"}).reset_index(drop=True), more], axis=1)

    kinds_of = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds_of[c]}" for c in ["doc_id", *names]) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    out = batches(rows.join(both, _same(rows, both), "left").select("doc_id", *names, "text", "spans", "wide")).mapInPandas(remove, schema)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *[F.col(f"keep_{c}").alias(c) for c in keep], *(["kept"] if texts else []))


def op3_induced_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents, and text: what remains without repeated passages of over 50 words.

    Nulls, empty and very long texts, repeated rows, ties, clashing columns and
    empty tables as in dedup().
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, texts=True, passages=(PASSAGE_BYTES, PASSAGE_WORDS)).withColumnRenamed("kept", "text")
