"""Best-fit packing of token sequences by exact-complement hashing.

Documents become pieces of at most `capacity` tokens. Only the histogram of
piece lengths (at most `capacity` rows, whatever the corpus) reaches the
driver. There, for each length from the longest down, an index of single, pair
and triple length sums names combinations that fill the gap exactly; a
combination is consumed as often as all its lengths are available. What is
left is packed best-fit decreasing, again by counts. The resulting patterns
are handed to the pieces by their rank within their length.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._util import batches, caches, group_rank, release, stash, text_or_empty

CAPACITY = 4096
END_ID = 1
# What a tokenizer must do to texts for its ids to be those of the texts' words.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}
#: The last letter that is taken as Latin here, and for letters the characters that the byte-level rule puts for their bytes.
LATIN = "\u017f"
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = dict(zip([*_OWN, *(b for b in range(256) if b not in _OWN)], [*_OWN, *range(256, 324)], strict=True))
BYTES = {c: "".join(chr(_BYTE[b]) for b in chr(c).encode()) for c in range(128, ord(LATIN) + 1)}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_encoders: dict[str, WordEncoder] = {}
caches.append(_encoders)


class WordEncoder:
    """Token ids of whole texts, looked up word by word.

    A tokenizer with WORD_RULES drops white space and never merges over it, so a
    text's ids are those of its pieces between spaces and line feeds. `limit`
    bounds the words remembered between batches. With any other tokenizer whole
    texts are encoded.
    """

    def __init__(self, path: str, limit: int = 400_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.new, self.kept = Tokenizer.from_file(path), limit, [], 0
        read = json.loads(self.tokenizer.to_str())
        self.by_word = {k: read[k] for k in WORD_RULES} == WORD_RULES and read["model"].get("end_of_word_suffix") == "</w>"
        self.model = self.tokenizer.model
        self.direct = not any(t["content"].strip().isalpha() for t in read["added_tokens"])
        encoder = self

        class Words(dict):
            def __missing__(self, word):
                encoder.new.append(word)
                self[word] = at = len(self)
                return at

        self.words = Words({"": 0})
        self.ids = np.zeros(1 << 20, np.uint32)
        #: Of each word: where its ids are, in up to two runs.
        self.at, self.size = np.zeros((1 << 19, 2), np.int32), np.zeros((1 << 19, 2), np.int32)
        self.used = 0

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            release(_encoders)
            _encoders[path] = cls(path)
        return _encoders[path]

    def _learn(self) -> None:
        """Takes up the new words. The tokenizer gives a word the ids of its lower-case form, and commas and full stops
        at its end the same ids as apart from it: such words refer to one or two others."""
        words, new, number = self.words, self.new, len(self.words) - len(self.new)
        refer, leaves, leaf_at = {}, [], []
        lows = [w.lower() for w in new]
        stems = [w.rstrip(",.") for w in lows]
        for i, (word, low, stem) in enumerate(zip(new, lows, stems, strict=True), number):
            if low == word == stem and word.isascii():
                leaves.append(word), leaf_at.append(i)
            elif "<|" in word or not word.isascii() and ("\u03a3" in word or "\u0130" in word or not unicodedata.is_normalized("NFC", word)):
                leaves.append(word), leaf_at.append(i)
            elif stem and len(stem) < len(low) and stem[-1].isalpha():
                refer[i] = (stem, low[len(stem) :])
            elif low == word:
                leaves.append(word), leaf_at.append(i)
            else:
                refer[i] = (low, "")
        for parts in list(refer.values()):
            for p in parts:
                if p not in words:
                    words[p] = i = len(words)
                    new.append(p), leaves.append(p), leaf_at.append(i)
        while len(words) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.size[number : len(words)] = 0
        for k in range(0, len(leaves), 20_000):
            some = leaves[k : k + 20_000]
            found = self._pieces(some)
            at, sizes = np.array(leaf_at[k : k + 20_000], np.int64), np.fromiter(map(len, found), np.int64, len(found))
            self.at[at, 0], self.size[at, 0] = self._append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))) + np.cumsum(sizes) - sizes, sizes
        if refer:
            which = np.fromiter(refer, np.int64, len(refer))
            for k in (0, 1):
                part = np.array([words[p[k]] for p in refer.values()], np.int64)
                self.at[which, k], self.size[which, k] = self.at[part, 0], self.size[part, 0]

    def _pieces(self, words: list[str]) -> list[list[int]]:
        """The ids of each word. The rules leave a lower-case word of Latin letters whole, so the model gets it without them."""
        merge, found, other = self.model.tokenize, [], []
        for i, word in enumerate(words):
            if not self.direct or not word.isalpha() or not word.islower() or not word.isascii() and max(word) > LATIN:
                other.append(i), found.append([])
            else:
                found.append([t.id for t in merge(word if word.isascii() else word.translate(BYTES))])
        for i, e in zip(other, self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False), strict=True):
            found[i] = e.ids
        return found

    def _append(self, flat: np.ndarray) -> int:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return self.used - len(flat)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        if not self.by_word:
            yield from (np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))
            return
        if len(self.words) > self.limit:
            for word in self.new[max(0, self.limit - self.kept) :]:
                del self.words[word]
            self.used = int((self.at + self.size)[: len(self.words)].max())
        self.new, self.kept = [], len(self.words)
        split = [t.replace("\n", " ").split(" ") for t in texts]
        found = [np.fromiter(map(self.words.__getitem__, w), np.int64, len(w)) for w in split]
        del split
        self._learn()
        for word in found:
            at, sizes = self.at[word].ravel(), self.size[word].ravel()
            ends = np.cumsum(sizes, dtype=np.int64)
            yield self.ids[np.repeat(at - ends + sizes, sizes) + np.arange(ends[-1])]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A null or empty text is one piece of the end id."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder.of(tokenizer)
        for part in parts:
            ids, piece, start, length, crc = [], [], [], [], []
            rows = list(zip(part["doc_id"], part["text"], strict=True))
            i = 0
            while i < len(rows):
                j, chars = i, 0
                while j < len(rows) and (j == i or chars + len(rows[j][1]) < 3_000_000):
                    chars += len(rows[j][1])
                    j += 1
                for (doc_id, _), tokens in zip(rows[i:j], encoder.encode([t for _, t in rows[i:j]]), strict=True):
                    raw = np.append(tokens, np.uint32(END_ID)).astype("<u4")
                    for k, a in enumerate(range(0, len(raw), capacity)):
                        cut = raw[a : a + capacity]
                        ids.append(doc_id), piece.append(k), start.append(a), length.append(len(cut)), crc.append(zlib.crc32(cut.tobytes()))
                i = j
            yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "piece": np.array(piece, np.int32), "start": np.array(start, np.int64), "length": np.array(length, np.int64), "ids_crc32": np.array(crc, np.int64)})

    return batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))).mapInPandas(run, PIECES)


class Sums:
    """An index of the sums of two and of three available lengths.

    Lengths only ever become fewer and the longest that is asked for shorter,
    so an entry that was passed over once is never needed again.
    """

    def __init__(self, left: dict[int, int], capacity: int):
        self.left = left
        self.lengths = np.array(sorted(left, reverse=True), np.int32)
        rows = [(x, self.lengths[i:][self.lengths[i:] < capacity - x]) for i, x in enumerate(self.lengths.tolist())]
        first, second = (np.concatenate([np.zeros(0, np.int16), *parts]) for parts in ([np.full(len(y), x, np.int16) for x, y in rows], [y.astype(np.int16) for _, y in rows]))
        total = first.astype(np.int32) + second
        order = np.argsort(total, kind="stable")  # of equal sums the longest first
        self.first, self.second = first[order], second[order]
        self.next = np.searchsorted(total[order], np.arange(capacity + 2))
        self.end = self.next[1:].copy()
        self.next_of_three = np.zeros(capacity + 1, np.int64)

    def pair(self, total: int, longest: int) -> tuple[int, int] | None:
        """Two available lengths, none above `longest`, with this sum, beside one piece of `longest`."""
        left, i, end = self.left, int(self.next[total]), int(self.end[total])
        while i < end:
            a, b = int(self.first[i]), int(self.second[i])
            if a <= longest and left.get(b, 0) > (b == longest and a != b) and left.get(a, 0) > (a == longest) + (a == b):
                break
            i += 1
        self.next[total] = i
        return (a, b) if i < end else None

    def triple(self, total: int, longest: int) -> tuple[int, int, int] | None:
        left, i = self.left, int(self.next_of_three[total])
        while i < len(self.lengths) and 3 * (a := int(self.lengths[i])) >= total:
            if a <= longest and a in left and a < total - 1 and (found := self.pair(total - a, longest)) and left[a] > found.count(a) + (a == longest):
                self.next_of_three[total] = i
                return a, *found
            i += 1
        self.next_of_three[total] = i
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins for that many pieces of each length: (lengths in a bin, number of such bins)."""
    left = {k: n for k, n in histogram.items() if n > 0}
    assert all(0 < k <= capacity for k in left), "a piece is longer than the capacity"
    bins: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> bool:
        """Consumes the combination as often as its lengths are there."""
        need = {k: lengths.count(k) for k in lengths}
        n = min(left.get(k, 0) // m for k, m in need.items())
        if n:
            bins.append((lengths, n))
            for k, m in need.items():
                left[k] -= m * n
                if not left[k]:
                    del left[k]
        return n > 0

    if left.get(capacity):
        take((capacity,))
    sums = Sums(left, capacity)
    for longest in sorted(left, reverse=True):
        gap = capacity - longest
        while left.get(longest):
            if gap in left and take((longest, gap)):
                continue
            if (found := sums.pair(gap, longest)) and take((longest, *found)):
                continue
            if (found := sums.triple(gap, longest)) and take((longest, *found)):
                continue
            break

    # Best fit for the rest: groups of equal bins, by their free room.
    rooms: list[int] = []
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(lengths: tuple[int, ...], n: int) -> None:
        room = capacity - sum(lengths)
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append((lengths, n))

    for k in sorted(left, reverse=True):
        n = left[k]
        while n:
            i = bisect_left(rooms, k)
            if i == len(rooms):
                per, m = capacity // k, n // (capacity // k)
                if m:
                    put((k,) * per, m)
                if n % per:
                    put((k,) * (n % per), 1)
                break
            room = rooms[i]
            lengths, there = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[i]
            per = min(room // k, n)
            used = min(there, n // per)
            put((*lengths, *[k] * per), used)
            if there > used:
                put(lengths, there - used)
            n -= used * per
    return bins + [g for room in rooms for g in groups[room]]


def slots(bins: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length, runs of ranks: first rank, first sequence_id and offset of a run of equal places."""
    rows, used, first = [], {}, 0
    for lengths, n in bins:
        offset = 0
        for k in lengths:
            rows.append((k, used.get(k, 0), first, offset))
            used[k] = used.get(k, 0) + n
            offset += k
        first += n
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def place(ranked: DataFrame, runs: pd.DataFrame) -> DataFrame:
    """Gives each piece (length, _rank) its sequence_id and offset. `runs` has a few rows per distinct length."""
    length, rank, sequence, offset = (runs[c].to_numpy(np.int64) for c in ("length", "rank", "sequence", "offset"))
    names = [c for c in ranked.columns if c != "_rank"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = np.searchsorted(length, np.arange(length.max(initial=0) + 2))
        for part in parts:
            at, r = part["length"].to_numpy(np.int64), part["_rank"].to_numpy(np.int64)
            i = np.empty(len(part), np.int64)
            order = np.argsort(at, kind="stable")
            for k, idx in zip(*_groups(at[order], order), strict=True):
                a, b = first[k], first[k + 1]
                i[idx] = a + np.searchsorted(rank[a:b], r[idx], side="right") - 1
            out = part[names].copy()
            out["sequence_id"], out["offset"] = sequence[i] + r - rank[i], offset[i]
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInPandas(run, f"{schema}, sequence_id long, offset long")


def _groups(values: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    return [int(values[c]) for c in [0, *cuts]] if len(values) else [], np.split(order, cuts) if len(values) else []


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs every document of docs (doc_id, text; more columns are ignored) into sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    A null text counts as empty and is one piece of one id. Rows with a null or
    repeated doc_id are packed each for itself. Pieces of equal length are
    interchangeable; which of them goes where follows a hash of doc_id and
    piece. An empty table gives no rows. Texts of any length are tokenized whole.
    """
    pieces = stash(tokenize(docs, tokenizer or default_tokenizer(), capacity), "packing-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    ranked = group_rank(pieces, ["length"], F.xxhash64("doc_id", "piece", "ids_crc32"), "_rank")
    return place(ranked, slots(plan(counts, capacity)))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every piece of documents; nulls, repeated rows and the like as in pack()."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
