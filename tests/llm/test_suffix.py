import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import induced, suffixdedup
from textloom.llm.induced import suffixes
from textloom.llm.suffixdedup import dedup


@pytest.mark.parametrize("seed", range(60))
def test_order_and_common_prefixes(seed, tmp_path):
    rng = np.random.default_rng(seed)
    t = rng.integers(2, 3 + seed % 5, rng.integers(1, 200))
    t[rng.integers(0, len(t), 3)] = 1
    if len(t) > 60:
        t[30:50] = t[:20]
    t, cap = np.append(t, 0).astype(np.uint16), [5, 20, 1000][seed % 3]
    got = [(int(p), int(c)) for position, common in suffixes(t, cap, str(tmp_path), 200 if seed % 2 else 1 << 20) for p, c in zip(position, common, strict=True)]
    line = t.tolist()
    assert sorted(p for p, _ in got) == list(range(len(line)))
    for (a, _), (b, common) in zip(got, got[1:], strict=False):
        same = 0
        while same < cap and a + same < len(line) and b + same < len(line) and line[a + same] == line[b + same]:
            same += 1
        assert common == same and line[a : a + cap] >= line[b : b + cap]
    assert not any(tmp_path.iterdir())


@pytest.mark.parametrize("names", [3, 1 << 15])
def test_numbers_in_order(names, monkeypatch):
    """The recursion on names: any numbers, also few, all equal and in periods, in blocks of few and of many."""
    monkeypatch.setattr(induced, "NAMES", names)
    rng = np.random.default_rng(names)
    for k in range(120):
        r = rng.integers(0, int(rng.integers(1, 60)), int(rng.integers(1, 150)))
        r = [r, np.tile(r[:7], 20), np.zeros(len(r), np.int64), np.sort(r)[::-1]][k % 4]
        line = r.tolist()
        assert induced.order_of(r, induced.Space(None, 1 << 20)).tolist() == sorted(range(len(line)), key=lambda i: line[i:])


def test_shard_of_many_times_the_memory(tmp_path, monkeypatch):
    """Queues, names' queues and arrays all go to disk, and the order is that of sorting in memory."""
    rng = np.random.default_rng(8)
    t = np.concatenate([rng.integers(2, 30, 20_000), np.tile(rng.integers(2, 30, 900), 30), np.full(3000, 7), rng.integers(2, 5, 20_000), [0]]).astype(np.uint16)
    written = []
    monkeypatch.setattr(induced.Queues, "_spill", lambda self, f=induced.Queues._spill: written.append("queue") or f(self))
    monkeypatch.setattr(induced.Space, "path", lambda self, f=induced.Space.path: written.append("array") or f(self))
    monkeypatch.setattr(induced, "NAMES", 500)
    whole = [np.concatenate(x) for x in zip(*suffixes(t, 400), strict=True)]
    assert not written
    parts = [np.concatenate(x) for x in zip(*suffixes(t, 400, str(tmp_path), 1 << 13), strict=True)]
    assert t.nbytes > 15 * (1 << 13) and written.count("queue") > 20 and written.count("array") > 20 and not any(tmp_path.iterdir())
    assert (parts[0] == whole[0]).all() and (parts[1] == whole[1]).all()
    line = t.tobytes()
    order = whole[0][::-1].tolist()
    deep = [np.frombuffer(line, np.uint16)[i : i + 400].astype(">u2").tobytes() for i in order]
    assert all(a <= b for a, b in zip(deep, deep[1:], strict=False)) and sorted(order) == list(range(len(t)))


def brute(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard_bytes", [2000, 1 << 20])
def test_equals_brute_force(corpus, rows, shard_bytes):
    short = [(i, t) for i, t, _ in rows if len(t) < 20_000]
    docs = corpus.where("text IS NULL OR length(text) < 20000")
    want = Counter((i, *x) for (i, _), x in zip(short, brute([t.encode() for _, t in short], 400), strict=True))
    got = dedup(docs, keep=("lang",), texts=True, shard_bytes=shard_bytes)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()) == want
    assert sum(w[2] > 0 for w in want) > 10
    assert {r["lang"] for r in got.collect()} == {"en", None}


def test_runs_of_one_byte_and_overlaps(spark):
    texts = ["x" * 400, "y" * 401, "ab" * 200, "ab" * 201, "z" * 399, "p" * 450 + "q" * 450]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in dedup(df).orderBy("doc_id").collect()]
    assert got == brute([t.encode() for t in texts], 400)


def test_no_rows(nothing):
    assert dedup(nothing).collect() == []


def test_hot_anchors_are_counted_by_window(corpus, rows, spark):
    short = [(i, t) for i, t, _ in rows if len(t) < 20_000]
    docs = corpus.where("text IS NULL OR length(text) < 20000")
    want = Counter((i, *x) for (i, _), x in zip(short, brute([t.encode() for _, t in short], 400), strict=True))
    got = dedup(docs, hot_bytes=0).collect()
    assert Counter(tuple(r) for r in got) == want
    texts = ["x" * 900, "x" * 1200, "ab" * 600 + "c", "b" + "ab" * 500, "p" * 450 + "q" * 450]
    got = dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot_bytes=500).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute([t.encode() for t in texts], 400)


def test_no_task_holds_a_hot_anchor(spark, monkeypatch):
    """A passage in 300 documents of unlike edges: all its runs have few anchors, and none of these is sorted whole."""
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    passage = word(600)
    texts = [word(380) + passage + word(380) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = []
    monkeypatch.setattr(suffixdedup, "sort_shards", lambda pieces, *rest, f=suffixdedup.sort_shards: sizes.extend(r["s"] for r in pieces.groupBy("anchor").agg(F.sum(F.length("bytes")).alias("s")).collect()) or f(pieces, *rest))
    whole = [tuple(r) for r in dedup(df).orderBy("doc_id").collect()]
    assert max(sizes) > 20_000
    sizes.clear()
    assert [tuple(r) for r in dedup(df, hot_bytes=20_000).orderBy("doc_id").collect()] == whole
    assert all(s <= 20_000 for s in sizes)
    assert [w[1:] for w in whole] == brute([t.encode() for t in texts], 400)


def test_passages_beside_the_window(corpus, rows):
    """One search for 200 bytes gives both results: strings of 400 bytes, and the text without passages of 51 whole words."""
    short = [(i, t) for i, t, _ in rows if len(t) < 20_000]
    docs = corpus.where("text IS NULL OR length(text) < 20000")
    raw = [t.encode() for _, t in short]
    wide, seen = brute(raw, 400), Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    want = Counter()
    for (i, _), t, w in zip(short, raw, wide, strict=True):
        gone = [False] * (len(t) + 1)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        left, k = b"", 0
        while k < len(t):
            e = k
            while e < len(t) and gone[e] == gone[k]:
                e += 1
            whole = sum(k <= m.start() and m.end() <= e for m in re.finditer(rb"[^\x20\x09-\x0D]+", t))
            left += b"" if gone[k] and whole >= 51 else t[k:e]
            k = e
        want[(i, *w, left.decode("utf-8", "ignore"))] += 1
    for hot in (4 << 20, 0):
        got = dedup(docs, texts=True, passages=(200, 51), hot_bytes=hot).collect()
        assert Counter(tuple(r) for r in got) == want
    assert sum(w[-1] != t for w, (_, t) in zip(want, short, strict=False)) > 10


def test_very_long_texts(spark):
    """Against a count of hashes of all windows, since comparing these is slow."""
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    shared = [word(n) for n in (399, 400, 401, 5000)]
    texts = [word(100_000) + shared[k % 4] + word(50_000) + shared[k // 2] for k in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = Counter(hash(t[i : i + 400]) for t in texts for i in range(len(t) - 399))
    want = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - 399):
            if seen[hash(t[i : i + 400])] > 1:
                gone[i] += 1
                gone[min(i + 400, len(t))] -= 1
        want.append(int((np.cumsum(gone)[:-1] > 0).sum()))
    assert [r["n_removed"] for r in dedup(df).orderBy("doc_id").collect()] == want and max(want) > 5000


@pytest.mark.parametrize(("low", "high", "words"), [(0, 3, 1), (0, 2, 0), (4, 7, 1), (3, 8, 1), (1, 11, 2), (0, 11, 3), (3, 4, 0), (5, 6, 0)])
def test_whole_words(low, high, words):
    assert suffixdedup.whole_words(b"one two six", low, high) == words


def test_what_is_alike_only_near_its_anchor_is_not_sorted(spark):
    """40 documents share 80 bytes, so they share anchors, but no window of 200 bytes; only the two that share more are sorted."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    near, more = word(80), word(70)
    raw = [(word(500) + near + word(500)).encode() for _ in range(40)] + [(word(500) + more + near + more + word(500)).encode() for _ in range(2)]
    pieces = [(int(a.view(np.int64)), int(z - b + 1), True, t[b : z + 200]) for t in raw for a, _, b, z, _ in zip(*suffixdedup.runs(t, 200, 32), strict=True)]
    seen = Counter(p[3][i : i + 200] for p in pieces for i in range(p[1]))
    want = {(k, i) for k, p in enumerate(pieces) for i in range(p[1]) if seen[p[3][i : i + 200]] > 1}
    found = list(suffixdedup.shared_stretches(pieces, 200, 32))
    kept = {(k, i) for k, a, z in found for i in range(a, z + 1)}
    assert want and want <= kept and len(kept) <= len(want) + 4 * 50
    assert not list(suffixdedup.shared_stretches([(*p[:2], False, p[3]) for p in pieces], 200, 32))
    cut = [(pieces[k][3][a : z + 200], z - a + 1, True) for k, a, z in found]
    got = {(k, a + i) for (k, a, _), spans in zip(found, suffixdedup.marks(cut, 200, None), strict=True) for x, y in spans for i in range(x, y + 1)}
    assert got == want


def test_packed_symbols(tmp_path):
    """Seven symbols in one number, also where a block or the text ends."""
    t = np.append(np.random.default_rng(2).integers(1, 258, 40), 0).astype(np.uint16)
    for block in (8, 1 << 19):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(induced, "BLOCK", block)
            got = induced.packed(t, induced.Space(str(tmp_path), 16))
            line = [*t.tolist(), *[0] * 6]
            assert got.tolist() == [sum(x << 9 * (6 - j) for j, x in enumerate(line[i : i + 7])) for i in range(len(t))]
    star = np.array([2, 9, 17, 30])
    assert induced.byte_names(got, star).tolist() == induced.names(t, star, 258).tolist()
