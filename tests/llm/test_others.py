import base64
import hashlib
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import mixing, quality, rules, sharding, topk, toxicity, warc
from textloom.llm._util import scratch


# Sharding

def test_shards(corpus, rows):
    got = sharding.shard(corpus, shards=4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(r["slot"] for r in part) == list(range(len(part))) for part in by.values())


def test_shards_are_even_with_a_hot_group(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.md5(F.col("id").cast("string")))).alias("text"))
    size = [r["s"] for r in sharding.shard(docs, tolerance=0.01).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(size) == 24 and max(size) - min(size) < 0.03 * np.mean(size)


def test_shards_of_ordinary_texts(spark):
    """Even sizes, and equal texts together unless they are more than what a shard may be off by."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = sharding.shard(docs).collect()
    size, home, weight = Counter(), defaultdict(set), Counter()
    for r in got:
        size[r["shard"]] += r["size"]
        home[r["text_crc32"], r["size"]].add(r["shard"])
        weight[r["text_crc32"], r["size"]] += r["size"]
    mean = np.mean(list(size.values()))
    assert sorted(size) == list(range(24)) and max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in got) + 2 * sharding.TOLERANCE * mean
    cut = [g for g, shards in home.items() if len(shards) > 1]
    assert all(weight[g] > sharding.TOLERANCE * mean for g in cut) and len(cut) <= 5 and len(home) < len(got) - 500


def test_no_shards(nothing):
    assert sharding.shard(nothing).collect() == []


# Mixing

def test_targets():
    assert mixing.targets([("b", 100), ("a", 100), (None, 100)]) == {"a": 50.0, "b": 100.0, None: 150.0}
    got = mixing.targets([("a", 1000), ("b", 10), ("c", 10)])
    assert got["b"] == 30 and got["c"] == 30 and got["a"] == 960
    assert mixing.targets([("a", 0)]) == {"a": 0.0} and mixing.targets([]) == {}


@pytest.mark.parametrize("seed", range(60))
def test_fit_is_as_near_as_any_sum(seed):
    """The programme covers all of so small a budget, so no choice of documents comes nearer than one word beyond the proportional share's."""
    rng = np.random.default_rng(seed)
    size = rng.choice(np.arange(1, 60), rng.integers(1, 6), replace=False)
    count = rng.integers(1, 4, len(size))
    times = int(rng.integers(1, 4))
    budget = int(rng.integers(0, (size * count).sum() + 1))
    got = mixing.fit(size, count, budget, 1, times)
    assert (got <= count * times).all() and (got >= 0).all()
    share = np.floor(count * (budget / (size * count).sum())).astype(int) if budget < (size * count).sum() else count
    sums = {int((share * size).sum())}
    for s, n, m in zip(size, count * times, share, strict=True):
        sums = {a + int(s) * k for a in sums for k in range(n - m + 1)}
    assert abs(int((got * size).sum()) - budget) == min(abs(x - budget) for x in sums)


def test_fit_takes_a_giant_if_that_is_nearer():
    assert mixing.fit(np.array([1_000_000]), np.array([1]), 900_000, 1).tolist() == [1]
    assert mixing.fit(np.array([1_000_000]), np.array([1]), 100_000, 1).tolist() == [0]
    assert mixing.fit(np.array([0]), np.array([5]), 0, 1).tolist() == [5] and mixing.fit(np.zeros(0), np.zeros(0), 0, 1).tolist() == []


def test_mix(corpus, rows):
    got = mixing.mix(corpus).collect()
    again = mixing.mix(corpus.repartition(5)).collect()
    key = lambda rs: Counter((r["doc_id"], r["source"], r["taken"]) for r in rs)
    assert key(got) == key(again) and len(got) == len(rows)
    words = Counter()
    for _, t, s in rows:
        words[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want = mixing.targets(list(words.items()))
    taken = Counter()
    for r in got:
        assert r["source_size"] == words[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    giant = {s for _, t, s in rows if len(t) > 30_000}  # one document of most of its source's words may not fit
    assert all(abs(taken[s] - want[s]) <= (12_000 if s in giant else 1) for s in words)


def test_rerun_of_rows_without_doc_id(spark):
    rows = [(None, f"{'word ' * (k % 3 + 2)}t{k}", "ab"[k % 2]) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [Counter((r["text"], r["copies"]) for r in mixing.mix(df.repartition(n).orderBy(F.rand(n)), keep=("text",)).collect()) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and len({c for _, c in runs[0]}) > 1


def test_mix_of_nothing(nothing):
    assert mixing.mix(nothing).collect() == []


# WARC

def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é\U0001f600" * 5000), (5, "u", "again"), (None, "n", "<p>x</p>"), (None, "n", "lone\r\n\r\ntext")]
    df = spark.createDataFrame([(*p, 0, b"z") for p in pages], "page_id long, url string, html string, offset int, payload binary")
    folder = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    index = warc.write(df, folder, archive_bytes=300)
    got = warc.read(index, folder, gap=10, most=200).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = Counter()
    for i, _, html in pages:
        same = [j for j, _, h in pages if (h or "") == (html or "") and j is not None]
        refers = min(same) if same and i != min(same) else None
        want[i, len((html or "").encode()), sha(html), "revisit" if refers is not None else "response", refers] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert {bytes(r["payload"]).decode() for r in got if r["payload"] is not None} == {p[2] or "" for p in pages}
    some = warc.read(index.where("page_id = 5"), folder).collect()
    assert len(some) == 2
    raw = warc.record(1, "u", b"abc", None, sha("abc"))
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw.replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="cut off"):
        warc.parse(raw[:-3])


def test_warc_of_nothing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    assert warc.read(warc.write(df, folder), folder).collect() == []


# Top-k

@pytest.mark.parametrize(("dimension", "k"), [(1, 3), (8, 10), (16, 4)])
def test_search_equals_all_pairs(spark, monkeypatch, dimension, k):
    monkeypatch.setattr(topk, "ROUND", 7 * 16)  # several rounds
    rng = np.random.default_rng(dimension)
    x = rng.normal(size=(500, dimension)).astype(np.float32)
    x[100:250] = x[0]  # a very common vector
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(900, None, 1), (901, [float("nan")] * dimension, 1), (902, [None] * dimension, 1), (903, [float("inf")] * dimension, 1), (None, x[0].tolist(), 1), (904, [0.5], 1)]
    again = [(3, x[3]), (50, x[50]), (150, x[7]), (150, x[7]), (200, x[9])]  # ids that repeat, with the same vector and with others, queries among them
    data += [(i, v.tolist(), 1) for i, v in again]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, upper int").repartition(5)
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, k).collect())
    rows = [(i, v) for i, v in enumerate(x)] + again + ([(904, np.array([0.5]))] if dimension == 1 else [])
    ids, v = [i for i, _ in rows], np.stack([np.floor(1024 * np.asarray(y, float)).astype(np.int64) for _, y in rows])
    want = []
    for q, i in enumerate(ids):
        if i % 50 == 0:
            best = sorted(((-int(v[c] @ v[q]), ids[c]) for c in range(len(ids)) if c != q))[:k]
            want += [(i, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    assert got == sorted(want)


def test_search_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (7, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 7, 1024 * 2048)]
    assert topk.search(df.where("vec_id < 0"), F.lit(True)).collect() == []


# Quality rules

def counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_features(corpus, rows, spark):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = rules.filter_quality(corpus).collect()
    assert Counter((r["doc_id"], *[r[c] for c in names]) for r in got) == Counter((i, *counts(t)) for i, t, _ in rows)
    odd = ["a b c d e " * 3, "x\nx\n \n \ny\nx", "#*$%&|<> |", "a b c d e f a b c d e", "  \x1c \x0b", "a a a a a a a", "a b c d e"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert [tuple(r[c] for c in names) for r in rules.features(df).orderBy("doc_id").collect()] == [counts(t) for t in odd]


def test_estimate_recovers_rates():
    rng = np.random.default_rng(3)
    good = rng.random(30_000) < 0.7
    on_good = np.array([[0.05, 0.1, 0.85], [0.1, 0.3, 0.6], [0.02, 0.5, 0.48], [0.2, 0.1, 0.7]])
    on_bad = np.array([[0.7, 0.1, 0.2], [0.5, 0.3, 0.2], [0.6, 0.3, 0.1], [0.3, 0.1, 0.6]])
    draw = lambda rates: np.stack([rng.choice(3, len(good), p=r) for r in rates], axis=1)
    votes = np.where(good[:, None], draw(on_good), draw(on_bad)) - 1
    share, rates = rules.estimate(Counter(map(tuple, votes.tolist())), 4)
    assert share == pytest.approx(0.7, abs=0.03) and rates[1] == pytest.approx(on_good, abs=0.04) and rates[0] == pytest.approx(on_bad, abs=0.04)


def plain_posterior(counts, rounds=rules.ROUNDS):
    """Expectation-maximisation written out vote by vote."""
    k = len(next(iter(counts)))
    share, rate = rules.GOOD, {(c, j, v): s[v + 1] for c, s in ((0, rules.ON_BAD), (1, rules.ON_GOOD)) for j in range(k) for v in (-1, 0, 1)}
    first = dict(rate)
    for last in range(rounds + 1):
        p = {}
        for votes in counts:
            w = [(1 - share, share)[c] * np.prod([rate[c, j, v] for j, v in enumerate(votes)]) for c in (0, 1)]
            p[votes] = w[1] / sum(w)
        if last == rounds:
            return p
        total = {c: sum(n * (p[x] if c else 1 - p[x]) for x, n in counts.items()) for c in (0, 1)}
        share = (total[1] + rules.GOOD * rules.PSEUDO) / (sum(counts.values()) + rules.PSEUDO)
        rate = {(c, j, v): (sum(n * (p[x] if c else 1 - p[x]) for x, n in counts.items() if x[j] == v) + rules.PSEUDO * first[c, j, v]) / (total[c] + rules.PSEUDO) for c, j, v in rate}


def test_verdicts(spark):
    """The verdict is that of the votes alone; it rejects texts that pass the base, and those labelled bad, which it has not seen."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = rules.filter_quality(docs).collect()
    names = [f"vote_{k}" for k in rules.rules()]
    passed = [(tuple(r[c] for c in names), r) for r in got if not r["base_failed"]]
    want = plain_posterior(Counter(v for v, _ in passed))
    assert all(r["probability"] == pytest.approx(want[v], abs=1e-9) and r["kept"] == (r["probability"] >= 0.5) for v, r in passed)
    assert 0.02 < sum(not r["kept"] for _, r in passed) / len(passed) < 0.2
    assert not any(r["kept"] for r in got if r["base_failed"])
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    known = [(r["probability"], quality[r["doc_id"]], r["kept"]) for _, r in passed if r["doc_id"] in quality]
    assert auc([(p, y) for p, y, _ in known]) > 0.97
    assert np.mean([k for _, y, k in known if y]) > 0.98 and np.mean([k for _, y, k in known if not y]) < 0.1
    assert rules.filter_quality(docs.where("doc_id < 0")).collect() == []


# Classifiers

def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])


@pytest.mark.parametrize(("classify", "label", "least"), [(toxicity.classify, "toxic", 0.9), (quality.classify, "quality", 0.9)])
def test_held_out_accuracy(spark, classify, label, least):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", label)
    got = classify(docs, labels).join(labels, "doc_id").collect()
    assert {r["doc_id"] for r in got if r["held_out"]} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert auc([(r["score"], r[label]) for r in got if r["held_out"]]) > least


@pytest.mark.parametrize(("classify", "label"), [(toxicity.classify, "toxic"), (quality.classify, "quality")])
def test_classifiers_take_anything(corpus, nothing, spark, classify, label):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(None, 1, "x"), (3, None, "x"), (4, 1, "x"), (9999, 1, "x")], f"doc_id long, {label} int, text string")
    got = classify(corpus, labels).collect()
    assert len(got) == corpus.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] is not None for r in got)
    assert classify(nothing, labels).collect() == []
    assert {round(r["score"], 6) for r in classify(corpus, labels.where("doc_id < 0")).collect()} == {0.5}


def plain_ftrl(rows, labels, epochs=toxicity.EPOCHS):
    """FTRL-proximal as published, one coordinate at a time."""
    z, n, w = defaultdict(float), defaultdict(float), {}

    def weight(k):
        if k is None:
            return -z[k] / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA)
        return 0.0 if abs(z[k]) <= toxicity.L1 else -(z[k] - np.sign(z[k]) * toxicity.L1) / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            w = {k: weight(k) for k in [*rows[i], None]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - labels[i]
            for k, x in w.items():
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / toxicity.ALPHA * x
                n[k] += g * g
    return {k: weight(k) for k in list(z)}


def test_learning_equals_plain_ftrl(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.5)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["good", "fine", "vile", "mean", "day", "sun", "rain"], 6)) for _ in range(80)]
    labels = [int("vile" in t or "mean sun" in t) for t in texts]
    bias, keys, weights = toxicity.learn(texts, labels)
    rows = [set() for _ in texts]
    for i, j, h, of in toxicity.grams(texts):
        for x, d in zip(h.tolist(), of.tolist(), strict=True):
            rows[i + d].add(x)
    want = plain_ftrl(rows, labels)
    assert bias == pytest.approx(want.pop(None), abs=1e-3)
    got = dict(zip(keys.tolist(), weights.tolist(), strict=True))
    assert set(got) == {k for k, w in want.items() if w} and 5 < len(got) < len(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-3) for k in got)


def test_calibration():
    rng = np.random.default_rng(2)
    odds = rng.normal(0, 3, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(1.5 * odds + 0.7)))).astype(int)
    assert toxicity.calibration(odds, y) == (pytest.approx(1.5, abs=0.1), pytest.approx(0.7, abs=0.1))
    assert toxicity.calibration(odds, np.zeros(20_000, int)) == (1.0, 0.0)
    slope, shift = toxicity.calibration(np.array([-5.0, -4, 4, 5]), np.array([0, 0, 1, 1]))
    assert 0 < slope < 5 and abs(shift) < 1


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i} " * 20, 1) for i in range(400)] + [(50, "x" * 100_000, 1), (51, None, 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels, 1000, 1 << 20).collect()
    assert Counter(r["_id"] for r in rows) == Counter([*range(40), 50, 51])  # one text of each doc_id
    assert len(toxicity.sample(docs, labels, 7, 1 << 20).collect()) <= 7
    some = toxicity.sample(docs, labels, 1000, 5000).collect()
    assert 50 not in {r["_id"] for r in some} and 4000 < sum(len(r["text"]) for r in some) <= 5000


def test_ridge_equals_a_plain_fit(spark):
    """The calibrated scores rank documents as one least-squares fit over all rows at once does."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    score = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    part = docs.join(labels.where(~toxicity.held_out()), "doc_id").select("text", "quality", (F.pmod(F.xxhash64(F.lit(quality.SEED), "doc_id"), F.lit(3)) == 0).alias("later")).collect()
    x, y = (np.array(v) for v in ([quality.statistics([r["text"]])[0] for r in part if not r["later"]], [2.0 * r["quality"] - 1 for r in part if not r["later"]]))
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1.0
    z = quality.fourier(x, mean, spread)
    d = z.shape[1]
    w = np.linalg.lstsq(np.vstack([z, np.sqrt(quality.RIDGE * len(z) / d + 1e-9) * np.eye(d)]), np.append(y, np.zeros(d)), rcond=None)[0]
    some = docs.where("doc_id < 300").collect()
    plain = quality.fourier(np.array([quality.statistics([r["text"] or ""])[0] for r in some]), mean, spread) @ w
    own = np.array([score[r["doc_id"]] for r in some])[np.argsort(plain)]
    assert (np.diff(own) >= -1e-9).all() and own[-1] - own[0] > 0.5


def test_isotonic():
    knots, levels = quality.isotonic(np.array([0.0, 1.0, 2.0, 3.0]), np.array([1.0, 0.0, 1.0, 2.0]), np.array([2.0, 1.0, 2.0, 2.0]))
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) > 0).all() and levels[-1] == 1.0
