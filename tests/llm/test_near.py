import numpy as np
import pytest

import corpus_pipeline
from textloom.llm import near
from textloom.llm.bytewords import FOLD


def sets(texts):
    import re

    out = []
    for t in texts:
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", t.encode().translate(bytes(FOLD))) if x]
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def components(ids, shingle_sets):
    parent = list(range(len(ids)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(shingle_sets):
        for j in range(i):
            b = shingle_sets[j]
            if ids[i] is not None and ids[j] is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[top(i)] = top(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[top(i)] = min(x, least.get(top(i), x))
    return [None if x is None else least[top(i)] for i, x in enumerate(ids)]


def test_groups_equal_brute_force(corpus, rows):
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    s = sets(texts)
    want = sorted(((i, len(x), c, i is None or c == i) for i, x, c in zip(ids, s, components(ids, s), strict=True)), key=str)
    assert sorted((tuple(r) for r in near.group(corpus).collect()), key=str) == want
    assert len({w[2] for w in want}) < len(want) - 10


def test_leftover_pairs_connect(spark):
    """A chain of which the smallest id is linked with the next only."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[k * 4 : k * 4 + 100]) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = sets(texts)
    assert [r["component_id"] for r in near.group(df).orderBy("doc_id").collect()] == components(list(range(20)), s) == [0] * 20


@pytest.mark.parametrize("jaccard", [0.2, 0.5, 0.75, 0.9])
def test_estimate(jaccard):
    rng = np.random.default_rng(1)
    both = int(1000 * 2 * jaccard / (1 + jaccard))
    got = []
    for _ in range(30):
        x = rng.integers(0, 1 << 63, 2000 - both, dtype=np.uint64)
        a, b = near.registers(np.sort(x[:1000])), near.registers(np.sort(x[1000 - both :]))
        got.append(near.similarity(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([1000.0]), np.array([1000.0]))[0])
        assert (near.merge(a, b) == near.registers(np.sort(x))).all()
    assert abs(np.mean(got) - jaccard) < 0.03


def test_no_rows(nothing):
    assert near.group(nothing).collect() == []


def test_only_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert sorted(tuple(r) for r in near.group(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_texts_that_share_a_doc_id(spark):
    """doc_id 1 stands on two unlike texts; 2 is near the one, 3 near the other, 4 an exact copy of the other."""
    one, other = (" ".join(f"{w}{i}" for i in range(60)) for w in ("left", "right"))
    rows = [(1, one), (1, other), (2, one + " more"), (3, other + " more"), (4, other), (5, "alone and unlike any other text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near.group(df).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 5, True)]
    docs = df.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    docs = docs.union(docs.where("doc_id = 5"))
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, one), (1, other), rows[-1]])
