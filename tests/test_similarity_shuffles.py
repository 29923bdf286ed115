"""What the similarity step shuffles: texts and each chunk's terms, not a row for each posting."""

import os
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from textloom.operators import similarity
from textloom.plans import catalog

WORDS = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
#: Every document has some 100 of 300 words, each of them once; no two are near.
DOCS = [(i, " ".join(w for j, w in enumerate(WORDS) if (i * i + 7 * i + j * j * (i % 97 + 1)) % 3 == 0)) for i in range(1500)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("shuffles"))
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def shuffled(spark) -> int:
    """Rows that stages have written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = spark._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def of(spark, make) -> tuple[list, int]:
    before = shuffled(spark)
    rows = make().collect()
    return rows, shuffled(spark) - before


POSTINGS = sum(len(set(t.split())) for _, t in DOCS)


def test_weights_shuffle_no_postings(spark, docs):
    rows, n = of(spark, lambda: similarity.weights(docs))
    assert len(rows) == POSTINGS
    df = Counter(w for _, t in DOCS for w in set(t.split()))
    assert all(r["df"] == df[r["term"]] for r in rows)
    assert n < POSTINGS / 3, n


def test_best_terms_shuffle_no_postings(spark, folder, docs):
    rows, n = of(spark, lambda: catalog.queries()["tfidf_weights_topk"](spark, folder))
    best = {}
    for r in similarity.weights(docs).collect():
        best.setdefault(r["doc_id"], []).append((-round(r["w"], 9), r["term"]))
    assert sorted((r["doc_id"], r["term"]) for r in rows) == sorted((i, t) for i, x in best.items() for _, t in sorted(x)[:3])
    assert n < POSTINGS / 3, n


def test_document_frequencies_shuffle_no_postings(spark, folder):
    rows, n = of(spark, lambda: catalog.queries()["doc_freq_all"](spark, folder))
    assert {r["term"]: r["df"] for r in rows} == Counter(w for _, t in DOCS for w in set(t.split()))
    assert n < POSTINGS / 3, n


def test_a_document_in_many_pairs_is_sent_once_to_a_group(spark):
    words = [f"term{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    near = [(i, " ".join([*words[:i], *words[i + 1:]])) for i in range(60)]
    docs = spark.createDataFrame(near, "doc_id long, text string")
    rows, _ = of(spark, lambda: similarity.cosine_pairs(docs))
    assert len(rows) == 60 * 59 // 2
    pairs = spark.createDataFrame([(r["a"], r["b"], 0) for r in rows], "a long, b long, t long")
    sizes = similarity._compared(pairs, docs, lambda p, d: p.assign(n=len(d))[["n"]], "n long").collect()
    assert {r["n"] for r in sizes} == {60} and len(sizes) == len(rows)


def test_candidates_are_few_more_than_pairs(spark, monkeypatch):
    """Two of 500 documents are near, yet each shares a rare term with many."""
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd"]
    texts = [" ".join(random.Random(i).sample(words, 30)) for i in range(499)]
    docs = spark.createDataFrame([*enumerate(texts), (499, texts[7] + " more")], "doc_id long, text string")
    written, most = similarity.written, []

    def counted(df, name):
        out = written(df, name)
        if name == "similarity-candidates":
            most.append(out.count())
        return out

    monkeypatch.setattr(similarity, "written", counted)
    assert [(r["a"], r["b"]) for r in similarity.cosine_pairs(docs).collect()] == [(7, 499)]
    assert 1 <= max(most) < 1000, most  # joined by shared terms: 9303


#: Twelve groups of texts of 4 to 90 words that differ in a few, and 60 texts of their own.
GROUPS = [(100 * g + i, " ".join(w for j, w in enumerate(WORDS[20 * g :] + WORDS[: 20 * g]) if j < 4 + 7 * g and (j * 31 + i * 17) % (9 + g) > 0)) for g in range(12) for i in range(25)]
MIXED = GROUPS + [(5000 + i, " ".join(WORDS[(i * 7 + j * (i + 1)) % 300] for j in range(5 + 3 * i))) for i in range(60)]


def test_prefixes_lose_no_pair_and_links_keep_all_clusters(spark):
    docs = spark.createDataFrame(MIXED, "doc_id long, text string")
    class_of = {r["doc_id"]: r["first"] for r in similarity.classes(docs).collect()}
    vectors = {}
    for r in similarity.weights(docs).collect():
        vectors.setdefault(r["doc_id"], {})[r["term"]] = r["w"]
    firsts = sorted(set(class_of.values()))
    exact = {(a, b): c for k, a in enumerate(firsts) for b in firsts[k + 1 :] if (c := sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items())) >= similarity.COSINE - similarity.SLACK}
    rows = similarity.cosine_pairs(docs).collect()
    assert {(r["a"], r["b"]): pytest.approx(r["cosine"]) for r in rows} == exact and len(rows) == len(exact) > 100
    links = similarity.cosine_links(docs)
    assert {(r["a"], r["b"]) for r in links.collect()} < set(exact)
    pairs = spark.createDataFrame(list(exact), "a long, b long")
    assert {tuple(r) for r in similarity.clusters(links).collect()} == {tuple(r) for r in similarity.clusters(pairs).collect()}


SHUFFLES = """
import os, sys, time
from pyspark.sql import SparkSession
from textloom.operators import similarity
from textloom.sources import tables

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.local.dir", sys.argv[1]).config("spark.checkpoint.dir", "file://" + sys.argv[1] + "/shared").config("spark.sql.shuffle.partitions", "4").getOrCreate()
files = lambda: sum(f.startswith("shuffle_") for _, _, names in os.walk(sys.argv[1]) for f in names)
tables.written(spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count(), "sums")
for _ in range(40):
    if files():
        time.sleep(0.25)
print("left", files())
"""


def test_a_written_table_leaves_no_shuffle(tmp_path):
    """What a query has shuffled goes as it ends, not when the driver's JVM collects its plan."""
    run = subprocess.run([sys.executable, "-c", SHUFFLES, str(tmp_path)], capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(Path(__file__).parents[1])})
    assert run.stdout.split()[-2:] == ["left", "0"], run.stdout + run.stderr[-1000:]


def test_blocks_meet_in_rounds_and_lose_no_pair(spark, monkeypatch):
    """A shuffle of prefixes is at most AT_ONCE and one times as large as they are, however many blocks there are."""
    docs = spark.createDataFrame(MIXED, "doc_id long, text string")
    whole = {tuple(r) for r in similarity.cosine_pairs(docs).select("a", "b").collect()}
    monkeypatch.setattr(similarity, "BLOCK_TERMS", 150)
    monkeypatch.setattr(similarity, "AT_ONCE", 3)
    written, most, prefixes = similarity.written, [], []

    def counted(df, name):
        before = shuffled(spark)
        out = written(df, name)
        if name == "similarity-prefixes":
            prefixes.append(out.count())
        if name == "similarity-candidates" and not df.columns[2:]:
            most.append(shuffled(spark) - before)
        return out

    monkeypatch.setattr(similarity, "written", counted)
    assert {tuple(r) for r in similarity.cosine_pairs(docs).select("a", "b").collect()} == whole
    assert len(most) > 2 and 0 < max(most) <= 4 * prefixes[0], (most, prefixes)


def test_a_chunk_sends_its_terms_in_a_row_for_each_bucket(spark, docs):
    for make in (similarity.weights, similarity.doc_freq):
        _, n = of(spark, lambda make=make: make(docs))
        assert n < 2 * len(DOCS), n


def test_texts_that_share_a_doc_id_have_one_result_in_any_order(spark):
    rows = [(1, "alpha beta gamma"), (1, "delta epsilon zeta"), (2, "alpha beta gamma gamma"), (3, "delta epsilon zeta zeta"), (4, "alpha beta gamma"), *[(9 + i, f"other{i} words{i}") for i in range(20)]]
    found = [{tuple(r) for r in similarity.cosine_pairs(spark.createDataFrame(x, "doc_id long, text string").coalesce(1)).select("a", "b").collect()} for x in (rows, rows[::-1])]
    assert found[0] == found[1] and found[0]
