import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from textloom.llm import mixing, near, registry, suffixdedup, toxicity
from textloom.llm._util import stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stash(stage(spark, docs, small), name)
        out[name] = (before, docs)
        if name != "packing":
            assert docs.columns == COLUMNS
    before, after = out["toxicity"]
    bad = {r["doc_id"] for r in toxicity.classify(before, spark.read.parquet(f"{small}/labels.parquet")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - bad
    before, after = out["near_dedup"]
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(r["doc_id"] for r in near.group(before).where("kept").collect())
    before, after = out["suffix_dedup"]
    texts = {r["doc_id"]: r["text"].encode() for r in before.collect()}
    size, words = suffixdedup.PASSAGE_BYTES, suffixdedup.PASSAGE_WORDS
    seen = Counter(t[i : i + size] for t in texts.values() for i in range(len(t) - size + 1))
    cut = 0
    for r in after.collect():
        t = texts[r["doc_id"]]
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        for m in re.finditer(b"\1+", bytes(gone)):
            whole = [w for w in re.finditer(rb"[^\x20\x09-\x0D]+", t) if m.start() <= w.start() and w.end() <= m.end()]
            if len(whole) < words:
                gone[m.start() : m.end()] = bytes(m.end() - m.start())
        cut += any(gone)
        assert r["text"] == bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore") and r["n_chars"] == len(r["text"])
    assert cut > 3
    before, after = out["mixing"]
    want = {r["doc_id"]: r["copies"] if r["size"] else 1 for r in mixing.mix(before).collect() if r["copies"] or not r["size"]}
    assert Counter(r["doc_id"] for r in after.collect()) == want
    assert set(out["packing"][1].columns) >= {"doc_id", "piece", "sequence_id", "offset"}


def test_stages_take_anything(spark, corpus, nothing, small):
    docs = corpus.select(*COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stash(stage(spark, docs, small), name)
        there, kept = ({(r["doc_id"], r["text"]) for r in x.collect()} if name != "packing" else {r["doc_id"] for r in x.collect()} for x in (before, docs))
        if name in ("toxicity", "near_dedup", "mixing"):
            assert kept <= there and kept
        elif name == "suffix_dedup":
            assert Counter(r["doc_id"] for r in docs.collect()) == Counter(r["doc_id"] for r in before.collect())
        else:
            assert kept == there
    docs = nothing.select(*COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, small), name)
        assert docs.isEmpty()


def test_registered(spark):
    names = driver.queries()
    assert {int(n[2:].split("_")[0]) for n in registry.queries()} == set(range(1, 11)) and set(registry.queries()) <= set(names)
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = registry.queries()[name](spark, small)
    found = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    rows = lambda rs, get: Counter(repr([get(r, c) for c in sorted(columns)]) for r in rs)
    assert rows(df.collect(), lambda r, c: r[c]) == rows(found.fetchall(), lambda r, c: r[columns.index(c)])
