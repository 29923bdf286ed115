import math

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import agreement, evaluate, export, improve, labeling, ledger, quality, ranking, similarity, taxonomy
from textloom.operators.ranking import global_rank


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize(("pairs", "want"), [([("x", "x"), ("y", "y")], 1.0), ([("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")], 0.0), ([("x", "x")] * 3, None), ([], None)])
def test_kappa(spark, pairs, want):
    got = one(agreement.kappas(spark.createDataFrame(pairs, "a string, b string"), (("a", "b"),)))
    assert got["kappa"] == want and got["n"] == len(pairs)


def test_label_by_brute_force(spark):
    taxonomy_ = [
        {"name": "net", "definition": "router modem cable", "inclusion_criteria": ["slow router"], "boundary_examples": ["modem light"], "exclusion_criteria": ["invoice"]},
        {"name": "pay", "definition": "invoice refund card", "inclusion_criteria": ["refund late"], "boundary_examples": ["card declined"], "exclusion_criteria": ["router"]},
    ]
    weights = labeling.leaf_terms(taxonomy_)
    docs = [(1, "router", "my router is slow"), (2, "invoice", "refund invoice invoice"), (3, "", "hello"), (4, None, None), (5, "router router invoice", "")]
    got = {r["doc_id"]: r for r in labeling.label(spark.createDataFrame(docs, "doc_id long, subject string, body string"), weights, ["net", "pay"]).collect()}
    w = {(leaf, t): x for leaf, t, x in weights}
    for i, subject, body in docs:
        bag = [(t, 2) for t in set((subject or "").split())] + [(t, 1) for t in (body or "").split()]
        scores = {leaf: sum(n * w.get((leaf, t), 0) for t, n in bag) for leaf in ("net", "pay")}
        best = min(scores, key=lambda leaf: (-scores[leaf], leaf))
        assert (got[i]["label"], got[i]["score"]) == (best, scores[best])
    assert got[3]["margin"] == 0.0 and got[3]["label"] == "net"


def test_annotations(spark):
    rows = [(1, "en", 1.5, "a b  c", False), (2, "zz", 0.5, None, False), (3, "en", None, "x", True), (4, None, 0.2, "", None)]
    got = {r["doc_id"]: r for r in labeling.clean(spark.createDataFrame(rows, "doc_id long, label string, confidence double, rationale string, abstain boolean"), ["en"], 2).collect()}
    assert (got[1]["label"], got[1]["confidence"], got[1]["rationale"], got[1]["abstain"]) == ("en", 1.0, "a b", False)
    assert all(got[i]["label"] is None and got[i]["abstain"] for i in (2, 3, 4))
    filled = labeling.fill_missing(spark.range(1, 6).withColumnRenamed("id", "doc_id"), labeling.clean(spark.createDataFrame(rows, "doc_id long, label string, confidence double, rationale string, abstain boolean"), ["en"]))
    assert one(filled.where("doc_id = 5"))["abstain"]


ROWS = "doc_id long, leaves array<string>, a_label string, a_conf double, a_abstain boolean, b_label string"


def test_suspected_and_ambiguous(spark):
    rows = spark.createDataFrame([
        (1, ["en"], "fr", 0.7, False, "fr"), (2, ["en"], "fr", 0.89, False, "de"), (3, ["en"], "fr", 0.9, False, "de"), (4, ["en"], "en", 0.99, False, "fr"), (5, [], "fr", 0.99, False, "fr"),
        (6, ["en"], "fr", 0.99, False, None), (7, ["en"], None, 0.3, True, "fr"), (8, ["en"], "en", None, False, "en")], ROWS)
    assert [r["doc_id"] for r in quality.suspected(rows).orderBy("doc_id").collect()] == [1, 3]
    assert {r["doc_id"]: r["reasons"] for r in quality.ambiguous(rows).collect()} == {2: ["three_way_disagreement"], 3: ["three_way_disagreement"], 7: ["abstained"], 8: ["low_confidence"]}
    found = quality.route((quality.suspected(rows), "suspected_label_error"), (quality.ambiguous(rows), "ambiguity"))
    assert {r["doc_id"]: r["reason"] for r in found.collect()} == {1: "suspected_label_error", 2: "ambiguity", 3: "suspected_label_error", 7: "ambiguity", 8: "ambiguity"}


def test_contested(spark):
    members = spark.createDataFrame([(1, 1, "x", ["x"]), (1, 2, "x", ["x"]), (3, 3, "x", ["x"]), (3, 4, "y", ["y"]), (5, 5, "x", ["x"]), (5, 6, "x", ["z"]), (7, 7, "x", ["y"])], "component long, doc_id long, label string, leaves array<string>")
    assert sorted(r["component"] for r in quality.contested(members).collect()) == [3, 5]


def test_second_version(spark):
    docs = spark.createDataFrame([(i, "mail a@b.co" if i == 1 else "t") for i in range(1, 9)], "doc_id long, text string")
    v1 = spark.createDataFrame([(i, "en") for i in range(1, 9)], "doc_id long, label string")
    log = spark.createDataFrame([
        (1, "ambiguous_both", None, None), (2, "ambiguous_both", None, None), (3, "accept_vendor", "v", ["en", "fr"]), (4, "accept_vendor", "v", ["de"]), (5, "accept_vendor", "v", []), (6, "other_leaf", "es", None), (7, "accept_llm", "", None)],
        "doc_id long, decision string, final_label string, covered array<string>")
    other = spark.createDataFrame([(1, "fr"), (2, "en")], "doc_id long, other string")
    clusters = spark.createDataFrame([(1, 1), (2, 1), (8, 1)], "doc_id long, component long")
    v2 = improve.second_version(docs, v1, log, other, clusters)
    got = {r["doc_id"]: (r["label"], r["alt_label"], r["status"]) for r in v2.collect()}
    assert got == {1: ("en", "fr", "kept"), 2: ("en", None, "quarantined"), 3: ("en", None, "kept"), 4: ("de", None, "kept"), 5: ("en", None, "kept"), 6: ("es", None, "kept"), 7: ("en", None, "kept"), 8: ("en", None, "merged_duplicate")}
    assert sorted((r["doc_id"], r["field"]) for r in improve.difference(v2).collect()) == [(1, "alt_label"), (1, "body"), (2, "status"), (4, "label"), (6, "label"), (8, "status")]
    latest = improve.latest_adjudications(spark.createDataFrame([(1, 0, "accept_llm"), (1, 1, "skip"), (2, 2, "skip"), (3, 3, "a"), (3, 4, "b")], "doc_id long, ordinal long, decision string"))
    assert sorted((r["doc_id"], r["decision"]) for r in latest.collect()) == [(1, "accept_llm"), (3, "b")]


def test_split_and_leaks(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a") for i in range(1)] + [(i, "b") for i in range(10, 12)] + [(i, "c") for i in range(20, 30)], "doc_id long, label string")
    train = {r["label"]: r["n"] for r in export.split(rows).where("split = 'train'").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert train == {"a": 1, "b": 2, "c": 8}
    bad = export.split(rows).withColumn("body", F.lit("x@y.org"))
    with pytest.raises(export.Leak):
        export.write(bad, str(tmp_path))
    export.write(bad.withColumn("body", F.lit("fine")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "train")).count() == 11


@pytest.mark.parametrize(("n", "want"), [(19, 1.0), (20, 0.5), (100, 3.0)])
def test_fast_floor(spark, n, want):
    rows = spark.createDataFrame([("d", float(i) + (0.0 if n == 20 else 5.0)) for i in range(n)], "decision string, seconds double")
    assert one(ledger.fast_floor(rows, ["decision"], "seconds"))["floor"] == want


def test_fast_runs(spark):
    seconds = [(1, "x", 0.5), (2, "x", 0.5), (3, "x", 0.5), (4, "y", 0.5), (5, "y", 0.5), (6, "y", 2.0), (7, "y", 0.5), (8, "y", 0.5), (9, "y", 0.5), (10, "y", 0.5), (11, "y", 0.5)]
    rows = spark.createDataFrame([("r", *s) for s in seconds], "who string, n long, decision string, s double")
    assert sorted((r["first"], r["last"], r["length"]) for r in ledger.fast_runs(rows, "who", "n", "decision", "s").collect()) == [(1, 3, 3), (7, 11, 5)]
    assert one(ledger.upper_median(rows, ["who"], "n"))["upper_median"] == 6


def test_gates(spark):
    got = {r["name"]: r["result"] for r in evaluate.gates(spark.createDataFrame([("leaks", 0.0), ("seeded_recall", 0.8), ("delta_points", None), ("other", 1.0)], "name string, value double")).collect()}
    assert got == {"leaks": "pass", "seeded_recall": "FAIL", "delta_points": "not evaluable"}


def test_planting(spark):
    docs = spark.range(50).withColumnRenamed("id", "doc_id")
    planted = taxonomy.plant(docs, {"a": 3, "b": 5}, 1)
    assert {r["kind"]: r["count"] for r in planted.groupBy("kind").count().collect()} == {"a": 3, "b": 5}
    assert all(r["ok"] for r in taxonomy.planting_checks(planted, {"a": 3, "b": 5}).collect())


@pytest.mark.parametrize(("a", "b"), [("", "x"), ("a b", "b a"), ("a b c", "a b"), ("kitten sits here", "kitten sat there"), ("x y", "z w"), ("same", "same")])
def test_token_set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    got = similarity.token_set_ratio(a, b)
    if not x or not y:
        assert got == 0
        return
    if x & y and (not x - y or not y - x):
        assert got == 100
        return

    def lcs(p, q):
        t = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, c in enumerate(p):
            for j, d in enumerate(q):
                t[i + 1][j + 1] = t[i][j] + 1 if c == d else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    def ratio(p, q):
        return 100 * 2 * lcs(p, q) / (len(p) + len(q)) if p or q else 100

    i = " ".join(sorted(x & y))
    p, q = (" ".join(filter(None, [i, " ".join(sorted(s))])) for s in (x - y, y - x))
    assert math.isclose(got, max(ratio(p, q), *([ratio(i, p), ratio(i, q)] if i else [0])), abs_tol=1e-9)


def test_cosine_pairs_match_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    w = similarity.weights(docs).select("doc_id", "term", "w").toPandas()
    vectors = {i: dict(zip(g["term"], g["w"], strict=True)) for i, g in w.groupby("doc_id")}
    want = set()
    ids = sorted(vectors)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = vectors[a], vectors[b]
            if sum(v * y.get(t, 0) for t, v in x.items()) >= 0.85 - 1e-9:
                want.add((a, b))
    first = {r["doc_id"]: r["first"] for r in similarity.classes(docs).collect()}
    got = {(r["a"], r["b"]) for r in similarity.cosine_pairs(docs).collect()}
    assert got == {(a, b) for a, b in want if first[a] == a and first[b] == b} and got
    # No link between documents is lost: a pair is of one class, or its classes are linked.
    assert all(first[a] == first[b] or tuple(sorted((first[a], first[b]))) in got for a, b in want)


def test_near_duplicates_by_brute_force(spark, small):
    """Every pair of documents by cosine and token-set ratio, against pairs of classes and the clusters that they make."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["t"] for r in docs.select("doc_id", T.normalize(F.col("text")).alias("t")).collect()}
    w = similarity.weights(docs).select("doc_id", "term", "w").toPandas()
    vectors = {i: dict(zip(g["term"], g["w"], strict=True)) for i, g in w.groupby("doc_id")}
    linked = set()
    for i, x in vectors.items():
        for j, y in vectors.items():
            if i < j and sum(v * y.get(t, 0) for t, v in x.items()) >= 0.85 - 1e-9 and similarity.token_set_ratio(texts[i], texts[j]) >= 90 - 1e-9:
                linked.add((i, j))
    members = similarity.classes(docs)
    first = {r["doc_id"]: r["first"] for r in members.collect()}
    pairs = similarity.near_duplicates(docs, members=members)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(a, b) for a, b in linked if first[a] == a and first[b] == b}
    top = {i: i for i in vectors}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            least = min(top[a], top[b])
            changed |= top[a] != least or top[b] != least
            top[a] = top[b] = least
    ends = {i for p in linked for i in p}
    assert {r["doc_id"]: r["component"] for r in similarity.document_clusters(pairs, members).collect()} == {i: top[i] for i in ends} and ends


def test_clusters(spark):
    pairs = spark.createDataFrame([(3, 2), (2, 1), (5, 9), (9, 10)], "a long, b long")
    assert {r["doc_id"]: r["component"] for r in similarity.clusters(pairs).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 9: 5, 10: 5}
    assert similarity.clusters(pairs.where("a < 0")).collect() == []


def test_clusters_of_classes(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "Alpha, beta gamma!"), (3, "alpha beta gamma"), (4, "of no kin here"), (5, "an"), (6, "an"), (7, None), (8, "of no kin here now")], "doc_id long, text string")
    members = similarity.classes(docs)
    assert {r["doc_id"]: (r["first"], r["n"]) for r in members.collect()} == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1), 8: (8, 1)}
    pairs = spark.createDataFrame([(1, 4)], "a long, b long")
    assert {r["doc_id"]: r["component"] for r in similarity.document_clusters(pairs, members).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert {r["doc_id"]: r["component"] for r in similarity.document_clusters(pairs.where("a < 0"), members).collect()} == {1: 1, 2: 1, 3: 1}


def test_hot_text_makes_no_pairs(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'one very common text here' ELSE concat('word', id, ' other', id, ' third', id) END AS text")
    members = similarity.classes(docs)
    pairs = similarity.cosine_pairs(docs, members=members)
    assert pairs.count() == 0 and similarity.document_clusters(pairs, members).groupBy("component").count().collect() == [(0, 1000)]


def test_rank_within(spark):
    rows = spark.createDataFrame([(k, (i * 7) % 13, i) for k in ("a", "b", None) for i in range(20)], "k string, x int, i int")
    got = {(r["k"], r["i"]): r["n"] for r in ranking.rank_within(rows, ["k"], [F.desc("x"), F.asc("i")], "n").collect()}
    want = sorted(range(20), key=lambda i: (-((i * 7) % 13), i))
    assert got == {(k, i): n for k in ("a", "b", None) for n, i in enumerate(want, 1)}


def test_global_rank(spark):
    rows = spark.createDataFrame([(i, (i * 7) % 5) for i in range(40)], "doc_id long, x long")
    got = [(r["rank"], r["x"], r["doc_id"]) for r in global_rank(rows, [F.desc("x"), F.asc("doc_id")], "rank").orderBy("rank").collect()]
    assert [g[0] for g in got] == list(range(1, 41)) and [g[1:] for g in got] == sorted((g[1:] for g in got), key=lambda g: (-g[0], g[1]))


def test_no_rows(spark):
    empty = spark.createDataFrame([], ROWS)
    assert quality.suspected(empty).count() == 0 and quality.ambiguous(empty).count() == 0
    assert one(agreement.compatibility(empty, "a_label", "leaves"))["rate"] is None
    assert one(evaluate.accuracy(empty, "x", F.lit(True)))["value"] == 0.0
    assert T.STOPWORDS
