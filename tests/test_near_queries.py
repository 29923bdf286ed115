"""Queries over near duplicates, on a small table of our own."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import evaluate, similarity
from textloom.plans import catalog, demo

BASE = [f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i} theta{i} kappa{i} lambda{i} sigma{i} omega{i} report{i}" for i in range(40)]


def rows_of(name, spark, folder):
    return catalog.queries()[name](spark, folder).collect()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents 0 to 39 differ; 100 + i is document i with one more character. None is an exact copy."""
    at = str(tmp_path_factory.mktemp("near"))
    docs = [(i, t, "en", "web", len(t)) for i, t in enumerate(BASE)] + [(100 + i, t + "s", "en" if i % 2 else "fr", "web", len(t) + 1) for i, t in enumerate(BASE)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at


def test_near_copies_are_merged_and_not_exported(spark, folder):
    v2 = {r["doc_id"]: r["status"] for r in rows_of("near_dataset_v2", spark, folder)}
    assert all(v2[100 + i] in ("merged_duplicate", "quarantined") and v2[i] != "merged_duplicate" for i in range(40))
    assert "merged_duplicate" in v2.values()
    split = {r["doc_id"] for r in rows_of("near_export_split", spark, folder)}
    assert split and not any(i >= 100 for i in split)
    changed = {r["doc_id"] for r in rows_of("near_v1_v2_diff", spark, folder) if r["after"] == "merged_duplicate"}
    merged = {i for i, s in v2.items() if s == "merged_duplicate"}
    assert changed == merged
    assert {r["reason"]: r["n"] for r in rows_of("near_export_exclusions", spark, folder)}["merged_duplicate"] == len(merged)
    assert {r["field"]: r["n"] for r in rows_of("near_diff_summary", spark, folder)}["status"] == sum(s != "kept" for s in v2.values())
    assert {r["name"]: r["n"] for r in rows_of("near_eval_accuracy", spark, folder)} == {"v1": 80, "vendor": 80, "v2": 80 - len(merged), "v1_same_rows": 80 - len(merged)}


def test_only_contested_clusters_are_routed(spark, folder):
    rows = {r["doc_id"]: r for r in demo.rows(spark, folder).collect()}
    clash = set()
    for i in range(40):
        pair = [rows[i], rows[100 + i]]
        labels = {r["a_label"] for r in pair if r["a_label"]}
        sides = {r["a_label"] not in r["leaves"] for r in pair if r["a_label"] and r["leaves"]}
        if len(labels) > 1 or len(sides) > 1:
            clash.add(i)
    assert 0 < len(clash) < 40
    routed = {r["doc_id"]: r["reason"] for r in rows_of("near_routing", spark, folder)}
    assert clash <= set(routed) and {i for i, r in routed.items() if r == "duplicate"} <= clash
    assert "duplicate" in routed.values()
    assert {r["reason"]: r["n"] for r in rows_of("near_routed_by_reason", spark, folder)} == {k: list(routed.values()).count(k) for k in set(routed.values())}
    assert rows_of("near_queue_ratio", spark, folder)[0]["routed"] == len(routed)
    assert {r["doc_id"] for r in rows_of("near_set_unflagged", spark, folder)} == set(rows) - set(routed)
    assert {r["doc_id"] for r in rows_of("near_review_queue_pending", spark, folder)} == {i for i in routed if i % 10}


def test_scores_of_clusters(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4), (3, 7), (3, 8)], "pair_id long, doc_id long")
    clusters = spark.createDataFrame([(1, 1), (2, 1), (9, 1), (3, 3), (10, 3), (5, 5), (6, 5), (7, 7), (8, 7), (11, 11), (12, 11)], "doc_id long, component long")
    shapes = spark.createDataFrame([(3, "x"), (10, "y"), (5, "z"), (6, "z"), (11, "z")], "doc_id long, shape string")
    got = evaluate.cluster_scores(pairs, clusters, shapes).first().asDict()
    assert got == {"pairs": 3, "found": 2, "recall": pytest.approx(2 / 3), "clusters": 5, "precision": pytest.approx(2 / 5), "unmatched": 3, "explained": 1}
    none = evaluate.cluster_scores(pairs, clusters.where("false"), shapes).first().asDict()
    assert (none["pairs"], none["recall"], none["clusters"], none["precision"], none["unmatched"], none["explained"]) == (3, 0.0, 0, 0.0, 0, 0)


def test_missed_copies_lower_the_recall(spark, folder, monkeypatch):
    got = rows_of("near_duplicate_recall", spark, folder)[0]
    assert got["pairs"] == 18 and 0 < got["found"] <= 18 and got["clusters"] >= 40 and got["unmatched"] >= 40 and got["explained"] < 40
    ratio = similarity.near_duplicates
    monkeypatch.setattr(similarity, "near_duplicates", lambda docs, **more: ratio(docs, **more).where("cosine > 0.999999"))
    worse = rows_of("near_duplicate_recall", spark, folder)[0]
    assert worse["pairs"] == 18 and worse["found"] < got["found"]


def test_tickets_are_generated_once(spark, folder, monkeypatch):
    """What is searched are tables as they are read, not the plan that makes the tickets."""
    clusters, seen = catalog.near_clusters, []
    monkeypatch.setattr(catalog, "near_clusters", lambda docs: seen.append(docs._jdf.queryExecution().optimizedPlan().toString()) or clusters(docs))
    rows_of("near_duplicate_recall", spark, folder)
    assert len(seen) == 1 and len(seen[0].splitlines()) < 12 and "Join" not in seen[0]


def test_gates_are_computed(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    leaking = spark.createDataFrame([(900, "call 555 123.a@x.org now"), (901, "write to me@x.org")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "cast(length(text) AS long) AS n_chars")
    docs.unionByName(leaking).write.parquet(f"{tmp_path}/documents.parquet")
    events = "event_id long, ts timestamp, user_id long, event_type string"
    spark.range(3000).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 7 AS user_id", "'view' AS event_type").to(spark.createDataFrame([], events).schema).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["name"]: r for r in rows_of("near_release_gates", spark, str(tmp_path))}
    assert set(got) == set(evaluate.GATES)
    assert (got["leaks"]["value"], got["leaks"]["result"]) == (1.0, "FAIL")
    usd = sum(i * 13 % 5000 + 5 * (i * 7 % 900) for i in range(3000)) / 1e6
    assert got["cost_usd"]["value"] == pytest.approx(usd) and got["cost_usd"]["result"] == ("pass" if usd <= 3 else "FAIL")
    value = {r["name"]: r["value"] for r in rows_of("near_eval_accuracy", spark, str(tmp_path))}
    assert got["delta_points"]["value"] == pytest.approx(100 * (value["v2"] - value["v1"]))
    assert got["duplicate_recall"]["value"] == rows_of("near_duplicate_recall", spark, str(tmp_path))[0]["recall"]
    assert got["seeded_recall"]["value"] == rows_of("seeded_error_recall", spark, str(tmp_path))[0]["recall"]


def test_flags_of_all_kinds(spark, folder, tmp_path):
    extra = [(900 + i, f"write to me{i}@x.org", ("es", "fr", "de", "en")[i % 4], "web", 9) for i in range(300)]
    docs = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long").unionByName(spark.read.parquet(f"{folder}/documents.parquet"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    flags = [r.asDict() for r in rows_of("near_flags", spark, str(tmp_path))]
    kinds = {k: {f["doc_id"] for f in flags if f["flag_type"] == k} for k in {f["flag_type"] for f in flags}}
    assert set(kinds) == {"suspected_label_error", "taxonomy_granularity", "duplicate", "pii", "ambiguity"}
    assert kinds["pii"] == {i for i, *_ in extra}
    assert set(range(40)) | set(range(100, 140)) <= kinds["duplicate"]
    proposed = {r["doc_id"]: r["a_label"] for r in demo.rows(spark, str(tmp_path)).collect()}
    assert all(proposed[i] == "es" for i in kinds["taxonomy_granularity"]) and all(proposed[i] != "es" for i in kinds["suspected_label_error"])
    reason = {r["doc_id"]: r["reason"] for r in rows_of("near_routing", spark, str(tmp_path))}
    assert all(f["routed"] == (reason.get(f["doc_id"]) == f["flag_type"]) for f in flags)
    assert sum(f["routed"] for f in flags) == len(reason)
    for kind in ("suspected_label_error", "taxonomy_granularity", "ambiguity"):
        assert sorted(f["rank"] for f in flags if f["flag_type"] == kind) == list(range(1, len(kinds[kind]) + 1))
    counts = {r["flag_type"]: (r["n"], r["routed"]) for r in rows_of("near_flag_counts", spark, str(tmp_path))}
    assert counts == {k: (len(v), sum(f["routed"] for f in flags if f["flag_type"] == k)) for k, v in kinds.items()}
    of = {r["doc_id"]: r["flags"] for r in rows_of("near_flags_of_document", spark, str(tmp_path))}
    assert of == {i: "|".join(sorted(k for k, v in kinds.items() if i in v)) for i in set().union(*kinds.values())}


def test_terms_are_all_there(spark, folder):
    """The fixture has far more than 100 terms, and 12 in each document."""
    terms = {r["term"]: r["df"] for r in rows_of("doc_freq_all", spark, folder)}
    assert len(terms) == 40 * 12 + 40 and terms["alpha0"] == 2 and terms["report0"] == terms["report0s"] == 1
    weights = rows_of("tfidf_weights", spark, folder)
    assert len(weights) == 80 * 12 and all(r["df"] == terms[r["term"]] for r in weights)
