import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import generate, review, similarity

SMALL = {"ambiguous": 3, "canonical": 6, "duplicate": 6, "pii": 12, "multilingual": 4, "error": 7}


@pytest.fixture(scope="module")
def rows(spark):
    made = generate.tickets(spark, 300, 9, SMALL)
    return spark.createDataFrame(made.collect(), made.schema).coalesce(1)


def test_planted_tickets(spark, rows):
    got = {r["name"]: r["n"] for r in generate.manifest(rows).collect()}
    assert {k: got[f"kind {k}"] for k in SMALL} == SMALL and sum(n for k, n in got.items() if k.startswith("class ")) == 300
    checks = generate.checks(rows, 300, SMALL).collect()
    assert len(checks) == 24 and all(r["ok"] for r in checks), [r for r in checks if not r["ok"]]
    found = rows.where("kind = 'pii'").select(T.pii_spans(F.col("body")).alias("found"), "spans").collect()
    assert all([tuple(s) for s in r["found"]] == [tuple(s) for s in r["spans"]] for r in found)
    assert {s["type"] for r in found for s in r["spans"]} == {"email", "phone", "card"} and {len(r["spans"]) for r in found} == {1, 2}
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, generate.tickets(spark, 300, 9, SMALL).repartition(7).collect()), key=str)


def test_checks_find_what_is_wrong(rows):
    wrong = {
        "errors are wrong": rows.withColumn("vendor", F.col("truth")), "no other errors": rows.withColumn("vendor", F.lit("x")), "alternates differ": rows.withColumn("alternate", F.col("truth")),
        "spans are on the spot": rows.withColumn("body", F.concat(F.lit("x"), "body")), "no other mixed scripts": rows.withColumn("body", F.lit(generate.ARABIC[0])), "size": rows.where("doc_id > 0"),
        "pairs have two members": rows.where("kind IS NULL OR kind <> 'duplicate'"), "pairs are near duplicates": rows.withColumn("body", F.when(F.col("kind") == "duplicate", "something else").otherwise(F.col("body"))).withColumn("subject", F.col("body"))}
    for name, bad in wrong.items():
        assert not {r["name"]: r["ok"] for r in generate.checks(bad, 300, SMALL).collect()}[name], name


def test_scripts_take_turns(rows):
    body = rows.where("kind = 'multilingual'").first()["body"]
    places = [body.index(a) for a in generate.ARABIC]
    assert places[0] == 0 and places == sorted(places) and body.endswith(generate.ARABIC[2]) and places[1] > len(generate.ARABIC[0]) + 10


def test_at_most_two_swaps(spark):
    text = "question and question: slow, charged, slow"
    assert spark.range(1).select(generate.swapped(F.lit(text)).alias("t")).first()["t"] == "question and question: sluggish, billed, slow"


def test_copies_are_alike(spark):
    pairs = generate.copies(spark, 300, 9, SMALL).collect()
    norm = lambda t: "".join(c if c.isalnum() or c.isspace() else " " for c in t.lower())
    assert len(pairs) == 6 and all(similarity.token_set_ratio(norm(p["body"]), norm(p["original"])) > 75 for p in pairs)


def test_review(spark):
    views = spark.createDataFrame([(1, "a", "b", "v"), (2, "a", "b", "v")], "doc_id long, a_label string, b_label string, vendor string")
    answers = spark.createDataFrame([(1, 1, "accept_vendor", None, 1.234), (2, 2, "skip", None, 1.0), (2, 3, "other_leaf", None, 1.0), (2, 4, "nonsense", None, 1.0)], "doc_id long, ordinal long, decision string, leaf string, seconds double")
    log = review.adjudicate(answers, views)
    assert sorted(tuple(r) for r in log.collect()) == [(1, 1, "accept_vendor", "v", 1.23), (2, 2, "skip", None, 1.0)]
    assert [r["doc_id"] for r in review.pending(views, log).collect()] == [2]
    assert review.undo(log, log.where("doc_id = 1")).count() == 1
    assert review.unconfirmed(log.withColumn("confirmed", F.lit(None).cast("boolean")), 1.1).count() == 1


def test_repair():
    problems = lambda x: ["small"] if x < 2 else []
    assert review.repaired(0, problems, lambda x, _: x + 1) == (2, 2)
    with pytest.raises(ValueError, match="1 problems left"):
        review.repaired(-9, problems, lambda x, _: x + 1)
