import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.__main__ import main
from textloom.functions import text as T
from textloom.operators import export, generate, induction, model, review
from textloom.plans.loop import Loop
from textloom.sources import tables
from textloom.sources.store import Store

LEAVES = {
    "access": "password refused attempts shut sign locked", "billing": "statement ordered invoice offer percent charged total", "delivery": "courier promised nobody neighbour streets signed arrived address",
    "hardware": "lamp blinks dark hums louder switch noise", "network": "link office file connection uploads drops loses", "other": "explain counts holidays darker screen question wish"}


def tree():
    leaf = lambda k, v: {"name": k, "definition": v, "inclusion_criteria": v.split()[:2], "exclusion_criteria": ["unrelated matters"], "boundary_examples": v.split()[2:4]}
    names = list(LEAVES)
    return {"domains": [{"name": "one", "description": "first", "leaves": [leaf(k, LEAVES[k]) for k in names[:3]]}, {"name": "two", "leaves": [leaf(k, LEAVES[k]) for k in names[3:]]}], "rationale": "by what is broken"}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    (at / "taxonomy.json").write_text(json.dumps(tree()))
    (at / "alignment.json").write_text(json.dumps({k: [k] for k in LEAVES}))
    return at


def test_loop_by_its_command_line(spark, files, tmp_path):
    root, call = str(tmp_path / "store"), lambda *a: main(["--root", str(tmp_path / "store"), *a], spark)
    loop = Loop(Store(spark, root))
    assert "generate: not run" in loop.status() and call("report") == 1
    with pytest.raises(SystemExit):
        call("nothing")
    assert call("run-all", "--count", "300", "--taxonomy", str(files / "taxonomy.json"), "--alignment", str(files / "alignment.json")) == 0
    assert "qa-" in loop.status() and "improve: not run" in loop.status() and "intact" in loop.status()
    tickets, truth = loop.store.read("tickets"), loop.store.read("truth")
    assert "truth" not in tickets.columns and tickets.count() == 300
    views = loop.views().join(truth.select("doc_id", "truth"), "doc_id").collect()
    assert sum(r["b_label"] == r["truth"] for r in views) > 240
    flags = loop.store.read("flags").collect()
    assert {f["flag_type"] for f in flags} >= {"duplicate", "pii"} and all(json.loads(f["detail"]) for f in flags)
    queue = loop.store.read("queue").orderBy("place").collect()
    assert [r["place"] for r in queue] == list(range(1, len(queue) + 1)) and {r["doc_id"] for r in queue} == {f["doc_id"] for f in flags if f["routed"]}
    screens = loop.screens().collect()
    assert len(screens) == len(queue) and all(s["subject"] and s["b_label"] and s["flags"] for s in screens)
    answers = tmp_path / "answers.json"
    answers.write_text("\n".join(json.dumps({"doc_id": r["doc_id"], "decision": "accept_heuristic", "seconds": 2.5}) for r in queue[:5]))
    assert call("review", "--answers", str(answers)) == 0 and call("review", "--answers", str(answers)) == 0
    assert len(loop.screens().collect()) == len(queue) - 5
    assert review.progress(loop.store.read("log")).first().asDict() == {"decisions": 10, "documents": 5, "last": 10}
    assert call("improve") == 0
    code = call("evaluate")
    found = json.loads(loop.store.meta("results"))
    assert code == int(any(g[3] == "FAIL" for g in found["gates"])) and found["leaks"] == 0 and found["pii"]["recall"] == 1.0 and len(found["gates"]) == 5
    assert call("report") == 0 and "## Gates" in loop.store.meta("report") and "accept_heuristic" in loop.store.meta("report")
    assert call("export", "--to", str(tmp_path / "out")) == 0
    train = spark.read.json(str(tmp_path / "out" / "train"))
    kept = loop.store.read("dataset_v2").where("status = 'kept' AND label IS NOT NULL").count()
    assert train.count() + spark.read.json(str(tmp_path / "out" / "eval")).count() == kept and {"customer_tier", "channel", "label", "subject"} <= set(train.columns)
    assert f"{kept} of them exported" in loop.store.meta("datasheet")
    (files / "taxonomy.json").write_text(json.dumps(tree() | {"rationale": "changed"}))
    assert call("label") == 2 and "has changed" in loop.status()
    assert call("induce", "--relock", "--taxonomy", str(files / "taxonomy.json"), "--alignment", str(files / "alignment.json")) == 0 and "intact" in loop.status()
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"domains": tree()["domains"][:1]}))
    assert call("induce", "--taxonomy", str(bad), "--alignment", str(files / "alignment.json")) == 1 and "domain count" in loop.store.meta("induction")


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("costs").count() == 0 and store.meta("x") is None and store.spent() == 0
    first, second = store.start("label", "m"), store.start("label", "m")
    store.finish(first, note="fine")
    cost = spark.createDataFrame([("c1", "small", 10, 5, 0.25)], "call_id string, model string, tokens_in long, tokens_out long, usd double").withColumn("ts", F.current_timestamp())
    store.record_costs(first, cost)
    store.record_costs(first, cost)  # the same call again
    runs = {r["run_id"]: r for r in store.runs().collect()}
    assert (runs[first]["status"], runs[first]["cost_usd"], runs[first]["note"], runs[first]["model"]) == ("ok", 0.25, "fine", "m")
    assert runs[second]["status"] == "running" and runs[second]["finished_at"] is None and store.spent() == 0.25
    store.set_meta("x", "1"), store.set_meta("x", "2")
    assert store.meta("x") == "2"
    labels = lambda run, value: spark.createDataFrame([(run, 1, value, 0.5, None, False, "a")], "run_id string, doc_id long, label string, confidence double, rationale string, abstain boolean, source string")
    store.write_labels(labels(first, "old")), store.write_labels(labels(first, "new")), store.write_labels(labels(second, "unfinished"))
    assert [r["label"] for r in store.latest_labels("a").collect()] == ["new"]
    store.finish(second, "failed")
    assert [r["label"] for r in store.latest_labels("a").collect()] == ["new"]
    third = store.start("label")
    store.write_labels(labels(third, "last"))
    store.finish(third)
    assert [r["label"] for r in store.latest_labels("a").collect()] == ["last"] and store.read("labels").count() == 3


def test_settings():
    assert model.Settings.read({}) == model.Settings()
    assert model.Settings.read({"TEXTLOOM_MODEL": " big ", "TEXTLOOM_COST_CAP": "x"}) == model.Settings(model="big")
    assert model.Settings.read({"TEXTLOOM_COST_CAP": "7.5", "TEXTLOOM_INDUCTION_MODEL": "q"}) == model.Settings(induction_model="q", cost_cap=7.5)


def test_prices(spark):
    rows = spark.createDataFrame([("small-2", 1_000_000, 1_000_000, 0, 0), ("large", 2_000_000, 0, 1_000_000, 1_000_000), ("unknown", 0, 1_000_000, 0, 0)], "m string, i long, o long, w long, r long")
    got = [round(r[0], 9) for r in rows.select(model.usd(F.col("m"), F.col("i"), F.col("o"), F.col("w"), F.col("r"))).collect()]
    assert got == [6.0, 10 + 6.25 + 0.5, 5.0]


def test_calls_are_capped_and_kept(spark):
    calls = spark.createDataFrame([("1", "small", "s", "one"), ("2", "small", "s", "one"), ("3", "small", "s", "two")], "call_id string, model string, system string, user string")
    cache = spark.createDataFrame([], tables.SCHEMAS["cache"])

    def answer(parts):
        for part in parts:
            yield pd.DataFrame({"cache_key": part["cache_key"], "response": part["user"].str.upper(), "tokens_in": 10, "tokens_out": 5})

    answers, kept, costs = model.complete(calls, cache, answer, 0.0, model.Settings())
    assert {r["call_id"]: (r["response"], r["new"]) for r in answers.collect()} == {"1": ("ONE", True), "2": ("ONE", True), "3": ("TWO", True)}
    assert costs.count() == 2 and kept.count() == 2
    answers, _, costs = model.complete(calls, kept, lambda parts: (_ for _ in ()), 2.9, model.Settings())
    assert costs.count() == 0 and {r["response"] for r in answers.where("NOT new").collect()} == {"ONE", "TWO"}
    with pytest.raises(model.CapExceeded):
        model.complete(calls, cache, answer, 2.999, model.Settings())
    keys = calls.select(model.call_key(F.col("model"), F.col("system"), F.col("user"))).collect()
    assert keys[0] == keys[1] != keys[2]


def test_induction(spark):
    rows = spark.createDataFrame([(i, f"s{i}", "b" * 500, "secret") for i in range(9)], "doc_id long, subject string, body string, vendor string")
    sample = induction.blind_sample(rows, 4, 3)
    assert sample.columns == ["doc_id", "subject", "body"] and sample.count() == 4 and len(sample.first()["body"]) == 420
    batched = rows.withColumn("batch", F.col("doc_id") + 1)
    assert [r["prompt"].count("Subject: ") for r in induction.prompts(batched, 4).orderBy("batch").collect()] == [4, 4, 1]
    one = spark.createDataFrame([(json.dumps(tree()),)], "j string").select(F.from_json("j", induction.TAXONOMY_ROW).alias("t")).select("t.*")
    got = one.select(induction.leaf_names().alias("n"), induction.taxonomy_block().alias("b")).first()
    assert got["n"] == list(LEAVES) and got["b"].startswith("## one: first\n\n### access\npassword refused") and "## two:\n" in got["b"] and got["b"].count("Include when:\n  - ") == 6
    assert spark.range(1).select(T.plain_dashes(F.lit("a \u2014 b\u2013c \u2013d"))).first()[0] == "a, b, c , d"
    mapped = spark.createDataFrame([("v1", [" x ", "nope"], "a \u2014 b", 1), ("v2", ["x"], None, 1), ("v2", ["y", "x"], None, 2)], "vendor string, leaves array<string>, reasoning string, ordinal int")
    vendors = spark.createDataFrame([("v1",), ("v2",), ("v3",), ("v3",)], "vendor string")
    assert {r["vendor"]: (r["leaves"], r["reasoning"]) for r in induction.alignment(vendors, mapped, ["x", "y"]).collect()} == {"v1": (["x"], "a, b"), "v2": (["y", "x"], ""), "v3": ([], "")}
    text = induction.rationale(tree(), {"n": 10, "unmappable": 1, "rate": 0.1}, [("access", 9)], 2)
    assert "by what is broken" in text and "| access | 9 |" in text and "10.0%" in text
    assert "- too few" in induction.failure(tree(), ["too few"], {"n": 10, "rate": 0.5})


def test_export_refuses_subjects(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", None, "fine", "train")], "doc_id long, label string, alt_label string, body string, split string")
    tickets = spark.createDataFrame([(1, "mail me@x.org", "email", "free", "2025")], "doc_id long, subject string, channel string, tier string, created_at string")
    assert export.records(rows, tickets).first()["subject"] == "mail [EMAIL_1]"
    with pytest.raises(export.Leak):
        export.write(rows.withColumn("subject", F.lit("me@x.org")), str(tmp_path))
    assert generate.shape_groups(spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("c",)], "subject string")).collect() == [("b", 2, 1), ("c", 2, 2)]
