import pytest
from pyspark.sql import functions as F

from textloom.sources import config, tables


def test_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, tables.without(old, new, ["k"]).collect())) == [(1, "a")]
    assert tables.keep_last(old.union(new), ["k"], F.col("v")).where("k = 2").first()["v"] == "c"


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("t1", "skip", None), ("t2", "accept_llm", "é")], "ticket_id string, decision string, final_label string")
    tables.write_json_lines(rows, path, files=1)
    tables.write_json_lines(rows, path, mode="append")
    got = tables.read_json_lines(spark, path, "ticket_id string, decision string, final_label string", F.col("decision") == "skip")
    assert [r["final_label"] for r in got.collect()] == ["é", "é"] and tables.count_lines(spark, path) == 4


def test_labels_are_pruned(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "t", "a", "x", 0.5, None, False), ("r2", "t", "b", "y", 0.5, None, False)], tables.SCHEMAS["labels"])
    tables.write_labels(rows, str(tmp_path / "labels"))
    tables.write_labels(rows.where("source = 'b'"), str(tmp_path / "labels"))  # again: in place of its own rows
    got = tables.labels_of(spark, str(tmp_path / "labels"), "b", "r2")
    assert [r["label"] for r in got.collect()] == ["y"]
    assert "PartitionFilters" in got._jdf.queryExecution().toString()


def test_documents(spark):
    df = spark.createDataFrame([(2, 0.5)], "n long, a double")
    assert tables.metrics_document(df) == '{\n  "a": 0.5,\n  "n": 2\n}'
    assert "| 2 | 0.5000 |" in tables.markdown("t", {"x": df})


@pytest.mark.parametrize("value", [{}, {"a": 1, "b": [1, "x: y", None], "c": {"d": True, "e": []}}, {"leaves": [{"name": "n", "parts": ["p", "q"]}, {"name": "m", "parts": []}]}, ["a", 1.5, "true"], {"q": "it's \"so\"", "u": "é\n"}])
def test_yaml_round_trip(value):
    assert config.loads(config.dumps(value)) == value


def test_lock(tmp_path):
    path = tmp_path / "t.yaml"
    with pytest.raises(config.Drift):
        config.check_lock(path, {})
    path.write_text("a: 1\n")
    locks = config.lock(path, {})
    config.check_lock(path, locks)
    path.write_text("a: 2\n")
    with pytest.raises(config.Drift):
        config.check_lock(path, locks)
    path.unlink()
    with pytest.raises(config.Drift):
        config.check_lock(path, locks)
