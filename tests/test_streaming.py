from pyspark.sql import functions as F

from textloom.plans import demo
from textloom.streaming import rowwise


def test_stream_equals_batch(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        rowwise.write(rowwise.scrubbed(stream), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = rowwise.scrubbed(docs)
    key = lambda df: sorted((r["doc_id"], r["text"], r["n_spans"]) for r in df.collect())
    assert key(got) == key(want) and want.where("n_spans > 0").count() > 0


def test_stream_of_labels(spark, small, tmp_path):
    docs = demo.tickets(spark, small)
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    rowwise.write(rowwise.labeled(stream, demo.WEIGHTS, demo.LEAVES, ()), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in got) == docs.count() and len(got) == 4
