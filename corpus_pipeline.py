"""Corpus pipeline: the stages that turn raw documents into packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's docs. All but the last return the columns
of documents. In every stage a null text counts as empty, and keeps so; texts
of any length are read whole; an empty table gives an empty table; columns
other than those of documents are not read, whatever their names; rows without
a doc_id, and rows that share one, are judged each for itself unless a stage
says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import mixing, near, packing, suffixdedup, toxicity
from textloom.llm._util import stash
from textloom.operators.ranking import global_rank

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from this input's labelled rows, does not find toxic.

    Rows that repeat share their score, so all go or all stay; a score of
    exactly TOXIC_FROM goes. Without labels every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~toxicity.held_out())
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model, COLUMNS).where(F.col("score") < toxicity.TOXIC_FROM).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest doc_id, and of its texts the first.

    Of rows that share doc_id and text one stays, that of the least other
    columns; where a doc_id stands on unlike texts, each of them is compared. A
    row without a doc_id stays, as does an empty text, which is linked with
    nothing.
    """
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = near.group(docs).where("kept").select(F.col("doc_id").alias("_id"))
        return docs.join(stash(kept, "pipeline-kept"), docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi").select(*COLUMNS)
    # Every doc_id and text by a number in their order.
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    named = docs.where("doc_id IS NOT NULL").withColumn("_key", key)
    numbers = stash(global_rank(named.select("doc_id", "_key").distinct(), [F.asc("doc_id"), F.asc("_key")], "_n").withColumn("_n", F.col("_n").cast("long")), "pipeline-numbers")
    named = named.join(numbers, ["doc_id", "_key"])
    kept = near.group(named.select(F.col("_n").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("_n")).distinct()
    one = named.join(stash(kept, "pipeline-kept"), "_n", "left_semi").groupBy("_n", "doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("m"))
    return one.select("doc_id", "m.*").unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without passages of over 50 words that occur elsewhere; characters that are cut through go as well.

    Every place of a passage is cut, also of those in one document and in rows
    that repeat; no row goes, though its text may become empty. Nothing depends
    on an order, so ties need no rule.
    """
    rows = suffixdedup.dedup(docs, suffixdedup.PASSAGE_BYTES, keep=("text", "lang", "source", "n_chars"), texts=True, least_words=suffixdedup.PASSAGE_WORDS)
    cut = F.col("n_removed") > 0
    return rows.select("doc_id", F.when(cut, F.col("kept")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(cut, F.length("kept")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to three times; those without words stay once, as they weigh nothing.

    Which documents of a length are taken follows a seeded hash of doc_id and
    text; of rows that are equal in both it makes no difference which.
    """
    rows = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences; rows that repeat are packed each for itself.

    Pieces of equal length are interchangeable; which goes where follows a hash.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the learnt stage nor the suffix sort's byte-wise cuts; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
