"""The domain that the registered queries run on, derived from the tables at hand.

Documents are tickets; their language is the truth; hashes of doc_id make
vendor labels and two annotators that err. The same derivation in SQL is BASE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import labeling
from textloom.sources.tables import spread

LEAVES = ["de", "en", "es", "fr"]
ALIGNMENT = {"en": ["en"], "fr": "fr", "de": ["de", "es"], "es": None}
NEXT = {"en": "fr", "fr": "de", "de": "es", "es": "en"}
PLANTED = {"ambiguous": 30, "duplicate": 36, "pii": 25, "multilingual": 12, "error": 40}
TAXONOMY = [
    {"name": "de", "definition": "der die das und mit von ein ist", "inclusion_criteria": ["den dem des", "zu nicht auf"], "boundary_examples": ["als auch", "sich verein"], "exclusion_criteria": ["les des que"]},
    {"name": "en", "definition": "the and that this with for", "inclusion_criteria": ["was are from", "have not they"], "boundary_examples": ["which one", "than there"], "exclusion_criteria": ["der die das"]},
    {"name": "es", "definition": "los las que del por con para una", "inclusion_criteria": ["como esta", "sus sin"], "boundary_examples": ["pero mas", "ser son"], "exclusion_criteria": ["les des"]},
    {"name": "fr", "definition": "les des qui par pour dans elle que", "inclusion_criteria": ["sur une", "est pas"], "boundary_examples": ["avec plus", "leur ont"], "exclusion_criteria": ["los las del"]},
]
WEIGHTS = labeling.leaf_terms(TAXONOMY, ())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of documents, for work on whole texts."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def coded(salt: int) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}|"), F.col("doc_id").cast("string")))


def under(salt: int, hex_: str) -> Column:
    return F.substring(coded(salt), 1, 2) < hex_


def number(salt: int) -> Column:
    """A whole number from 0 to 65535."""
    return F.conv(F.substring(coded(salt), 1, 4), 16, 10).cast("int")


def following(label: Column) -> Column:
    return F.coalesce(*[F.when(label == k, v) for k, v in NEXT.items()])


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, truth, vendor, leaves, a_label, a_conf, a_abstain, b_label; reads two columns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("truth"))
    t = F.col("truth")
    docs = docs.withColumn("vendor", F.when(under(7, "1a"), following(t)).otherwise(t)).withColumn("a_abstain", under(13, "08"))
    return docs.select(
        "doc_id", "truth", "vendor", labeling.leaves_of(ALIGNMENT, F.col("vendor")).alias("leaves"),
        F.when(~F.col("a_abstain"), F.when(under(11, "18"), following(t)).otherwise(t)).alias("a_label"),
        ((400 + 6 * (number(17) % 101)) / 1000.0).alias("a_conf"), "a_abstain",
        F.when(under(19, "30"), following(following(t))).when(under(11, "10"), following(t)).otherwise(t).alias("b_label"))


def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five runs of each annotator from events: run_id, source, started_at, status; a run of every third number failed."""
    events = table(spark, sf_dir, "events").select("ts", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("source"), (F.col("user_id") % 5).alias("k"))
    runs_ = events.groupBy("source", "k").agg(F.min("ts").alias("started_at"))
    return runs_.select(F.concat("source", F.lit("-"), F.col("k").cast("string")).alias("run_id"), "source", "started_at", F.when(F.col("k") % 3 == 0, "failed").otherwise("ok").alias("status"))


def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of either annotator in three of its runs: doc_id, source, run_id, label."""
    base = rows(spark, sf_dir)
    either = base.select("doc_id", F.lit("a").alias("source"), F.col("a_label").alias("label")).unionByName(base.select("doc_id", F.lit("b").alias("source"), F.col("b_label").alias("label")))
    run = either.withColumn("k", F.explode(F.array(*[F.lit(i) for i in (0, 1, 2)])))
    return run.select("doc_id", "source", F.concat("source", F.lit("-"), ((F.col("k") + F.col("doc_id") % 2) % 5).cast("string")).alias("run_id"), "label")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.functions.text import first_line

    return documents(spark, sf_dir, "doc_id", "text", "source").select("doc_id", first_line(F.col("text")).alias("subject"), F.col("text").alias("body"), F.col("source").alias("channel"))


DECISIONS = ("accept_llm", "accept_vendor", "accept_heuristic", "ambiguous_both", "skip", "other_leaf")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two decisions on every document whose hash is low: doc_id, ordinal, decision, final_label, covered, seconds."""
    base = rows(spark, sf_dir).where(under(23, "40"))
    turns = base.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("x", F.when(F.col("turn") == 0, number(29)).otherwise(number(31)))
    decision = F.array(*map(F.lit, DECISIONS))[F.col("x") % len(DECISIONS)]
    final = F.when(F.col("d") == "accept_llm", F.col("a_label")).when(F.col("d") == "accept_vendor", F.col("vendor")).when(F.col("d") == "accept_heuristic", F.col("b_label")).when(F.col("d") == "other_leaf", F.col("truth"))
    return turns.withColumn("d", decision).select(
        "doc_id", (F.col("doc_id") * 2 + F.col("turn")).alias("ordinal"), F.col("d").alias("decision"), final.alias("final_label"), F.when(F.col("d") == "accept_vendor", F.col("leaves")).alias("covered"),
        ((F.col("x") % 400) / 100.0).alias("seconds"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs: a run for each user and event type."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.concat(F.col("event_type"), F.lit("-"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_type").alias("stage"), "ts",
        F.when(F.col("event_id") % 7 == 0, "failed").otherwise("ok").alias("status"), (F.col("event_id") * 13 % 5000).alias("tokens_in"), (F.col("event_id") * 7 % 900).alias("tokens_out"))


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as priced calls, in millionths of a dollar so that sums are exact."""
    return runs(spark, sf_dir).withColumn("usd", F.col("tokens_in") + 5 * F.col("tokens_out"))


_FOLLOW = "CASE {0} WHEN 'en' THEN 'fr' WHEN 'fr' THEN 'de' WHEN 'de' THEN 'es' WHEN 'es' THEN 'en' END"
_F1, _F2 = _FOLLOW.format("lang"), _FOLLOW.format("(" + _FOLLOW.format("lang") + ")")
_LOW = "substr(md5(concat('{0}|', doc_id)), 1, 2) < '{1}'"
_NUM = "CAST(concat('0x', substr(md5(concat('{0}|', doc_id)), 1, 4)) AS INTEGER)"
BASE = f"""
base0 AS (
  SELECT doc_id, lang AS truth, CASE WHEN {_LOW.format(7, '1a')} THEN {_F1} ELSE lang END AS vendor, {_LOW.format(13, '08')} AS a_abstain,
    CASE WHEN {_LOW.format(13, '08')} THEN NULL WHEN {_LOW.format(11, '18')} THEN {_F1} ELSE lang END AS a_label,
    (400 + 6 * ({_NUM.format(17)} % 101)) / 1000.0::DOUBLE AS a_conf,
    CASE WHEN {_LOW.format(19, '30')} THEN {_F2} WHEN {_LOW.format(11, '10')} THEN {_F1} ELSE lang END AS b_label
  FROM documents
), base AS (
  SELECT *, CASE vendor WHEN 'en' THEN ['en'] WHEN 'fr' THEN ['fr'] WHEN 'de' THEN ['de', 'es'] ELSE CAST([] AS VARCHAR[]) END AS leaves FROM base0
)"""
LOG = BASE + f""", log0 AS (
  SELECT *, CASE WHEN turn = 0 THEN {_NUM.format(29)} ELSE {_NUM.format(31)} END AS x
  FROM base, (VALUES (0), (1)) AS turns(turn) WHERE {_LOW.format(23, '40')}
), log1 AS (
  SELECT *, [{', '.join(f"'{d}'" for d in DECISIONS)}][1 + x % {len(DECISIONS)}] AS decision FROM log0
), log AS (
  SELECT doc_id, doc_id * 2 + turn AS ordinal, decision,
    CASE decision WHEN 'accept_llm' THEN a_label WHEN 'accept_vendor' THEN vendor WHEN 'accept_heuristic' THEN b_label WHEN 'other_leaf' THEN truth END AS final_label,
    CASE WHEN decision = 'accept_vendor' THEN leaves END AS covered, (x % 400) / 100.0::DOUBLE AS seconds
  FROM log1
), latest AS (
  SELECT * FROM log WHERE decision <> 'skip' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ordinal DESC) = 1
)"""
RUNS = """
runs AS (
  SELECT event_id AS call_id, concat(event_type, '-', user_id) AS run_id, event_type AS stage, ts,
    CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS status, event_id * 13 % 5000 AS tokens_in, event_id * 7 % 900 AS tokens_out,
    event_id * 13 % 5000 + 5 * (event_id * 7 % 900) AS usd
  FROM events
)"""
LABELED = BASE + """, label_runs AS (
  SELECT concat(source, '-', k) AS run_id, source, min(ts) AS started_at, CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'ok' END AS status
  FROM (SELECT ts, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS source, user_id % 5 AS k FROM events) GROUP BY source, k
), run_labels AS (
  SELECT doc_id, source, concat(source, '-', (k + doc_id % 2) % 5) AS run_id, label
  FROM (SELECT doc_id, 'a' AS source, a_label AS label FROM base UNION ALL SELECT doc_id, 'b', b_label FROM base), (VALUES (0), (1), (2)) AS ks(k)
)"""
