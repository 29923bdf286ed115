"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators import agreement, evaluate, export, generate, improve, induction, labeling, ledger, model, quality, review, similarity, taxonomy
from textloom.operators.ranking import global_rank
from textloom.plans import demo
from textloom.plans.demo import BASE, LEAVES, LOG, RUNS
from textloom.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        name = f.__name__.removeprefix("q_")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Personal data

_HITS = """
SELECT doc_id, '{kind}' AS type, {o} AS o, hits[k] AS value,
  CAST(coalesce(list_sum(list_transform(parts[1:k], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda p: length(p))), 0) AS INTEGER) AS start
FROM (SELECT doc_id, hits, parts, unnest(range(1, len(hits) + 1)) AS k FROM (
  SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS parts FROM documents WHERE regexp_matches(text, '{p}')))
"""
_PII = "raw AS (" + " UNION ALL ".join(_HITS.format(kind=k, o=o, p=p) for k, o, p in (("card", 0, T.CARD), ("email", 1, T.EMAIL), ("phone", 2, T.PHONE))) + """
), pii AS (
  SELECT doc_id, type, o, value, start, CAST(start + length(value) AS INTEGER) AS "end" FROM raw r
  WHERE type <> 'phone' OR NOT EXISTS (SELECT 1 FROM raw c WHERE c.type = 'card' AND c.doc_id = r.doc_id AND r.start >= c.start AND r.start < c.start + length(c.value))
)"""
_SCRUB = _PII + """, seen AS (
  SELECT *, coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM pii
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY start) AS k, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS cut FROM seen WHERE start >= upto
), built AS (
  SELECT k.doc_id, string_agg(substr(d.text, k.cut + 1, k.start - k.cut) || '[' || upper(type) || '_' || k.k || ']', '' ORDER BY start) || substr(any_value(d.text), CAST(max("end") AS INTEGER) + 1) AS body
  FROM kept k JOIN documents d USING (doc_id) GROUP BY k.doc_id
), scrubbed AS (
  SELECT d.doc_id, coalesce(b.body, d.text) AS body, (SELECT count(*) FROM pii p WHERE p.doc_id = d.doc_id) AS n_spans FROM documents d LEFT JOIN built b USING (doc_id)
)"""
_LEAK = " OR ".join(f"regexp_matches(body, '{p}')" for p in (T.CARD, T.EMAIL, T.PHONE))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.documents(spark, sf_dir, "doc_id", "text").select("doc_id", "text", T.pii_spans(F.col("text")).alias("spans"))


@query(f'WITH {_PII} SELECT doc_id, type, value, start, "end" FROM pii')
def q_pii_spans(spark, sf_dir):
    return spans(spark, sf_dir).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.type", "s.value", "s.start", "s.end")


@query(f"WITH {_PII} SELECT type, count(*) AS n, count(DISTINCT doc_id) AS documents FROM pii GROUP BY type")
def q_pii_by_type(spark, sf_dir):
    return q_pii_spans(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


@query(f"WITH {_SCRUB} SELECT doc_id, n_spans, md5(body) AS body_md5 FROM scrubbed WHERE n_spans > 0")
def q_pii_scrub(spark, sf_dir):
    rows = spans(spark, sf_dir).where(F.size("spans") > 0)
    return rows.select("doc_id", F.size("spans").cast("long").alias("n_spans"), F.md5(T.scrub(F.col("text"), F.col("spans"))["text"]).alias("body_md5"))


@query(f"WITH {_SCRUB} SELECT count(*) AS documents, count(*) FILTER (n_spans > 0) AS before, count(*) FILTER ({_LEAK}) AS after FROM scrubbed")
def q_pii_leaks_after_scrub(spark, sf_dir):
    rows = spans(spark, sf_dir).select(T.has_pii(F.col("text")).alias("before"), T.has_pii(T.scrub(F.col("text"), F.col("spans"))["text"]).alias("after"))
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("before").cast("long")).alias("before"), F.sum(F.col("after").cast("long")).alias("after"))


# Text functions

_NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_TERMS = f"list_filter(string_split({_NORM}, ' '), lambda w: length(w) > 2)"


@query(f"SELECT doc_id, md5({_NORM}) AS normalized_md5, CAST(length({_NORM}) AS BIGINT) AS n FROM documents")
def q_normalize_text(spark, sf_dir):
    n = T.normalize(F.col("text"))
    return demo.documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.md5(n).alias("normalized_md5"), F.length(n).cast("long").alias("n"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS)


@query(f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{T.TOKEN}'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})) AS t FROM documents)")
def q_tokenize_terms(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return demo.documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query("SELECT doc_id, greatest(1, CAST(floor(length(text) / 3.2::DOUBLE) AS INTEGER)) AS tokens, sha256(concat(source, '|', text)) AS cache_key, instr(text, '\n') = 0 AS one_line FROM documents")
def q_text_scalars(spark, sf_dir):
    return demo.table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), F.sha2(F.concat_ws("|", "source", "text"), 256).alias("cache_key"), (F.instr("text", "\n") == 0).alias("one_line"))


# Similarity

_POST = f"""
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT doc_id, term, df, (1 + ln(tf)) * (ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)) + 1) AS r FROM post JOIN df USING (term)),
w AS (SELECT doc_id, term, df, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS w FROM raw)"""
_COS = _POST + f""", class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5({_NORM})) AS first FROM documents WHERE len({_TERMS}) > 0), cos AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS cosine FROM w a JOIN w b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING sum(a.w * b.w) >= 0.85 - 1e-9
)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.documents(spark, sf_dir, "doc_id", "text")


@query(f"WITH {_POST} SELECT term, df FROM df ORDER BY df DESC, term LIMIT 100")
def q_doc_freq(spark, sf_dir):
    return similarity.doc_freq(texts(spark, sf_dir)).orderBy(F.desc("df"), "term").limit(100)


@query(f"WITH {_POST} SELECT doc_id, term, round(w, 6) AS w FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) <= 3")
def q_tfidf_weights_topk(spark, sf_dir):
    return similarity.weights(texts(spark, sf_dir), 3).select("doc_id", "term", F.round("w", 6).alias("w"))


@query(f"WITH {_POST} SELECT term, df FROM df")
def q_doc_freq_all(spark, sf_dir):
    return similarity.doc_freq(texts(spark, sf_dir))


@query(f"WITH {_POST} SELECT doc_id, term, df, round(w, 6) AS w FROM w")
def q_tfidf_weights(spark, sf_dir):
    return similarity.weights(texts(spark, sf_dir)).select("doc_id", "term", "df", F.round("w", 6).alias("w"))


@query(f"WITH {_COS} SELECT a, b, round(cosine, 6) AS cosine FROM cos WHERE a IN (SELECT first FROM class) AND b IN (SELECT first FROM class)")
def q_cosine_pairs(spark, sf_dir):
    return similarity.cosine_pairs(texts(spark, sf_dir)).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {_COS} SELECT doc_id, first FROM class")
def q_text_classes(spark, sf_dir):
    return similarity.classes(texts(spark, sf_dir)).select("doc_id", "first")


@query(f"WITH RECURSIVE {_COS}, e AS (SELECT a, b FROM cos UNION SELECT b, a FROM cos), reach(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM reach r JOIN e ON r.y = e.a) SELECT x AS doc_id, least(x, min(y)) AS component FROM reach GROUP BY x")
def q_cosine_clusters(spark, sf_dir):
    docs = texts(spark, sf_dir)
    members = similarity.classes(docs)
    return similarity.document_clusters(similarity.cosine_links(docs, members=members), members)


@query(f"WITH {_COS} SELECT doc_id, round(max(cosine), 6) AS best FROM (SELECT a AS doc_id, cosine FROM cos UNION ALL SELECT b, cosine FROM cos) GROUP BY doc_id")
def q_best_similarity(spark, sf_dir):
    docs = texts(spark, sf_dir)
    members = similarity.classes(docs)
    return similarity.best_similarity(similarity.cosine_pairs(docs, members=members), members).select("doc_id", F.round("best", 6).alias("best"))


def near_clusters(docs: DataFrame) -> DataFrame:
    """doc_id and component of all near duplicates of docs (doc_id, text), copies among them."""
    members = similarity.classes(docs)
    return similarity.document_clusters(similarity.near_duplicates(docs, members=members, linked=True), members)


@query()
def q_near_dup_pairs(spark, sf_dir):
    return similarity.near_duplicates(texts(spark, sf_dir)).select("a", "b", F.round("cosine", 6).alias("cosine"), F.round("ratio", 4).alias("ratio"))


@query()
def q_near_dup_clusters(spark, sf_dir):
    return near_clusters(texts(spark, sf_dir))


@query(f"""WITH RECURSIVE {BASE}, {_COS}, e AS (SELECT a, b FROM cos UNION SELECT b, a FROM cos), reach(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM reach r JOIN e ON r.y = e.a),
  m AS (SELECT x AS doc_id, least(x, min(y)) AS component FROM reach GROUP BY x)
SELECT component, count(DISTINCT b_label) AS labels, count(DISTINCT CASE WHEN len(leaves) > 0 AND b_label IS NOT NULL THEN NOT list_contains(leaves, b_label) END) AS sides, count(*) AS members
FROM m JOIN base USING (doc_id) GROUP BY component HAVING count(*) > 1 AND (labels > 1 OR sides > 1)""")
def q_contested_clusters(spark, sf_dir):
    members = q_cosine_clusters(spark, sf_dir).join(demo.rows(spark, sf_dir).select("doc_id", F.col("b_label").alias("label"), "leaves"), "doc_id")
    return quality.contested(members)


# Labeling

_W = ", ".join(f"('{leaf}', '{t}', {w})" for leaf, t, w in demo.WEIGHTS)
_TOK = f"list_filter(regexp_extract_all(lower({{0}}), '{T.TOKEN}'), lambda w: length(w) > 2)"
_LABEL = f"""
weights(leaf, term, w) AS (VALUES {_W}),
bag AS (
  SELECT doc_id, unnest(list_distinct({_TOK.format("split_part(text, chr(10), 1)")})) AS term, 2 AS times FROM documents
  UNION ALL SELECT doc_id, unnest({_TOK.format('text')}), 1 FROM documents
), hit AS (SELECT doc_id, leaf, CAST(sum(times * w) AS BIGINT) AS score FROM bag JOIN weights USING (term) GROUP BY doc_id, leaf),
every AS (SELECT d.doc_id, l.leaf, coalesce(h.score, 0) AS score FROM documents d CROSS JOIN (SELECT DISTINCT leaf FROM weights) l LEFT JOIN hit h ON h.doc_id = d.doc_id AND h.leaf = l.leaf),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, leaf) AS n, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, leaf) AS second FROM every),
labeled AS (SELECT doc_id, leaf AS label, score, CASE WHEN score <= 0 THEN 0.0::DOUBLE ELSE least(1.0, greatest(0.0, (score - second)::DOUBLE / score)) END AS margin FROM placed WHERE n = 1)"""


@query(f"WITH {_LABEL} SELECT * FROM labeled")
def q_heuristic_label(spark, sf_dir):
    return labeling.label(demo.tickets(spark, sf_dir), demo.WEIGHTS, LEAVES, ())


@query(f"WITH {_LABEL} SELECT lang AS truth, label, count(*) AS n FROM labeled JOIN documents USING (doc_id) GROUP BY ALL")
def q_heuristic_confusion(spark, sf_dir):
    found = q_heuristic_label(spark, sf_dir).select("doc_id", "label")
    return demo.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("truth")).join(found, "doc_id").groupBy("truth", "label").agg(F.count(F.lit(1)).alias("n"))


_DIRTY = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'none' WHEN doc_id % 7 = 0 THEN 'xx' ELSE a_label END AS label, a_conf * 2 - 0.5::DOUBLE AS confidence, 'why  so ' || truth AS rationale, a_abstain AS abstain FROM base"


@query(f"""WITH {BASE}, dirty AS ({_DIRTY}) SELECT doc_id, CASE WHEN NOT abstain AND label IN ('de', 'en', 'es', 'fr') THEN label END AS label, greatest(0.0, least(1.0, confidence)) AS confidence,
  'why so' AS rationale, NOT coalesce(NOT abstain AND label IN ('de', 'en', 'es', 'fr'), false) AS abstain FROM dirty""")
def q_annotation_cleaning(spark, sf_dir):
    rows = demo.rows(spark, sf_dir)
    dirty = rows.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "none").when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("a_label")).alias("label"), (F.col("a_conf") * 2 - 0.5).alias("confidence"), F.concat(F.lit("why  so "), "truth").alias("rationale"), F.col("a_abstain").alias("abstain"))
    return labeling.clean(dirty, LEAVES, 2)


@query(f"WITH {BASE} SELECT d.doc_id, a.a_label AS label, coalesce(a.a_conf, 0.0) AS confidence, coalesce(a.a_abstain, true) AS abstain FROM documents d LEFT JOIN (SELECT * FROM base WHERE doc_id % 3 <> 0) a USING (doc_id)")
def q_missing_as_abstain(spark, sf_dir):
    some = demo.rows(spark, sf_dir).where("doc_id % 3 <> 0").select("doc_id", F.col("a_label").alias("label"), F.col("a_conf").alias("confidence"), F.col("a_abstain").alias("abstain"))
    return labeling.fill_missing(demo.table(spark, sf_dir, "documents"), some)


@query("""WITH keyed AS (SELECT doc_id, sha256(concat(lang, '|', text)) AS cache_key FROM documents), cache AS (SELECT DISTINCT cache_key FROM keyed WHERE doc_id % 4 = 0)
SELECT 'hit' AS kind, count(*) AS n FROM keyed WHERE cache_key IN (SELECT cache_key FROM cache) UNION ALL SELECT 'miss', count(*) FROM keyed WHERE cache_key NOT IN (SELECT cache_key FROM cache)""")
def q_cache_hits_misses(spark, sf_dir):
    docs = demo.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    key = F.sha2(F.concat_ws("|", "lang", "text"), 256)
    cache = docs.where("doc_id % 4 = 0").select(key.alias("cache_key")).distinct()
    hits, misses = labeling.split_cache(docs, cache, key)
    return hits.agg(F.count(F.lit(1)).alias("n")).select(F.lit("hit").alias("kind"), "n").unionByName(misses.agg(F.count(F.lit(1)).alias("n")).select(F.lit("miss").alias("kind"), "n"))


# Agreement

_SINGLE = "CASE WHEN len(leaves) = 1 THEN leaves[1] END"


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the vendor's leaf where it covers one only."""
    return demo.rows(spark, sf_dir).withColumn("v_label", F.when(F.size("leaves") == 1, F.col("leaves")[0]))


_PAIRS = (("a_label", "b_label"), ("v_label", "a_label"), ("v_label", "b_label"))
_VIEW = BASE + f", v AS (SELECT *, {_SINGLE} AS v_label FROM base)"


@query("WITH " + _VIEW + " " + " UNION ALL ".join(f"SELECT '{a}/{b}' AS pair, count(*) AS n, count(*) FILTER ({a} = {b}) AS matches, (count(*) FILTER ({a} = {b}))::DOUBLE / nullif(count(*), 0) AS agreement FROM v WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS))
def q_annotator_agreement(spark, sf_dir):
    return agreement.agreements(views(spark, sf_dir), _PAIRS)


_KAPPA = """SELECT '{a}/{b}' AS pair, n, same::DOUBLE / n AS observed, chance::DOUBLE / (n * n) AS expected, (same::DOUBLE / n - chance::DOUBLE / (n * n)) / (1 - chance::DOUBLE / (n * n)) AS kappa FROM (
  SELECT (SELECT count(*) FROM v WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, (SELECT count(*) FROM v WHERE {a} = {b}) AS same,
    (SELECT CAST(sum(x.n * y.n) AS BIGINT) FROM (SELECT {a} AS k, count(*) AS n FROM v WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) x JOIN (SELECT {b} AS k, count(*) AS n FROM v WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) y USING (k)) AS chance)"""


@query("WITH " + _VIEW + " " + " UNION ALL ".join(_KAPPA.format(a=a, b=b) for a, b in _PAIRS))
def q_cohen_kappa(spark, sf_dir):
    return agreement.kappas(views(spark, sf_dir), _PAIRS)


@query("""WITH l AS (SELECT d.doc_id, l.quality, CASE WHEN length(d.text) > 300 THEN 1 ELSE 0 END AS long FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'quality/long' AS pair, count(*) AS n, count(*) FILTER (quality = long) AS matches, (count(*) FILTER (quality = long))::DOUBLE / nullif(count(*), 0) AS agreement FROM l WHERE quality IS NOT NULL""")
def q_partial_agreement(spark, sf_dir):
    rows = texts(spark, sf_dir).join(demo.table(spark, sf_dir, "labels"), "doc_id", "left").select("quality", F.when(F.length("text") > 300, 1).otherwise(0).alias("long"))
    return agreement.agreements(rows, (("quality", "long"),))


@query(f"WITH {_VIEW} SELECT v_label AS label_a, a_label AS label_b, count(*) AS n FROM v WHERE v_label IS NOT NULL AND a_label IS NOT NULL GROUP BY ALL")
def q_confusion_pairs(spark, sf_dir):
    return agreement.confusion(views(spark, sf_dir), "v_label", "a_label")


@query(f"WITH {BASE} SELECT vendor AS label_a, a_label AS label_b, count(*) AS n FROM base WHERE a_label <> vendor GROUP BY ALL ORDER BY n DESC, label_a, label_b LIMIT 10")
def q_top_confusions(spark, sf_dir):
    return agreement.top_confusions(demo.rows(spark, sf_dir), "vendor", "a_label")


@query(f"""WITH {BASE}, c AS (SELECT vendor AS a, a_label AS b FROM base WHERE a_label IS NOT NULL), k AS (SELECT a AS label FROM c UNION SELECT b FROM c), s AS (
  SELECT label, (SELECT count(*) FROM c WHERE a = label AND b = label) AS tp, (SELECT count(*) FROM c WHERE a = label) AS n_given, (SELECT count(*) FROM c WHERE b = label) AS n_ref FROM k)
SELECT *, coalesce(tp::DOUBLE / nullif(n_ref, 0), 0) AS tp_over_ref, coalesce(tp::DOUBLE / nullif(n_given, 0), 0) AS tp_over_given FROM s""")
def q_per_class_pr(spark, sf_dir):
    return agreement.per_class(demo.rows(spark, sf_dir), "vendor", "a_label")


@query(f"""WITH {BASE} SELECT *, compatible::DOUBLE / nullif(comparable, 0) AS rate FROM (SELECT count(*) FILTER (a_label IS NOT NULL AND len(leaves) > 0) AS comparable, count(*) FILTER (list_contains(leaves, a_label)) AS compatible,
  count(*) FILTER (len(leaves) > 1) AS coarse, count(*) FILTER (len(leaves) = 0) AS unmappable, count(*) FILTER (a_label IS NULL) AS unlabeled FROM base)""")
def q_compatibility_rate(spark, sf_dir):
    return agreement.compatibility(demo.rows(spark, sf_dir), "a_label", "leaves")


@query(f"""WITH {BASE}, x AS (SELECT 'vendor' AS source, unnest(CASE WHEN len(leaves) = 0 THEN [NULL] ELSE leaves END) AS label FROM base UNION ALL SELECT 'a', a_label FROM base UNION ALL SELECT 'b', b_label FROM base)
SELECT source, coalesce(label, '(none)') AS label, count(*) AS n FROM x GROUP BY ALL""")
def q_label_distribution(spark, sf_dir):
    return agreement.distribution(demo.rows(spark, sf_dir), {"vendor": "leaves", "a": "a_label", "b": "b_label"})


@query(f"WITH {BASE} SELECT count(*) FILTER (a_abstain) AS abstained, round(avg(a_conf) FILTER (NOT a_abstain), 9) AS mean_confidence FROM base")
def q_mean_confidence(spark, sf_dir):
    return agreement.mean_confidence(demo.rows(spark, sf_dir), "a_conf", "a_abstain").withColumn("mean_confidence", F.round("mean_confidence", 9))


# Defects and routing

_SUSPECT = BASE + """, suspected AS (
  SELECT doc_id, array_to_string(list_sort(leaves), '|') AS vendor_leaves, a_label AS proposed, a_conf AS confidence, CASE WHEN a_label = b_label AND a_conf >= 0.70 THEN 'two annotators' ELSE 'single high confidence' END AS route
  FROM base WHERE len(leaves) > 0 AND a_label IS NOT NULL AND b_label IS NOT NULL AND NOT a_abstain AND NOT list_contains(leaves, a_label) AND ((a_label = b_label AND a_conf >= 0.70) OR a_conf >= 0.90)
), ambiguous0 AS (
  SELECT doc_id, list_filter([CASE WHEN a_abstain THEN 'abstained' WHEN coalesce(a_conf, 0) < 0.55 THEN 'low_confidence' END,
    CASE WHEN len(leaves) > 0 AND a_label IS NOT NULL AND b_label IS NOT NULL AND NOT list_contains(leaves, a_label) AND NOT list_contains(leaves, b_label) AND a_label <> b_label THEN 'three_way_disagreement' END], lambda r: r IS NOT NULL) AS reasons FROM base
), ambiguous AS (SELECT * FROM ambiguous0 WHERE len(reasons) > 0)"""
_ROUTED = _SUSPECT + """, near AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text) HAVING count(*) > 1), routed AS (
  SELECT doc_id, arg_min(reason, p) AS reason FROM (SELECT doc_id, 'suspected_label_error' AS reason, 0 AS p FROM suspected UNION ALL SELECT doc_id, 'ambiguity', 1 FROM ambiguous UNION ALL SELECT doc_id, 'duplicate', 2 FROM near) GROUP BY doc_id)"""


#: The leaves that vendor labels reach.
REACHED = ["en", "fr", "de"]


def firsts_of(docs: DataFrame) -> DataFrame:
    """doc_id and component, the smallest doc_id with the same text."""
    rows = docs.select("doc_id", F.md5("text").alias("same"))
    return rows.join(rows.groupBy("same").agg(F.min("doc_id").alias("component")), "same").select("doc_id", "component")


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every text that occurs more than once."""
    return texts(spark, sf_dir).groupBy(F.md5("text").alias("m")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")


def contested_firsts(spark: SparkSession, sf_dir: str, clusters: DataFrame) -> DataFrame:
    """The smallest doc_id of every near-duplicate cluster (doc_id, component) whose members' labels conflict."""
    labels = demo.rows(spark, sf_dir).select("doc_id", F.col("a_label").alias("label"), "leaves")
    return quality.contested(clusters.join(labels, "doc_id")).select(F.col("component").alias("doc_id"))


def routed(spark: SparkSession, sf_dir: str, near: bool = False, clusters: DataFrame | None = None) -> DataFrame:
    """doc_id and reason. `near` takes contested near-duplicate clusters in place of exact copies, and leaves out what is a finding on granularity."""
    rows = demo.rows(spark, sf_dir)
    if near:
        found = quality.suspected(rows).where(F.col("proposed").isin(*REACHED))
        return quality.route((found, "suspected_label_error"), (quality.ambiguous(rows), "ambiguity"), (contested_firsts(spark, sf_dir, q_near_dup_clusters(spark, sf_dir) if clusters is None else clusters), "duplicate"))
    return quality.route((quality.suspected(rows), "suspected_label_error"), (quality.ambiguous(rows), "ambiguity"), (copies(spark, sf_dir), "duplicate"))


@query(f"WITH {_SUSPECT} SELECT *, CAST(row_number() OVER (ORDER BY confidence DESC, doc_id) AS INTEGER) AS rank FROM suspected WHERE proposed IN ('en', 'fr', 'de')")
def q_suspected_errors(spark, sf_dir):
    return quality.split_by_reach(quality.suspected(demo.rows(spark, sf_dir)), ["en", "fr", "de"])[0]


@query(f"WITH {_SUSPECT} SELECT proposed, count(*) AS n FROM suspected WHERE proposed NOT IN ('en', 'fr', 'de') GROUP BY proposed")
def q_taxonomy_granularity(spark, sf_dir):
    return quality.split_by_reach(quality.suspected(demo.rows(spark, sf_dir)), ["en", "fr", "de"])[1].groupBy("proposed").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SUSPECT} SELECT doc_id, array_to_string(reasons, '|') AS reasons FROM ambiguous")
def q_ambiguity_flags(spark, sf_dir):
    return quality.ambiguous(demo.rows(spark, sf_dir)).select("doc_id", F.array_join("reasons", "|").alias("reasons"))


@query(f"WITH {_ROUTED} SELECT * FROM routed")
def q_routing(spark, sf_dir, near=False):
    return routed(spark, sf_dir, near)


@query(f"WITH {_ROUTED} SELECT reason, count(*) AS n FROM routed GROUP BY reason")
def q_routed_by_reason(spark, sf_dir, near=False):
    return routed(spark, sf_dir, near).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ROUTED}, t AS (SELECT count(*) AS total FROM documents) SELECT routed, total, routed::DOUBLE / total AS ratio, routed BETWEEN 60 AND 100 AS in_band FROM (SELECT count(DISTINCT doc_id) AS routed FROM routed), t")
def q_queue_ratio(spark, sf_dir, near=False):
    return quality.queue_ratio(routed(spark, sf_dir, near), demo.table(spark, sf_dir, "documents"))


@query(f"""WITH {_ROUTED}, r AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY confidence DESC, doc_id) AS INTEGER) AS rank FROM suspected)
SELECT doc_id, reason, rank, CAST(row_number() OVER (ORDER BY CASE reason WHEN 'suspected_label_error' THEN 0 WHEN 'ambiguity' THEN 1 ELSE 2 END, rank NULLS FIRST, doc_id) AS INTEGER) AS place FROM routed LEFT JOIN r USING (doc_id)
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = routed.doc_id AND d.doc_id % 10 = 0)""")
def q_review_queue_pending(spark, sf_dir, near=False):
    found = quality.suspected(demo.rows(spark, sf_dir))
    found = found.where(F.col("proposed").isin(*REACHED)) if near else found
    ranks = global_rank(found.select("doc_id", "confidence"), [F.desc("confidence"), F.asc("doc_id")], "rank").drop("confidence")
    done = demo.table(spark, sf_dir, "documents").where("doc_id % 10 = 0").select("doc_id")
    return quality.queue(routed(spark, sf_dir, near).join(done, "doc_id", "left_anti"), ranks)


@query(f"WITH {_ROUTED} SELECT flag_type, count(*) AS n FROM (SELECT 'suspected_label_error' AS flag_type FROM suspected UNION ALL SELECT 'ambiguity' FROM ambiguous UNION ALL SELECT 'duplicate' FROM near) GROUP BY flag_type")
def q_flag_counts(spark, sf_dir):
    rows = demo.rows(spark, sf_dir)
    found = quality.flags({"suspected_label_error": quality.suspected(rows), "ambiguity": quality.ambiguous(rows), "duplicate": copies(spark, sf_dir)})
    return found.groupBy("flag_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ROUTED}, f AS (SELECT doc_id, 'suspected_label_error' AS t FROM suspected UNION ALL SELECT doc_id, 'ambiguity' FROM ambiguous UNION ALL SELECT doc_id, 'duplicate' FROM near) SELECT doc_id, array_to_string(list_sort(list_distinct(list(t))), '|') AS flags FROM f GROUP BY doc_id")
def q_flags_of_document(spark, sf_dir):
    rows = demo.rows(spark, sf_dir)
    found = quality.flags({"suspected_label_error": quality.suspected(rows), "ambiguity": quality.ambiguous(rows), "duplicate": copies(spark, sf_dir)})
    return found.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("flag_type")), "|").alias("flags"))


@query()
def q_near_flags(spark, sf_dir):
    """All five kinds of findings with their rank, and whether the document was routed for it; every member of a near-duplicate cluster is flagged."""
    rows = demo.rows(spark, sf_dir)
    clusters = q_near_dup_clusters(spark, sf_dir)
    suspected, granularity = quality.split_by_reach(quality.suspected(rows), REACHED)
    places = global_rank(clusters.select("component").distinct(), [F.asc("component")], "rank")
    what = ("vendor_leaves", "proposed", "confidence", "route")
    parts = {"taxonomy_granularity": quality.detailed(granularity, *what), "suspected_label_error": quality.detailed(suspected, *what), "duplicate": quality.detailed(clusters.join(places, "component"), "component"),
             "pii": quality.detailed(spans(spark, sf_dir).where(F.size("spans") > 0).select("doc_id", "spans"), "spans"), "ambiguity": quality.detailed(global_rank(quality.ambiguous(rows), [F.asc("doc_id")], "rank"), "reasons")}
    return quality.flags(parts, routed(spark, sf_dir, True, clusters))


@query()
def q_near_flag_counts(spark, sf_dir):
    return q_near_flags(spark, sf_dir).groupBy("flag_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("routed").cast("long")).alias("routed"))


@query()
def q_near_flags_of_document(spark, sf_dir):
    kinds = F.array_join(F.sort_array(F.collect_set("flag_type")), "|")
    return q_near_flags(spark, sf_dir).groupBy("doc_id").agg(kinds.alias("flags"), F.bool_or("routed").alias("routed"))


# Review

@query(f"WITH {LOG} SELECT doc_id, ordinal, decision, final_label, seconds FROM latest")
def q_adjudication_latest(spark, sf_dir):
    return improve.latest_adjudications(demo.log(spark, sf_dir)).select("doc_id", "ordinal", "decision", "final_label", "seconds")


@query(f"WITH {LOG} SELECT decision, count(*) AS n, round(sum(seconds), 6) AS seconds, round(sum(seconds) / 60, 6) AS minutes, round(sum(seconds) / count(*), 6) AS mean_seconds FROM log GROUP BY decision")
def q_decision_summary(spark, sf_dir):
    return ledger.decisions(demo.log(spark, sf_dir)).select("decision", "n", *[F.round(c, 6).alias(c) for c in ("seconds", "minutes", "mean_seconds")])


@query(f"WITH {LOG}, s AS (SELECT decision, seconds, row_number() OVER (PARTITION BY decision ORDER BY seconds) - 1 AS i, count(*) OVER (PARTITION BY decision) AS n FROM log) SELECT decision, n, seconds AS upper_median FROM s WHERE i = n // 2")
def q_upper_median_seconds(spark, sf_dir):
    return ledger.upper_median(demo.log(spark, sf_dir), ["decision"], "seconds")


@query(f"WITH {LOG}, s AS (SELECT decision, seconds, row_number() OVER (PARTITION BY decision ORDER BY seconds) - 1 AS i, count(*) OVER (PARTITION BY decision) AS n FROM log) SELECT decision, n, CASE WHEN n < 20 THEN 1.0 ELSE greatest(0.5, least(3.0, seconds)) END::DOUBLE AS floor FROM s WHERE i = greatest(0, n * 5 // 100 - 1)")
def q_fast_floor(spark, sf_dir):
    return ledger.fast_floor(demo.log(spark, sf_dir), ["decision"], "seconds")


_SHORT = "SELECT event_id, user_id, CASE WHEN event_id % 3 < 2 THEN 'x' ELSE 'y' END AS decision, (event_id * 37 % 300) / 100.0::DOUBLE AS seconds FROM events"


@query(f"""WITH e AS ({_SHORT}), b AS (SELECT *, seconds < 2.0 AS fast, CASE WHEN NOT seconds < 2.0 OR coalesce(lag(seconds) OVER w >= 2.0, true) OR lag(decision) OVER w IS DISTINCT FROM decision THEN 1 ELSE 0 END AS brk FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM b)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, min(decision) AS decision, count(*) AS length FROM i WHERE fast GROUP BY user_id, island HAVING count(*) >= 3""")
def q_fast_runs(spark, sf_dir):
    rows = demo.table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 < 2, "x").otherwise("y").alias("decision"), ((F.col("event_id") * 37 % 300) / 100.0).alias("seconds"))
    return ledger.fast_runs(rows, "user_id", "event_id", "decision", "seconds", 2.0)


# Versions

_V2 = LOG + """, clusters AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS component FROM documents), v2 AS (
  SELECT d.doc_id, a.decision, CASE WHEN b.a_abstain THEN NULL ELSE b.a_label END AS before, b.b_label AS other, a.final_label, a.covered, c.component
  FROM documents d JOIN base b USING (doc_id) LEFT JOIN latest a USING (doc_id) JOIN clusters c USING (doc_id)
), v2b AS (
  SELECT *, CASE WHEN decision = 'ambiguous_both' AND other IS NOT NULL AND other IS DISTINCT FROM before THEN other END AS alt_label,
    CASE WHEN decision IS NULL OR decision = 'ambiguous_both' THEN NULL WHEN decision = 'accept_vendor' AND final_label IS NOT NULL THEN CASE WHEN list_contains(covered, before) THEN before WHEN len(covered) = 1 THEN covered[1] ELSE before END ELSE final_label END AS after FROM v2
), v2c AS (
  SELECT doc_id, before, CASE WHEN after IS NOT NULL AND after IS DISTINCT FROM before THEN after ELSE before END AS label, alt_label,
    CASE WHEN decision = 'ambiguous_both' AND alt_label IS NULL THEN 'quarantined' WHEN component <> doc_id THEN 'merged_duplicate' ELSE 'kept' END AS status FROM v2b
)"""


def second(spark: SparkSession, sf_dir: str, near: bool = False) -> DataFrame:
    """The second version; `near` merges near-duplicate clusters in place of exact copies."""
    rows = demo.rows(spark, sf_dir)
    docs = texts(spark, sf_dir)
    clusters = q_near_dup_clusters(spark, sf_dir) if near else firsts_of(docs)
    return improve.second_version(docs, improve.first_version(rows), improve.latest_adjudications(demo.log(spark, sf_dir)).select("doc_id", "decision", "final_label", "covered"), rows.select("doc_id", F.col("b_label").alias("other")), clusters)


@query(f"WITH {BASE} SELECT doc_id, CASE WHEN NOT a_abstain THEN a_label END AS label FROM base")
def q_dataset_v1(spark, sf_dir):
    return improve.first_version(demo.rows(spark, sf_dir))


@query(f"WITH {_V2} SELECT doc_id, before, label, alt_label, status FROM v2c")
def q_dataset_v2(spark, sf_dir, near=False):
    return second(spark, sf_dir, near).select("doc_id", "before", "label", "alt_label", "status")


_DIFF = _V2 + ", " + _PII + """, counts AS (SELECT doc_id, count(*) AS n FROM pii GROUP BY doc_id), diff AS (
  SELECT doc_id, 'label' AS field, before, label AS after FROM v2c WHERE label IS NOT NULL AND label IS DISTINCT FROM before
  UNION ALL SELECT doc_id, 'alt_label', NULL, alt_label FROM v2c WHERE alt_label IS NOT NULL
  UNION ALL SELECT doc_id, 'status', 'kept', status FROM v2c WHERE status <> 'kept'
  UNION ALL SELECT doc_id, 'body', n || ' spans', 'scrubbed' FROM counts)"""


@query(f"WITH {_DIFF} SELECT * FROM diff")
def q_v1_v2_diff(spark, sf_dir, near=False):
    return improve.difference(second(spark, sf_dir, near))


@query(f"WITH {_DIFF} SELECT field, count(*) AS n, count(DISTINCT doc_id) AS documents FROM diff GROUP BY field")
def q_diff_summary(spark, sf_dir, near=False):
    return improve.difference(second(spark, sf_dir, near)).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


# Evaluation

@query(f"""WITH {_V2}, r AS (SELECT v2c.*, truth, leaves, vendor FROM v2c JOIN base USING (doc_id)), m AS (
  SELECT 'v1' AS name, count(*) AS n, count(*) FILTER (before = truth) AS hits FROM r
  UNION ALL SELECT 'v2', count(*), count(*) FILTER (label = truth OR alt_label = truth) FROM r WHERE status <> 'merged_duplicate'
  UNION ALL SELECT 'v1_same_rows', count(*), count(*) FILTER (before = truth) FROM r WHERE status <> 'merged_duplicate'
  UNION ALL SELECT 'vendor', count(*), count(*) FILTER (list_contains(leaves, truth)) FROM r)
SELECT *, coalesce(hits::DOUBLE / nullif(n, 0), 0) AS value FROM m""")
def q_eval_accuracy(spark, sf_dir, near=False):
    rows = second(spark, sf_dir, near).join(demo.rows(spark, sf_dir).select("doc_id", "truth", "leaves"), "doc_id")
    left = rows.where("status <> 'merged_duplicate'")
    parts = [evaluate.accuracy(rows, "v1", F.expr("before = truth")), evaluate.accuracy(left, "v2", F.expr("coalesce(label = truth, false) or coalesce(alt_label = truth, false)")),
             evaluate.accuracy(left, "v1_same_rows", F.expr("before = truth")), evaluate.accuracy(rows, "vendor", evaluate.correct(targets="leaves"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {_SUSPECT}, x AS (SELECT b.doc_id, vendor <> truth AS planted, s.doc_id IS NOT NULL AS found FROM base b LEFT JOIN suspected s USING (doc_id)), c AS (SELECT count(*) FILTER (planted) AS planted, count(*) FILTER (found) AS found, count(*) FILTER (planted AND found) AS \"both\" FROM x) SELECT *, coalesce(\"both\"::DOUBLE / nullif(planted, 0), 0) AS recall, coalesce(\"both\"::DOUBLE / nullif(found, 0), 0) AS precision FROM c")
def q_seeded_error_recall(spark, sf_dir):
    rows = demo.rows(spark, sf_dir)
    found = quality.suspected(rows).select("doc_id", F.lit(True).alias("f"))
    return evaluate.recall_precision(rows.join(found, "doc_id", "left"), F.col("vendor") != F.col("truth"), F.coalesce("f", F.lit(False)))


@query("""WITH c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS component FROM documents), p AS (SELECT md5(text) AS pair_id, doc_id FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)),
  s AS (SELECT pair_id, count(*) AS size FROM p GROUP BY 1), h AS (SELECT DISTINCT pair_id FROM (SELECT pair_id, component, count(*) AS n FROM p JOIN c USING (doc_id) GROUP BY ALL) JOIN s USING (pair_id) WHERE n = size)
SELECT count(*) AS pairs, count(h.pair_id) AS found, coalesce(count(h.pair_id)::DOUBLE / nullif(count(*), 0), 0) AS recall FROM s LEFT JOIN h USING (pair_id)""")
def q_duplicate_recall(spark, sf_dir):
    docs = texts(spark, sf_dir).select("doc_id", F.md5("text").alias("pair_id"))
    several = docs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pair_id")
    return evaluate.pair_recall(docs.join(several, "pair_id", "left_semi"), firsts_of(texts(spark, sf_dir)))


def planted_pairs(spark: SparkSession) -> DataFrame:
    """pair_id, doc_id (below zero), text and shape (the subject) of generated tickets and their paraphrases."""
    pairs = generate.copies(spark, 600, 11).join(generate.tickets(spark, 600, 11).select("doc_id", "subject"), "doc_id")
    both = F.array(F.struct((-1 - 2 * F.col("doc_id")).alias("doc_id"), F.col("original").alias("text")), F.struct((-2 - 2 * F.col("doc_id")).alias("doc_id"), F.col("body").alias("text")))
    return pairs.select(F.col("doc_id").alias("pair_id"), F.col("subject").alias("shape"), F.explode(both).alias("x")).select("pair_id", "x.doc_id", "x.text", "shape")


@query()
def q_near_duplicate_recall(spark, sf_dir):
    """The detected near-duplicate clusters of documents and planted pairs; the shape of a document is its normalised text."""
    # Generated once: the plan of all tickets would stand in each plan of the search.
    planted = tables.written(planted_pairs(spark), "planted-pairs")
    docs = texts(spark, sf_dir)
    shapes = docs.select("doc_id", F.md5(T.normalize(F.coalesce("text", F.lit("")))).alias("shape")).unionByName(planted.select("doc_id", "shape"))
    found = near_clusters(docs.unionByName(planted.select("doc_id", "text")))
    return evaluate.cluster_scores(planted.select("pair_id", "doc_id"), found, shapes)


@query(f"""WITH {_PII}, x AS (SELECT d.doc_id, regexp_matches(text, '[0-9]{{3}}[ .-][0-9]{{3}}') AS planted, p.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM pii) p USING (doc_id)),
  c AS (SELECT count(*) FILTER (planted) AS planted, count(*) FILTER (found) AS found, count(*) FILTER (planted AND found) AS "both" FROM x)
SELECT *, coalesce("both"::DOUBLE / nullif(planted, 0), 0) AS recall, coalesce("both"::DOUBLE / nullif(found, 0), 0) AS precision FROM c""")
def q_pii_recall(spark, sf_dir):
    return evaluate.recall_precision(spans(spark, sf_dir), F.col("text").rlike("[0-9]{3}[ .-][0-9]{3}"), F.size("spans") > 0)


@query(f"""WITH {BASE}, s AS (SELECT count(*) AS n, count(*) FILTER (a_abstain) AS abstained, count(*) FILTER (doc_id % 9 = 0) AS amb, count(*) FILTER (a_abstain AND doc_id % 9 = 0) AS bo, count(*) FILTER (a_abstain AND b_label = truth) AS oa, count(*) FILTER (NOT a_abstain AND b_label = truth) AS ob FROM base)
SELECT n, abstained, amb::DOUBLE / n AS base_rate, coalesce(bo::DOUBLE / nullif(abstained, 0), 0) AS share, coalesce(coalesce(bo::DOUBLE / nullif(abstained, 0), 0) / nullif(amb::DOUBLE / n, 0), 0) AS concentration,
  coalesce(oa::DOUBLE / nullif(abstained, 0), 0) AS accuracy_abstained, coalesce(ob::DOUBLE / nullif(n - abstained, 0), 0) AS accuracy_answered FROM s""")
def q_abstention_calibration(spark, sf_dir):
    return evaluate.abstention(demo.rows(spark, sf_dir), F.col("doc_id") % 9 == 0, F.col("b_label") == F.col("truth"))


def gate_values(spark: SparkSession, sf_dir: str, near: bool) -> DataFrame:
    """name and value of every gate, from the whole tables; `near` takes near duplicates in place of exact copies."""
    named = lambda df, name, value: df.select(F.lit(name).alias("name"), value.cast("double").alias("value"))
    cost = demo.costs(spark, sf_dir).agg((F.coalesce(F.sum("usd"), F.lit(0)) / 1_000_000).alias("usd"))
    out = named(evaluate.delta_points(q_eval_accuracy(spark, sf_dir, near=near)), "delta_points", F.col("delta_points"))
    for part in (named(q_seeded_error_recall(spark, sf_dir), "seeded_recall", F.col("recall")), named(q_pii_leaks_after_scrub(spark, sf_dir), "leaks", F.coalesce("after", F.lit(0))),
                 named((q_near_duplicate_recall if near else q_duplicate_recall)(spark, sf_dir), "duplicate_recall", F.col("recall")), named(cost, "cost_usd", F.col("usd"))):
        out = out.unionByName(part)
    return out


@query()
def q_near_release_gates(spark, sf_dir):
    """All gates over the whole tables; accuracies and duplicates are those of near-duplicate clusters."""
    return evaluate.gates(gate_values(spark, sf_dir, near=True))


# Export

@query(f"""WITH {_V2}, u AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('20260904|', doc_id)), doc_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM v2c WHERE status = 'kept' AND label IS NOT NULL)
SELECT doc_id, label, CASE WHEN i <= greatest(1, CAST(round_even(n * 0.85::DOUBLE, 0) AS BIGINT)) THEN 'train' ELSE 'eval' END AS split FROM u""")
def q_export_split(spark, sf_dir, near=False):
    return export.split(export.usable(second(spark, sf_dir, near)).select("doc_id", "label"))


@query(f"WITH {_V2} SELECT CASE WHEN status <> 'kept' THEN status ELSE 'kept_without_label' END AS reason, count(*) AS n FROM v2c WHERE NOT (status = 'kept' AND label IS NOT NULL) GROUP BY ALL")
def q_export_exclusions(spark, sf_dir, near=False):
    return export.exclusions(second(spark, sf_dir, near))


@query(f"WITH {_SCRUB} SELECT doc_id FROM scrubbed WHERE {_LEAK} ORDER BY doc_id LIMIT 20")
def q_export_leaks(spark, sf_dir):
    rows = spans(spark, sf_dir).select("doc_id", T.scrub(F.col("text"), F.col("spans"))["text"].alias("body"))
    return export.leaks(rows)


# Ledger

@query(f"WITH {RUNS} SELECT stage, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(usd) AS BIGINT) AS usd FROM runs GROUP BY stage")
def q_cost_by_stage(spark, sf_dir):
    costs = demo.costs(spark, sf_dir)
    return ledger.by_stage(costs.drop("stage", "status"), costs.select("run_id", "stage").distinct())


_SPENT = RUNS.replace("runs AS", "runs0 AS") + ", spent AS (SELECT call_id, run_id, usd, CAST(coalesce(sum(usd) OVER (PARTITION BY run_id ORDER BY ts, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent_before FROM runs0)"


@query(f"WITH {_SPENT} SELECT * FROM spent")
def q_running_spend(spark, sf_dir):
    return ledger.running(demo.costs(spark, sf_dir), ["run_id"]).select("call_id", "run_id", "usd", "spent_before")


@query(f"WITH {_SPENT} SELECT call_id, run_id FROM spent WHERE spent_before + usd > 20000")
def q_cost_cap_violations(spark, sf_dir):
    return ledger.over_cap(demo.costs(spark, sf_dir), ["run_id"], 20000).select("call_id", "run_id")


@query(f"WITH {RUNS} SELECT stage, run_id, call_id FROM runs WHERE status = 'ok' QUALIFY row_number() OVER (PARTITION BY stage ORDER BY ts DESC, call_id DESC) = 1")
def q_latest_run_per_stage(spark, sf_dir):
    rows = demo.runs(spark, sf_dir).select("stage", F.col("run_id").alias("run"), F.col("call_id").alias("run_id"), F.col("ts").alias("started_at"), "status")
    return ledger.latest_runs(rows).select("stage", F.col("run").alias("run_id"), F.col("run_id").alias("call_id"))


@query(f"WITH {RUNS} SELECT run_id, arg_max(status, struct_pack(t := ts, s := status)) AS status, CAST(sum(usd) AS BIGINT) AS usd FROM runs GROUP BY run_id")
def q_run_states(spark, sf_dir):
    return ledger.run_states(demo.costs(spark, sf_dir)).select("run_id", "status", "usd")


@query("""WITH old AS (SELECT doc_id, lang, 0 AS v FROM documents WHERE doc_id % 2 = 0), new AS (SELECT doc_id, source AS lang, 1 AS v FROM documents WHERE doc_id % 3 = 0)
SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new""")
def q_upsert_by_key(spark, sf_dir):
    docs = demo.table(spark, sf_dir, "documents")
    return tables.upsert(docs.where("doc_id % 2 = 0").select("doc_id", "lang", F.lit(0).alias("v")), docs.where("doc_id % 3 = 0").select("doc_id", F.col("source").alias("lang"), F.lit(1).alias("v")), ["doc_id"])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q_keep_last_by_key(spark, sf_dir):
    return tables.keep_last(demo.table(spark, sf_dir, "events"), ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type")


# Taxonomy, planting and sets

_TAX = [(1, "d1", "alpha", "a", 2, 1, 2), (1, "d1", "Beta x", "", 1, 0, 1), (2, "d2", "gamma", "c", 2, 1, 2), (2, "d2", "gamma", "c", 3, 1, 2), (3, "d3", "delta", "d", 2, 1, 0), (4, "d3", "rho", "e", 2, 1, 2), (4, "d3", "sigma", "f", 2, 1, 2), (5, "d5", "tau", "g", 2, 1, 2)]
_TAX_SQL = ", ".join(repr(x) for x in _TAX)


@query(f"""WITH t(domain_no, domain, name, definition, n_inclusion, n_exclusion, n_examples) AS (VALUES {_TAX_SQL})
SELECT 'taxonomy' AS subject, 'domain count' AS problem FROM t HAVING count(DISTINCT domain_no) NOT BETWEEN 2 AND 4 UNION ALL SELECT 'taxonomy', 'leaf count' FROM t HAVING count(*) NOT BETWEEN 8 AND 14
UNION ALL SELECT name, 'repeated leaf name' FROM t GROUP BY name HAVING count(*) > 1 UNION ALL SELECT domain, 'repeated domain name' FROM t GROUP BY domain HAVING count(DISTINCT domain_no) > 1 UNION ALL SELECT domain, 'too few leaves' FROM t GROUP BY domain_no, domain HAVING count(*) < 2
UNION ALL SELECT name, 'empty definition' FROM t WHERE trim(definition) = '' UNION ALL SELECT name, 'too few inclusion criteria' FROM t WHERE n_inclusion < 2 UNION ALL SELECT name, 'no exclusion criteria' FROM t WHERE n_exclusion < 1
UNION ALL SELECT name, 'too few boundary examples' FROM t WHERE n_examples < 2 UNION ALL SELECT name, 'not snake case' FROM t WHERE name <> lower(name) OR instr(name, ' ') > 0""")
def q_taxonomy_problems(spark, sf_dir):
    return taxonomy.problems(spark.createDataFrame(_TAX, "domain_no int, domain string, name string, definition string, n_inclusion int, n_exclusion int, n_examples int"))


@query("""WITH s AS (SELECT doc_id FROM documents ORDER BY md5(concat('5|', doc_id)), doc_id LIMIT 120), a AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'unmappable' WHEN doc_id % 13 = 0 THEN 'zz' ELSE lang END AS leaf FROM documents WHERE doc_id % 17 <> 0), c AS (
  SELECT count(*) AS n, count(*) FILTER (leaf IS NULL) AS missing, count(*) FILTER (leaf NOT IN ('de', 'en', 'es', 'fr', 'unmappable')) AS unknown, count(*) FILTER (leaf = 'unmappable') AS unmappable FROM s LEFT JOIN a USING (doc_id))
SELECT *, unmappable::DOUBLE / greatest(1, n) AS rate, missing = 0 AND unknown = 0 AND unmappable::DOUBLE / greatest(1, n) <= 0.05 AS ok FROM c""")
def q_coverage_check(spark, sf_dir):
    docs = demo.table(spark, sf_dir, "documents")
    given = docs.where("doc_id % 17 <> 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, "unmappable").when(F.col("doc_id") % 13 == 0, "zz").otherwise(F.col("lang")).alias("leaf"))
    return taxonomy.coverage(taxonomy.sample(docs.select("doc_id"), 120, 5), given, LEAVES)


_PLANT = "p0 AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('3|', doc_id)), doc_id) AS i FROM documents), planted AS (SELECT doc_id, CASE WHEN i <= 30 THEN 'ambiguous' WHEN i <= 66 THEN 'duplicate' WHEN i <= 91 THEN 'pii' WHEN i <= 103 THEN 'multilingual' ELSE 'error' END AS kind FROM p0 WHERE i <= 143)"


@query(f"WITH {_PLANT} SELECT * FROM planted")
def q_planted_sets(spark, sf_dir):
    return taxonomy.plant(demo.table(spark, sf_dir, "documents"), demo.PLANTED, 3)


@query(f"WITH {_PLANT} SELECT 'size of ' || kind AS name, count(*) = CASE kind WHEN 'ambiguous' THEN 30 WHEN 'duplicate' THEN 36 WHEN 'pii' THEN 25 WHEN 'multilingual' THEN 12 ELSE 40 END AS ok FROM planted GROUP BY kind UNION ALL SELECT 'disjoint', true")
def q_seed_checks(spark, sf_dir):
    return taxonomy.planting_checks(q_planted_sets(spark, sf_dir), demo.PLANTED)


@query("SELECT doc_id, CASE WHEN x < 50 THEN 'alpha' WHEN x < 80 THEN 'beta' ELSE 'gamma' END AS kind FROM (SELECT doc_id, CAST(concat('0x', substr(md5(concat('37|', doc_id)), 1, 4)) AS INTEGER) % 100 AS x FROM documents)")
def q_weighted_draw(spark, sf_dir):
    return demo.table(spark, sf_dir, "documents").select("doc_id", taxonomy.draw(demo.number(37), {"alpha": 50, "beta": 30, "gamma": 20}).alias("kind"))


@query(f"WITH {_SUSPECT} SELECT doc_id FROM base WHERE vendor <> truth INTERSECT SELECT doc_id FROM suspected")
def q_set_planted_intersect_flagged(spark, sf_dir):
    rows = demo.rows(spark, sf_dir)
    return rows.where("vendor <> truth").select("doc_id").join(quality.suspected(rows).select("doc_id"), "doc_id", "left_semi")


@query(f"WITH {_ROUTED} SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM routed")
def q_set_unflagged(spark, sf_dir, near=False):
    return demo.table(spark, sf_dir, "documents").select("doc_id").join(routed(spark, sf_dir, near), "doc_id", "left_anti")


@query("WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, n, value AS p99 FROM s WHERE i = greatest(0, n * 99 // 100 - 1)")
def q_p99_by_place(spark, sf_dir):
    return ledger.nth_of(demo.table(spark, sf_dir, "events"), ["event_type"], "value", lambda n: F.greatest(F.lit(0), F.floor(n * 99 / 100) - 1), "p99")


@query("SELECT doc_id, doc_id // 10 AS batch FROM documents")
def q_batches_of_ten(spark, sf_dir):
    ranked = global_rank(demo.table(spark, sf_dir, "documents").select("doc_id"), [F.asc("doc_id")], "n")
    return ranked.select("doc_id", F.floor((F.col("n") - 1) / 10).alias("batch"))


@query(f"""WITH {BASE}, x AS (SELECT doc_id, doc_id AS ordinal, ['accept_llm', 'accept_vendor', 'accept_heuristic', 'other_leaf', 'skip', 'nonsense'][1 + doc_id % 6] AS decision, CASE WHEN doc_id % 4 = 1 THEN 'en' END AS leaf FROM documents)
SELECT x.doc_id, ordinal, decision, CASE decision WHEN 'accept_llm' THEN a_label WHEN 'accept_vendor' THEN vendor WHEN 'accept_heuristic' THEN b_label WHEN 'other_leaf' THEN leaf END AS final_label
FROM x JOIN base USING (doc_id) WHERE decision <> 'nonsense' AND (decision <> 'other_leaf' OR leaf IS NOT NULL)""")
def q_batch_adjudication(spark, sf_dir):
    actions = ["accept_llm", "accept_vendor", "accept_heuristic", "other_leaf", "skip", "nonsense"]
    answers = demo.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("ordinal"), F.array(*map(F.lit, actions))[(F.col("doc_id") % 6).cast("int")].alias("decision"), F.when(F.col("doc_id") % 4 == 1, "en").alias("leaf"), F.lit(1.0).alias("seconds"))
    return review.adjudicate(answers, demo.rows(spark, sf_dir)).drop("seconds")


_CLASS = "CASE " + " ".join(f"WHEN x < {sum(list(generate.CLASSES.values())[: i + 1])} THEN '{k}'" for i, k in enumerate(generate.CLASSES)) + " END"


# A duplicate has the class of the ticket that it paraphrases: the places of both in the planted order are the number of canonical ones apart.
@query(f"""WITH p AS (SELECT i, row_number() OVER (ORDER BY md5(concat('11|', i)), i) AS place FROM range(600) t(i)), o AS (SELECT coalesce(c.i, d.i) AS i FROM p d LEFT JOIN p c ON d.place BETWEEN 49 AND 66 AND c.place = d.place - 18)
SELECT 'class ' || {_CLASS} AS name, count(*) AS n FROM (SELECT CAST(concat('0x', substr(md5(concat('11|class', i)), 1, 4)) AS INTEGER) % 100 AS x FROM o) GROUP BY name
UNION ALL SELECT * FROM (VALUES ('kind ambiguous', 30), ('kind canonical', 18), ('kind duplicate', 18), ('kind pii', 25), ('kind multilingual', 12), ('kind error', 40))""")
def q_generated_manifest(spark, sf_dir):
    return generate.manifest(generate.tickets(spark, 600, 11))


_CHECKS = ["size", "numbers", *[f"planted {k}" for k in generate.COUNTS if k not in ("canonical", "duplicate")], "errors are wrong", "errors are plausible", "no other errors", "ambiguous tickets have an alternate", "alternates differ",
           "no other alternates", "personal data has spans", "spans are on the spot", "no other spans", "scripts are mixed", "no other mixed scripts", "planted pairs", "pairs have two members", "pairs have one original",
           "pairs share a class", "pairs are near duplicates", "pairs stand out", "planted sets are apart"]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', true)" for c in _CHECKS) + ") t(name, ok)")
def q_generated_checks(spark, sf_dir):
    return generate.checks(generate.tickets(spark, 600, 11), 600, seed=11).select("name", "ok")


@query("SELECT count(*) AS rows, max(n_chars) AS longest, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents")
def q_table_metrics(spark, sf_dir):
    return demo.table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("rows"), F.max("n_chars").alias("longest"), F.sum("n_chars").alias("chars"))


@query(f"WITH {BASE} SELECT doc_id, label FROM (SELECT doc_id, a_label AS label, 1 AS p FROM base WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, b_label, 2 FROM base) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC) = 1")
def q_latest_label_per_document(spark, sf_dir):
    rows = demo.rows(spark, sf_dir)
    both = rows.where("doc_id % 2 = 0").select("doc_id", F.col("a_label").alias("label"), F.lit(1).alias("p")).unionByName(rows.select("doc_id", F.col("b_label").alias("label"), F.lit(2).alias("p")))
    return tables.keep_last(both, ["doc_id"], F.col("p")).drop("p")


@query(f"WITH {BASE} SELECT DISTINCT vendor, len(leaves) = 0 AS uncovered FROM base")
def q_vendor_labels(spark, sf_dir):
    return demo.rows(spark, sf_dir).select("vendor", (F.size("leaves") == 0).alias("uncovered")).distinct()


# Labels and runs

@query(f"WITH {demo.LABELED}, newest AS (SELECT source, arg_max(run_id, struct_pack(t := started_at, r := run_id)) AS run_id FROM label_runs WHERE status = 'ok' AND run_id IN (SELECT run_id FROM run_labels) GROUP BY source) SELECT doc_id, source, run_id, label FROM run_labels JOIN newest USING (source, run_id)")
def q_latest_labels(spark, sf_dir):
    return tables.latest_labels(demo.run_labels(spark, sf_dir), demo.label_runs(spark, sf_dir)).select("doc_id", "source", "run_id", "label")


@query(f"WITH {BASE} SELECT doc_id, label, abstain FROM (SELECT d.doc_id, a_label AS label, a_abstain AS abstain FROM documents d JOIN base USING (doc_id)) WHERE NOT abstain AND doc_id IN (SELECT doc_id FROM labels)")
def q_labels_within_subset(spark, sf_dir):
    rows = demo.rows(spark, sf_dir).where("NOT a_abstain").select("doc_id", F.col("a_label").alias("label"), F.col("a_abstain").alias("abstain"))
    return rows.join(demo.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


# Flags with what they say, and review

_SPANS_JSON = "SELECT doc_id, CAST(to_json({spans: list(struct_pack(type := type, value := value, start := start, \"end\" := \"end\") ORDER BY start, o)}) AS VARCHAR) AS detail FROM pii GROUP BY doc_id"
_DETAIL = "CAST(to_json({vendor_leaves: vendor_leaves, proposed: proposed, confidence: confidence, route: route}) AS VARCHAR)"
_FLAGS = _ROUTED + ", " + _PII + f""", flags AS (
  SELECT doc_id, 'suspected_label_error' AS flag_type, CAST(row_number() OVER (ORDER BY confidence DESC, doc_id) AS INTEGER) AS rank, {_DETAIL} AS detail FROM suspected WHERE proposed IN ('en', 'fr', 'de')
  UNION ALL SELECT doc_id, 'taxonomy_granularity', CAST(row_number() OVER (ORDER BY confidence DESC, doc_id) AS INTEGER), {_DETAIL} FROM suspected WHERE proposed NOT IN ('en', 'fr', 'de')
  UNION ALL SELECT doc_id, 'ambiguity', CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER), CAST(to_json({{reasons: reasons}}) AS VARCHAR) FROM ambiguous
  UNION ALL SELECT doc_id, 'duplicate', CAST(dense_rank() OVER (ORDER BY component) AS INTEGER), CAST(to_json({{component: component}}) AS VARCHAR) FROM (SELECT doc_id, min(doc_id) OVER w AS component, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY md5(text))) WHERE n > 1
  UNION ALL SELECT doc_id, 'pii', NULL, detail FROM ({_SPANS_JSON})
)"""


def all_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five kinds of findings with rank and detail; every member of a group of equal texts is flagged."""
    rows = demo.rows(spark, sf_dir)
    suspected, granularity = quality.split_by_reach(quality.suspected(rows), REACHED)
    groups = firsts_of(texts(spark, sf_dir))
    several = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    places = global_rank(several.select("component"), [F.asc("component")], "rank")
    what = ("vendor_leaves", "proposed", "confidence", "route")
    found = spans(spark, sf_dir).where(F.size("spans") > 0).select("doc_id", "spans")
    return quality.flags({
        "suspected_label_error": quality.detailed(suspected, *what), "taxonomy_granularity": quality.detailed(granularity, *what), "ambiguity": quality.detailed(global_rank(quality.ambiguous(rows), [F.asc("doc_id")], "rank"), "reasons"),
        "duplicate": quality.detailed(groups.join(places, "component"), "component"), "pii": quality.detailed(found, "spans")}, routed(spark, sf_dir))


@query(f"WITH {_FLAGS} SELECT f.doc_id, flag_type, rank, detail, coalesce(reason = flag_type, false) AS routed FROM flags f LEFT JOIN routed r USING (doc_id)")
def q_flags_with_detail(spark, sf_dir):
    return all_flags(spark, sf_dir)


@query(f"WITH {_FLAGS} SELECT flag_type, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, flag_type) AS INTEGER) AS place FROM flags WHERE flag_type IN ('pii', 'ambiguity', 'duplicate') GROUP BY flag_type")
def q_flag_ranking(spark, sf_dir):
    found = all_flags(spark, sf_dir).where(F.col("flag_type").isin("pii", "ambiguity", "duplicate")).groupBy("flag_type").agg(F.count(F.lit(1)).alias("n"))
    return global_rank(found, [F.desc("n"), F.asc("flag_type")], "place")


@query(f"WITH {_SUSPECT} SELECT *, CAST(row_number() OVER (ORDER BY confidence DESC, doc_id) AS INTEGER) AS rank FROM suspected WHERE proposed IN ('en', 'fr', 'de') ORDER BY rank LIMIT 10")
def q_top_suspected(spark, sf_dir):
    found = quality.suspected(demo.rows(spark, sf_dir)).where(F.col("proposed").isin(*REACHED)).orderBy(F.desc("confidence"), "doc_id").limit(10)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("confidence"), "doc_id")))


@query(f"""WITH {_FLAGS}, q AS (SELECT doc_id, reason FROM routed)
SELECT q.doc_id, q.reason, split_part(d.text, chr(10), 1) AS subject, d.source AS channel, vendor, a_label, CASE WHEN NOT a_abstain THEN a_conf END AS a_confidence, b_label, f.flags
FROM q JOIN documents d USING (doc_id) JOIN base USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(flag_type, '|' ORDER BY flag_type) AS flags FROM flags GROUP BY doc_id) f USING (doc_id)""")
def q_review_screens(spark, sf_dir):
    rows = demo.rows(spark, sf_dir)
    label = lambda s, c, conf: rows.select("doc_id", F.lit(s).alias("source"), F.col(c).alias("label"), conf.alias("confidence"), F.lit(None).cast("string").alias("rationale"))
    labels = label("a", "a_label", F.when(~F.col("a_abstain"), F.col("a_conf"))).unionByName(label("b", "b_label", F.lit(None).cast("double")))
    tickets = demo.tickets(spark, sf_dir).select("doc_id", "subject", "channel").join(rows.select("doc_id", "vendor"), "doc_id")
    screens = review.screens(routed(spark, sf_dir), tickets, labels, all_flags(spark, sf_dir))
    return screens.select("doc_id", "reason", "subject", "channel", "vendor", "a_label", "a_confidence", "b_label", F.array_join("flags.flag_type", "|").alias("flags"))


@query(f"WITH {LOG} SELECT count(*) AS decisions, count(DISTINCT doc_id) AS documents, max(ordinal) AS last FROM log")
def q_review_progress(spark, sf_dir):
    return review.progress(demo.log(spark, sf_dir))


# Scores after review, and sets

_BOTH = _V2 + _SUSPECT.removeprefix(BASE)


@query(f"""WITH {_BOTH}, x AS (SELECT vendor <> truth AS planted, s.doc_id IS NOT NULL AS flagged, coalesce(v.label = truth, false) AS corrected FROM base JOIN v2c v USING (doc_id) LEFT JOIN suspected s USING (doc_id)),
  c AS (SELECT count(*) FILTER (planted) AS planted, count(*) FILTER (planted AND flagged) AS flagged, count(*) FILTER (planted AND flagged AND corrected) AS corrected FROM x)
SELECT planted, flagged, coalesce(flagged::DOUBLE / nullif(planted, 0), 0) AS recall, corrected, coalesce(corrected::DOUBLE / nullif(flagged, 0), 0) AS correction_rate FROM c""")
def q_seeded_error_correction(spark, sf_dir):
    rows = demo.rows(spark, sf_dir)
    found = quality.suspected(rows).select("doc_id", F.lit(True).alias("f"))
    both = rows.join(second(spark, sf_dir).select("doc_id", "label"), "doc_id").join(found, "doc_id", "left")
    return evaluate.seeded_errors(both, F.col("vendor") != F.col("truth"), F.coalesce("f", F.lit(False)), F.coalesce(F.col("label") == F.col("truth"), F.lit(False)))


@query(f"WITH {BASE}, reached AS (SELECT DISTINCT unnest(leaves) AS leaf FROM base) SELECT count(*) AS n, count(*) FILTER (truth NOT IN (SELECT leaf FROM reached)) AS unreachable FROM base")
def q_unreachable_truth(spark, sf_dir):
    rows = demo.rows(spark, sf_dir)
    reached = {r["leaf"] for r in rows.select(F.explode("leaves").alias("leaf")).distinct().collect()}  # at most as many as there are leaves
    return evaluate.unreachable(rows, [x for x in LEAVES if x not in reached])


@query(f"""WITH {_V2}, r AS (SELECT v2c.*, truth FROM v2c JOIN base USING (doc_id))
SELECT 100 * ((SELECT count(*) FILTER (label = truth OR alt_label = truth)::DOUBLE / nullif(count(*), 0) FROM r WHERE status <> 'merged_duplicate') - (SELECT count(*) FILTER (before = truth)::DOUBLE / nullif(count(*), 0) FROM r)) AS delta_points""")
def q_accuracy_delta(spark, sf_dir):
    return evaluate.delta_points(q_eval_accuracy(spark, sf_dir))


_GATE_VALUES = " UNION ALL ".join(f"SELECT '{name}' AS name, (SELECT {value} FROM ({_SQL[of]}))::DOUBLE AS value" for name, of, value in (
    ("delta_points", "accuracy_delta", "delta_points"), ("seeded_recall", "seeded_error_recall", "recall"), ("leaks", "pii_leaks_after_scrub", "coalesce(after, 0)"), ("duplicate_recall", "duplicate_recall", "recall")))
_BOUNDS = " ".join(f"WHEN '{k}' THEN {v}" for k, (_, v) in evaluate.GATES.items())
_LEAST = ", ".join(f"'{k}'" for k, (op, _) in evaluate.GATES.items() if op == ">=")


@query(f"""WITH m AS ({_GATE_VALUES} UNION ALL SELECT 'cost_usd', (WITH {RUNS} SELECT coalesce(sum(usd), 0)::DOUBLE / 1000000 FROM runs)), x AS (SELECT *, CASE name {_BOUNDS} END::DOUBLE AS bound FROM m)
SELECT name, value, bound, CASE WHEN value IS NULL THEN 'not evaluable' WHEN CASE WHEN name IN ({_LEAST}) THEN value >= bound ELSE value <= bound END THEN 'pass' ELSE 'FAIL' END AS result FROM x""")
def q_release_gates(spark, sf_dir):
    return evaluate.gates(gate_values(spark, sf_dir, near=False))


@query(f"WITH {BASE} SELECT doc_id FROM base WHERE a_abstain INTERSECT SELECT doc_id FROM base WHERE doc_id % 9 = 0")
def q_set_abstained_ambiguous(spark, sf_dir):
    rows = demo.rows(spark, sf_dir)
    return rows.where("a_abstain").select("doc_id").intersect(rows.where("doc_id % 9 = 0").select("doc_id"))


@query(f"WITH {BASE} SELECT DISTINCT truth AS leaf FROM base EXCEPT SELECT unnest(leaves) FROM base")
def q_leaves_unreached(spark, sf_dir):
    rows = demo.rows(spark, sf_dir)
    return rows.select(F.col("truth").alias("leaf")).distinct().exceptAll(rows.select(F.explode("leaves").alias("leaf")).distinct())


@query("SELECT list_sort(list(doc_id)) AS members FROM documents GROUP BY md5(text) HAVING count(*) BETWEEN 2 AND 50")
def q_small_copy_groups(spark, sf_dir):
    """Groups of 2 to 50 equal texts as arrays of their documents, once each; larger groups are counted, but not gathered."""
    groups = firsts_of(texts(spark, sf_dir))
    some = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n BETWEEN 2 AND 50")
    return groups.join(some.select("component"), "component").groupBy("component").agg(F.sort_array(F.collect_list("doc_id")).alias("members")).select("members").distinct()


@query("SELECT doc_id, component, CAST(dense_rank() OVER (ORDER BY component) AS INTEGER) AS rank FROM (SELECT doc_id, min(doc_id) OVER w AS component, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY md5(text))) WHERE n > 1")
def q_cluster_ranks(spark, sf_dir):
    groups = firsts_of(texts(spark, sf_dir))
    several = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return groups.join(global_rank(several, [F.asc("component")], "rank"), "component").select("doc_id", "component", "rank")


@query("SELECT shape, n, CAST(row_number() OVER (ORDER BY shape) AS INTEGER) AS number FROM (SELECT md5(split_part(text, chr(10), 1)) AS shape, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)")
def q_shape_groups(spark, sf_dir):
    lines = demo.tickets(spark, sf_dir).where("body IS NOT NULL").groupBy(F.md5("subject").alias("shape")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return global_rank(lines, [F.asc("shape")], "number")


# Prompts and calls

_SAMPLE = "SELECT doc_id, split_part(text, chr(10), 1) AS subject, substr(text, 1, 420) AS body FROM documents ORDER BY md5(concat('8|', doc_id)), doc_id LIMIT 120"


@query(f"SELECT doc_id, md5(subject) AS subject_md5, md5(body) AS body_md5 FROM ({_SAMPLE})")
def q_blind_sample(spark, sf_dir):
    return induction.blind_sample(demo.tickets(spark, sf_dir), 120, 8).select("doc_id", F.md5("subject").alias("subject_md5"), F.md5("body").alias("body_md5"))


@query(f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS batch FROM ({_SAMPLE}))
SELECT (batch - 1) // 10 AS batch, md5(string_agg('[' || doc_id || ']' || chr(10) || 'Subject: ' || coalesce(subject, '') || chr(10) || coalesce(body, ''), chr(10) || chr(10) ORDER BY doc_id)) AS prompt_md5 FROM s GROUP BY 1""")
def q_ticket_prompts(spark, sf_dir):
    sample = global_rank(induction.blind_sample(demo.tickets(spark, sf_dir), 120, 8), [F.asc("doc_id")], "batch")
    return induction.prompts(sample, 10).select("batch", F.md5("prompt").alias("prompt_md5"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(text, ', ', ' \u2014 '), ' \u2014 ', ', '), '\u2014', ', '), ' \u2013 ', ', '), '\u2013', ', ')) AS prose_md5 FROM documents")
def q_plain_dashes(spark, sf_dir):
    dashed = F.replace(F.col("text"), F.lit(", "), F.lit(" \u2014 "))
    return texts(spark, sf_dir).select("doc_id", F.md5(T.plain_dashes(dashed)).alias("prose_md5"))


@query(f"""WITH {BASE}, m AS (SELECT vendor, arg_max(truth, doc_id) AS t FROM base WHERE vendor <> 'es' GROUP BY vendor), x AS (SELECT vendor, list_filter([t, 'none', 'en'], lambda l: l IN ('de', 'en', 'es', 'fr')) AS leaves, 'as ' || t AS reasoning FROM m)
SELECT v.vendor, array_to_string(coalesce(leaves, []), '|') AS leaves, coalesce(reasoning, '') AS reasoning FROM (SELECT DISTINCT vendor FROM base) v LEFT JOIN x USING (vendor)""")
def q_alignment_cleanup(spark, sf_dir):
    rows = demo.rows(spark, sf_dir)
    given = rows.where("vendor <> 'es'").select("vendor", F.array(F.concat(F.lit(" "), "truth", F.lit(" ")), F.lit("none"), F.lit("en")).alias("leaves"), F.concat(F.lit("as "), "truth").alias("reasoning"), F.col("doc_id").alias("ordinal"))
    return induction.alignment(rows.select("vendor"), given, LEAVES).select("vendor", F.array_join("leaves", "|").alias("leaves"), "reasoning")


@query("SELECT doc_id, sha256('{\"model\":\"' || lang || '\",\"schema\":null,\"system\":\"s\",\"user\":\"' || doc_id || '\",\"v\":\"1\"}') AS cache_key FROM documents")
def q_call_keys(spark, sf_dir):
    return demo.table(spark, sf_dir, "documents").select("doc_id", model.call_key(F.col("lang"), F.lit("s"), F.col("doc_id").cast("string")).alias("cache_key"))


_PRICED = RUNS + """, priced AS (SELECT *, ['small-1', 'medium', 'large-b', 'unheard'][1 + call_id % 4] AS model FROM runs), prices AS (SELECT *, CASE WHEN model LIKE 'small%' THEN 1.0 WHEN model LIKE 'medium%' THEN 2.0 WHEN model LIKE 'large%' THEN 5.0 ELSE 1.0 END::DOUBLE AS i, CASE WHEN model LIKE 'medium%' THEN 10.0 WHEN model LIKE 'large%' THEN 25.0 ELSE 5.0 END::DOUBLE AS o FROM priced)"""


@query(f"WITH {_PRICED} SELECT model, count(*) AS calls, round(sum((tokens_in * i + tokens_out * 1.25 * i + tokens_in * 0.1 * i + tokens_out * o) / 1000000), 4) AS usd FROM prices GROUP BY model")
def q_call_costs(spark, sf_dir):
    names = F.array(*map(F.lit, ("small-1", "medium", "large-b", "unheard")))
    calls = demo.runs(spark, sf_dir).withColumn("model", names[(F.col("call_id") % 4).cast("int")])
    cost = model.usd(F.col("model"), F.col("tokens_in"), F.col("tokens_out"), F.col("tokens_out"), F.col("tokens_in"))
    return calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(cost), 4).alias("usd"))


@query(f"WITH {RUNS} SELECT CAST(coalesce(sum(usd), 0) AS BIGINT) AS usd, count(*) AS calls FROM runs")
def q_total_spend(spark, sf_dir):
    return demo.costs(spark, sf_dir).agg(F.coalesce(F.sum("usd"), F.lit(0)).alias("usd"), F.count(F.lit(1)).alias("calls"))


@query(f"""WITH {_V2}, u AS (SELECT doc_id, label, alt_label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('20260904|', doc_id)), doc_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM v2c WHERE status = 'kept' AND label IS NOT NULL)
SELECT u.doc_id, source AS channel, lang AS customer_tier, n_chars AS created_at, label, alt_label AS acceptable_alt_label, CASE WHEN i <= greatest(1, CAST(round_even(n * 0.85::DOUBLE, 0) AS BIGINT)) THEN 'train' ELSE 'eval' END AS split FROM u JOIN documents USING (doc_id)""")
def q_export_records(spark, sf_dir):
    rows = export.split(export.usable(second(spark, sf_dir)).select("doc_id", "label", "alt_label", "body"))
    tickets = demo.table(spark, sf_dir, "documents").select("doc_id", T.first_line(F.col("text")).alias("subject"), F.col("source").alias("channel"), F.col("lang").alias("tier"), F.col("n_chars").alias("created_at"))
    return export.records(rows, tickets).drop("subject", "body")


# Near duplicates in place of exact copies: near_NAME is NAME over the clusters of near_dup_clusters, of which review gets the contested ones. SQL has no token-set ratio.

for _f in (q_routing, q_routed_by_reason, q_queue_ratio, q_review_queue_pending, q_set_unflagged, q_dataset_v2, q_v1_v2_diff, q_diff_summary, q_eval_accuracy, q_export_split, q_export_exclusions):
    _QUERIES[f"near_{_f.__name__.removeprefix('q_')}"] = partial(_f, near=True)
