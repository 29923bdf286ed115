"""Structure and coverage checks of a taxonomy, and seeded planting of defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T

DOMAINS, LEAVES, PER_DOMAIN, EXAMPLES, INCLUSIONS, UNMAPPABLE = (2, 4), (8, 14), 2, 2, 2, 0.05


def problems(leaves: DataFrame, domains: tuple[int, int] = DOMAINS, n_leaves: tuple[int, int] = LEAVES) -> DataFrame:
    """subject and problem for everything wrong with leaves (domain_no, domain, name, definition, n_inclusion, n_exclusion, n_examples)."""
    total = leaves.agg(F.count_distinct("domain_no").alias("d"), F.count(F.lit(1)).alias("n"))
    counts = total.select(F.explode(F.array_compact(F.array(
        F.when(~F.col("d").between(*domains), F.struct(F.lit("taxonomy").alias("subject"), F.lit("domain count").alias("problem"))),
        F.when(~F.col("n").between(*n_leaves), F.struct(F.lit("taxonomy").alias("subject"), F.lit("leaf count").alias("problem")))))).alias("x")).select("x.*")
    repeated = leaves.groupBy(F.col("name").alias("subject")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("subject", F.lit("repeated leaf name").alias("problem"))
    named_twice = leaves.groupBy(F.col("domain").alias("subject")).agg(F.count_distinct("domain_no").alias("n")).where("n > 1").select("subject", F.lit("repeated domain name").alias("problem"))
    small = leaves.groupBy("domain_no", F.col("domain").alias("subject")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < PER_DOMAIN).select("subject", F.lit("too few leaves").alias("problem"))
    checks: dict[str, Column] = {
        "empty definition": F.trim(F.coalesce("definition", F.lit(""))) == "", "too few inclusion criteria": F.col("n_inclusion") < INCLUSIONS, "no exclusion criteria": F.col("n_exclusion") < 1,
        "too few boundary examples": F.col("n_examples") < EXAMPLES, "not snake case": ~T.is_snake_case(F.col("name"))}
    own = leaves.select(F.col("name").alias("subject"), F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in checks.items()]))).alias("problem"))
    return counts.unionByName(repeated).unionByName(named_twice).unionByName(small).unionByName(own)


def coverage(sample: DataFrame, assignments: DataFrame, leaves: list[str], none: str = "unmappable") -> DataFrame:
    """Of a sample (doc_id): how many have no assignment (doc_id, leaf), use unknown leaves or none, and whether that is too many."""
    rows = sample.select("doc_id").join(assignments, "doc_id", "left")
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), total(F.col("leaf").isNull()).alias("missing"), total(~F.col("leaf").isin(*leaves, none)).alias("unknown"), total(F.col("leaf") == none).alias("unmappable"))
    rate = F.col("unmappable") / F.greatest(F.lit(1), F.col("n"))
    return sums.select("*", rate.alias("rate"), ((F.col("missing") == 0) & (F.col("unknown") == 0) & (rate <= UNMAPPABLE)).alias("ok"))


def seeded(seed: int | str, salt: str = "") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|{salt}"), F.col("doc_id").cast("string")))


def plant(docs: DataFrame, counts: dict[str, int], seed: int, place_in_kind: bool = False) -> DataFrame:
    """doc_id and kind: disjoint sets of exact sizes, in seeded order; and each one's place in its kind, if asked for.

    Only the chosen rows (the sum of counts) are sorted and kept.
    """
    chosen = docs.select("doc_id", seeded(seed).alias("_h")).orderBy("_h", "doc_id").limit(sum(counts.values()))
    place = F.row_number().over(Window.orderBy("_h", "doc_id"))
    kind, before, at = F.when(F.lit(False), ""), F.when(F.lit(False), 0), 0
    for k, n in counts.items():
        at += n
        kind, before = kind.when(F.col("_i") <= at, k), before.when(F.col("_i") <= at, at - n)
    return chosen.withColumn("_i", place).select("doc_id", kind.alias("kind"), *([(F.col("_i") - before).alias("place")] if place_in_kind else []))


def planting_checks(planted: DataFrame, counts: dict[str, int]) -> DataFrame:
    """name, ok: every set has its size, and no document is in two."""
    sizes = planted.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    want = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(n))])
    sized = sizes.select(F.concat(F.lit("size of "), "kind").alias("name"), (F.col("n") == want[F.col("kind")]).alias("ok"))
    twice = planted.groupBy("doc_id").agg(F.count_distinct("kind").alias("k")).agg(F.coalesce(F.max("k"), F.lit(0)).alias("k")).select(F.lit("disjoint").alias("name"), (F.col("k") <= 1).alias("ok"))
    return sized.unionByName(twice)


def sample(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """n documents in seeded order."""
    return docs.orderBy(seeded(seed), "doc_id").limit(n)


def draw(value: Column, weights: dict[str, int]) -> Column:
    """A key of weights by a whole number, each as likely as its weight."""
    out, at = F.when(F.lit(False), ""), 0
    for k, w in weights.items():
        at += w
        out = out.when(value % sum(weights.values()) < at, k)
    return out
