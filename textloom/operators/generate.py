"""Seeded tickets with planted defects, from hashes of their numbers: any row can be made again by itself, on any executor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators import similarity, taxonomy

CLASSES = {"access": 18, "billing": 22, "delivery": 14, "hardware": 16, "network": 20, "other": 10}
CONFUSED = {"access": "network", "billing": "delivery", "delivery": "billing", "hardware": "network", "network": "hardware", "other": "access"}
COUNTS = {"ambiguous": 30, "canonical": 18, "duplicate": 18, "pii": 25, "multilingual": 12, "error": 40}
#: Of each class, subjects and the sentences that bodies with these subjects begin with.
SHAPES = {
    "access": [("cannot sign in to {thing}", "My password for {thing} is refused since {day}."), ("locked out of {thing}", "After {count} attempts {thing} shut me out on {day}.")],
    "billing": [("charged twice for {thing}", "The statement lists {thing} {count} times although we ordered it once."), ("wrong total for {thing}", "Our invoice for {thing} is {count} percent above the offer of {day}.")],
    "delivery": [("{thing} has not arrived", "The courier promised {thing} for {day} and nobody came."), ("{thing} went to an old address", "A neighbour {count} streets away signed for {thing} on {day}.")],
    "hardware": [("{thing} does not switch on", "The lamp of {thing} blinks {count} times and then stays dark."), ("{thing} makes a noise", "Since {day} {thing} hums louder than the {count} others in the room.")],
    "network": [("{thing} drops its connection", "Every {count} minutes {thing} loses the link to the office."), ("slow uploads from {thing}", "Sending a file from {thing} has taken {count} hours since {day}.")],
    "other": [("a question about {thing}", "Could somebody explain how {thing} counts holidays before {day}?"), ("a wish for {thing}", "It would help {count} of us if {thing} had a darker screen.")]}
DETAILS = [
    "The serial number ends in {count}.", "Restarting it brought no change.", "A colleague in the Lisbon branch reports the same.", "We are on the plan with the long support hours.", "The manual is silent about this.",
    "It was fine before the spring release.", "Screenshots are attached in two formats.", "Our auditor asks about it every {day}.", "The supplier blamed the weather.", "Please treat it as urgent."]
CONTEXTS = ["It began on {day}.", "We saw it after the update.", "Three colleagues see it too.", "The floor above is not affected.", "This is the {count}th time this year."]
THINGS = ["the portal", "the scanner", "the spare unit", "order nine", "the team plan", "the archive", "the booking page", "the gateway", "the label printer", "the phone bridge", "the wall panel", "the sandbox"]
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]
OPENERS, CLOSERS = ["Hello.", "Good morning.", "Dear team."], ["Thank you.", "Please advise.", "Kind regards."]
SYNONYMS = {"does not": "will not", "charged": "billed", "slow": "sluggish", "question": "query", "loses": "drops", "refused": "rejected", "promised": "announced", "hums": "buzzes"}
MOST_SWAPS = 2
OPENER, CLOSER, SECOND_DETAIL, SECOND_KIND = 65, 55, 50, 35
ARABIC = ["مرحبا.", "لدينا مشكلة.", "شكرا لكم."]
CHANNELS, TIERS = {"email": 50, "chat": 30, "portal": 20}, {"free": 30, "growth": 45, "enterprise": 25}
PII = ("email", "phone", "card")
FIRST, DAYS_LONG = 1_735_689_600, 90
#: Pairs of unrelated tickets that planted pairs are held against, and what a paraphrase's ratio is at least.
UNRELATED, RATIO = 400, 70.0


def chance(salt: str, seed: int) -> Column:
    """A whole number from 0 to 65535 for each doc_id and salt."""
    return F.conv(F.substring(taxonomy.seeded(seed, salt), 1, 4), 16, 10).cast("int")


def pick(values: list[str], salt: str, seed: int) -> Column:
    return F.array(*map(F.lit, values))[chance(salt, seed) % len(values)]


def fill(template: Column, slots: dict[str, Column]) -> Column:
    """A template with {slot} replaced."""
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def swapped(text: Column, most: int = MOST_SWAPS) -> Column:
    """The first place of each of the first `most` words that have a synonym, replaced by it."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SYNONYMS.items()])

    def step(acc: Column, x: Column) -> Column:
        at = F.position(x["a"], acc["t"])
        hit = (at > 0) & (acc["n"] < most)
        new = F.concat(F.substring(acc["t"], F.lit(1), at - 1), x["b"], F.substring(acc["t"], at + F.length(x["a"]), F.length(acc["t"])))
        return F.struct(F.when(hit, new).otherwise(acc["t"]).alias("t"), (acc["n"] + hit.cast("int")).alias("n"))

    return F.aggregate(pairs, F.struct(text.alias("t"), F.lit(0).alias("n")), step, lambda acc: acc["t"])


def paraphrase(body: Column, seed: int) -> Column:
    """The sentences without opener and closer, the last first, at most two words exchanged, with another opener and closer."""
    inner = F.filter(sentences(body), lambda s: ~s.isin(*OPENERS, *CLOSERS))
    turned = F.concat(F.slice(inner, -1, 1), F.when(F.size(inner) > 1, F.slice(inner, F.lit(1), F.size(inner) - 1)).otherwise(F.array().cast("array<string>")))
    return F.concat_ws(" ", pick(OPENERS, "again", seed), swapped(F.array_join(turned, " ")), F.when(chance("end", seed) % 100 < CLOSER, pick(CLOSERS, "ending", seed)))


def interleaved(body: Column) -> Column:
    """Sentences of two scripts in turn: one before the first, one after it, one at the end."""
    s = sentences(body)
    rest = F.when(F.size(s) > 1, F.slice(s, F.lit(2), F.size(s) - 1)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.lit(ARABIC[0])), F.slice(s, 1, 1), F.array(F.lit(ARABIC[1])), rest, F.array(F.lit(ARABIC[2]))), " ")


def planted_value(kind: Column) -> Column:
    """Synthetic personal data of a kind, from doc_id."""
    n = F.col("doc_id")
    card = F.concat_ws(" ", F.lit("4000"), *[F.lpad(((n * f) % 10_000).cast("string"), 4, "0") for f in (7, 11, 13)])
    return F.when(kind == "email", F.format_string("user%d@example.org", n)).when(kind == "phone", F.format_string("555-01%02d", n % 100)).otherwise(card)


def tickets(spark: SparkSession, n: int, seed: int, counts: dict[str, int] = COUNTS) -> DataFrame:
    """Tickets: doc_id, subject, body, channel, tier, created_at, truth, alternate (of ambiguous ones), vendor, kind (what is
    planted), spans (of planted personal data) and pair (of planted duplicates, the number of the ticket that they paraphrase).

    A duplicate is a paraphrase of a canonical ticket, and so has its truth.
    """
    docs = spark.range(n).withColumnRenamed("id", "doc_id")
    planted = taxonomy.plant(docs, {k: v for k, v in counts.items() if v}, seed, place_in_kind=True)
    canonical = planted.where("kind = 'canonical'").select(F.col("place").alias("_place"), F.col("doc_id").alias("origin"))
    planted = planted.join(canonical, (F.col("place") == F.col("_place")) & F.col("kind").isin("canonical", "duplicate"), "left").select("doc_id", "kind", "origin")
    rows = docs.join(F.broadcast(planted), "doc_id", "left")
    # What a ticket says comes from the number of the one it paraphrases.
    rows = rows.select(F.col("doc_id").alias("ticket"), "kind", F.col("origin").alias("pair"), F.coalesce("origin", "doc_id").alias("doc_id"))
    kind = F.col("kind")
    rows = rows.withColumn("truth", taxonomy.draw(chance("class", seed), CLASSES))
    slots = {"thing": pick(THINGS, "thing", seed), "day": pick(DAYS, "weekday", seed), "count": (2 + chance("count", seed) % 97).cast("string")}
    shape = F.coalesce(*[F.when(F.col("truth") == k, F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in v])[chance("shape", seed) % len(v)]) for k, v in SHAPES.items()])
    opener = F.when(chance("opener", seed) % 100 < OPENER, pick(OPENERS, "o", seed))
    closer = F.when(chance("closer", seed) % 100 < CLOSER, pick(CLOSERS, "c", seed))
    first = chance("detail", seed) % len(DETAILS)
    second = F.when(chance("two", seed) % 100 < SECOND_DETAIL, F.array(*map(F.lit, DETAILS))[(first + 1 + chance("more", seed) % (len(DETAILS) - 1)) % len(DETAILS)])
    rows = rows.withColumn("_shape", shape)
    body = fill(F.concat_ws(" ", opener, F.col("_shape")[1], pick(CONTEXTS, "context", seed), F.array(*map(F.lit, DETAILS))[first], second, closer), slots)
    rows = rows.withColumn("subject", fill(F.col("_shape")[0], slots)).withColumn("_body", body)
    rows = rows.withColumn("_body", F.when(kind == "duplicate", paraphrase(F.col("_body"), seed)).when(kind == "multilingual", interleaved(F.col("_body"))).otherwise(F.col("_body")))
    one = chance("pii", seed) % len(PII)
    names = F.array(*map(F.lit, PII))
    other = F.when(chance("second", seed) % 100 < SECOND_KIND, names[(one + 1 + chance("which", seed) % 2) % len(PII)])
    a, b = planted_value(names[one]), planted_value(other)
    before, between = F.lit(" Reach me by "), F.lit(" or by ")
    start_a = F.length("_body") + F.length(before)
    start_b = start_a + F.length(a) + F.length(between)
    span = lambda k, v, at: F.struct(k.alias("type"), v.alias("value"), at.alias("start"), (at + F.length(v)).alias("end"))
    text = F.when(kind == "pii", F.concat(F.col("_body"), before, a, F.when(other.isNotNull(), F.concat(between, b)).otherwise(F.lit("")), F.lit("."))).otherwise(F.col("_body"))
    spans = F.when(kind == "pii", F.array_compact(F.array(span(names[one], a, start_a), F.when(other.isNotNull(), span(other, b, start_b)))))
    confused = F.coalesce(*[F.when(F.col("truth") == k, v) for k, v in CONFUSED.items()])
    rows = rows.withColumn("body", text).withColumn("spans", spans)
    created = F.timestamp_seconds(F.lit(FIRST) + chance("day", seed) % DAYS_LONG * 86_400 + chance("second of day", seed) % 86_400)
    return rows.select(
        F.col("ticket").alias("doc_id"), "subject", "body", taxonomy.draw(chance("channel", seed), CHANNELS).alias("channel"), taxonomy.draw(chance("tier", seed), TIERS).alias("tier"), created.alias("created_at"), "truth",
        F.when(kind == "ambiguous", confused).alias("alternate"), F.when(kind == "error", confused).otherwise(F.col("truth")).alias("vendor"), "kind", "spans", "pair")


def copies(spark: SparkSession, n: int, seed: int, counts: dict[str, int] = COUNTS) -> DataFrame:
    """For every planted duplicate its number, the paraphrase and the original text."""
    rows = tickets(spark, n, seed, counts)
    first = rows.where("kind = 'canonical'").select("pair", F.col("body").alias("original"))
    return rows.where("kind = 'duplicate'").select("doc_id", "body", "pair").join(first, "pair").drop("pair")


def shape_groups(rows: DataFrame) -> DataFrame:
    """shape and number of the subjects that several tickets share, numbered in their order."""
    found = rows.groupBy(F.col("subject").alias("shape")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.withColumn("number", F.row_number().over(Window.orderBy("shape")))  # of templates, not of tickets


def manifest(rows: DataFrame) -> DataFrame:
    """What was planted, by kind, and how many of each class there are."""
    kinds = rows.where("kind IS NOT NULL").groupBy(F.concat(F.lit("kind "), "kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(rows.groupBy(F.concat(F.lit("class "), "truth").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def ratios(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) of texts with their token-set ratio."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(ratio=[similarity.token_set_ratio(x, y) for x, y in zip(part["a"], part["b"], strict=True)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInPandas(run, f"{schema}, ratio double")


def unrelated(rows: DataFrame, seed: int, n: int = UNRELATED) -> DataFrame:
    """a, b: up to n pairs of texts of tickets that no pair was planted in: neighbours in a seeded order."""
    chosen = rows.where("pair IS NULL").select("doc_id", whole_text().alias("t")).orderBy(taxonomy.seeded(seed, "unrelated"), "doc_id").limit(2 * n)
    placed = chosen.withColumn("_i", F.row_number().over(Window.orderBy(taxonomy.seeded(seed, "unrelated"), "doc_id")) - 1)  # at most 2 n rows
    return placed.groupBy(F.floor(F.col("_i") / 2)).agg(F.min_by("t", "_i").alias("a"), F.max_by("t", "_i").alias("b"), F.count(F.lit(1)).alias("k")).where("k = 2").select("a", "b")


def whole_text() -> Column:
    return T.normalize(F.concat_ws(" ", "subject", "body"))


def checks(rows: DataFrame, n: int, counts: dict[str, int] = COUNTS, seed: int = 0) -> DataFrame:
    """name, ok and detail of 24 checks that the tickets are what was asked for."""
    kind = F.coalesce("kind", F.lit(""))
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    confused = F.coalesce(*[F.when(F.col("truth") == k, v) for k, v in CONFUSED.items()])
    arabic = F.col("body").rlike("[\u0600-\u06ff]")
    on_spot = F.forall("spans", lambda s: F.substring(F.col("body"), s["start"] + 1, s["end"] - s["start"]) == s["value"])
    spans = F.coalesce(F.size("spans"), F.lit(0))
    planted = {k: counts.get(k, 0) for k in COUNTS}
    # How many rows speak against each claim, or how many there are against how many there should be.
    against = {
        "errors are wrong": (kind == "error") & (F.col("vendor") == F.col("truth")), "errors are plausible": (kind == "error") & (F.col("vendor") != confused), "no other errors": (kind != "error") & (F.col("vendor") != F.col("truth")),
        "ambiguous tickets have an alternate": (kind == "ambiguous") & F.col("alternate").isNull(), "alternates differ": F.col("alternate") == F.col("truth"), "no other alternates": (kind != "ambiguous") & F.col("alternate").isNotNull(),
        "personal data has spans": (kind == "pii") & (spans == 0), "spans are on the spot": ~on_spot, "no other spans": (kind != "pii") & (spans > 0),
        "scripts are mixed": (kind == "multilingual") & ~arabic, "no other mixed scripts": (kind != "multilingual") & arabic}
    sums = rows.agg(F.count(F.lit(1)).alias("size"), F.count_distinct("doc_id").alias("ids"), *[total(kind == k).alias(f"kind {k}") for k in planted], *[total(c).alias(k) for k, c in against.items()])
    pairs = rows.where("pair IS NOT NULL").groupBy("pair").agg(F.count(F.lit(1)).alias("k"), total(F.col("kind") == "canonical").alias("c"), F.count_distinct("truth").alias("t"))
    pairs = pairs.agg(F.count(F.lit(1)).alias("pairs"), total(F.col("k") != 2).alias("odd"), total(F.col("c") != 1).alias("crowned"), total(F.col("t") != 1).alias("split"))
    text = rows.withColumn("t", whole_text())
    both = text.where("kind = 'canonical'").select("pair", F.col("t").alias("a")).join(text.where("kind = 'duplicate'").select("pair", F.col("t").alias("b")), "pair")
    worst = ratios(both).agg(F.min("ratio").alias("worst"))
    far = ratios(unrelated(rows, seed)).agg(F.sort_array(F.collect_list("ratio")).alias("r"))  # at most UNRELATED numbers
    far = far.select(F.get("r", F.greatest(F.lit(0), F.floor(F.size("r") * 99 / 100).cast("int") - 1)).alias("p99"))
    one = sums.join(pairs, F.lit(True)).join(worst, F.lit(True)).join(far, F.lit(True))
    equal = lambda name, c, want: F.struct(F.lit(name).alias("name"), (F.col(c) == want).alias("ok"), F.concat(F.col(c).cast("string"), F.lit(f" of {want}")).alias("detail"))
    number = lambda c: F.format_string("%.1f", c)
    found = [
        equal("size", "size", n), equal("numbers", "ids", n), *[equal(f"planted {k}", f"kind {k}", v) for k, v in planted.items() if k not in ("canonical", "duplicate")], *[equal(k, k, 0) for k in against],
        equal("planted pairs", "pairs", planted["duplicate"]), equal("pairs have two members", "odd", 0), equal("pairs have one original", "crowned", 0), equal("pairs share a class", "split", 0),
        F.struct(F.lit("pairs are near duplicates").alias("name"), F.coalesce(F.col("worst") >= RATIO, F.lit(planted["duplicate"] == 0)).alias("ok"), F.concat(F.lit("at least "), number("worst")).alias("detail")),
        F.struct(F.lit("pairs stand out").alias("name"), F.coalesce(F.col("worst") > F.col("p99"), F.lit(planted["duplicate"] == 0)).alias("ok"), F.concat(number("worst"), F.lit(" against "), number("p99")).alias("detail")),
        F.struct(F.lit("planted sets are apart").alias("name"), (F.col("size") == F.col("ids")).alias("ok"), F.lit("one kind a ticket").alias("detail"))]
    return one.select(F.explode(F.array(*found)).alias("x")).select("x.*")
