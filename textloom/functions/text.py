"""Text functions as column expressions: normalised text, terms, personal-data spans and their replacement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the deterministic labeler and the personal-data patterns.
STOPWORDS = tuple("""
a an the and or but if then than that this these those there here of in on at to
for from with without by as is are was were be been being do does did doing have
has had having it its it's we our us you your they them their he she his her
not no nor so such can could should would may might must will shall about into
over under again further once when where why how all any both each few more most
other some only own same too very just also who whom which what while during
i me my mine yours ours theirs am been being had having does did doing
""".split())
TOKEN = r"[a-z][a-z0-9_]+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
CARD = r"\b(?:\d{4}[ -]?){3}\d{4}\b"
PHONE = r"(?:\+\d{1,2}[ .-]?)?(?:\(\d{3}\)|\b\d{3})[ .-]\d{3,4}(?:[ .-]\d{2,4})?\b"

SPAN = "struct<type:string,value:string,start:int,end:int>"


def normalize(text: Column) -> Column:
    """Lower case, everything but letters, digits, underscores and white space made a space, white space collapsed."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def terms(text: Column) -> Column:
    """The words of the normalised text that have more than two characters."""
    return F.filter(F.split(normalize(text), " "), lambda w: F.length(w) > 2)


def tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Latin tokens of more than two characters that are not stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) > 2) & (~w.isin(*stopwords) if stopwords else F.lit(True)))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def _hits(text: Column, pattern: str, kind: str) -> Column:
    """All matches with code-point offsets, rebuilt from the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)
    start = F.aggregate(
        F.arrays_zip(F.slice(between, 1, F.size(found)).alias("p"), found.alias("h")), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["p"]) + F.length(x["h"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("type"), x["h"].alias("value"), (acc["at"] + F.length(x["p"])).alias("start"), (acc["at"] + F.length(x["p"]) + F.length(x["h"])).alias("end")))).alias("out")),
        lambda acc: acc["out"])
    return F.when(text.rlike(pattern), start).otherwise(F.array().cast(f"array<{SPAN}>"))


def pii_spans(text: Column) -> Column:
    """Card, email and phone spans by start; a phone that starts within a card is not one. A null text has none."""
    body = F.coalesce(text, F.lit(""))
    cards, emails, phones = _hits(body, CARD, "card"), _hits(body, EMAIL, "email"), _hits(body, PHONE, "phone")
    phones = F.filter(phones, lambda p: ~F.exists(cards, lambda c: (p["start"] >= c["start"]) & (p["start"] < c["end"])))
    order = {"card": 0, "email": 1, "phone": 2}
    keyed = F.transform(F.concat(cards, emails, phones), lambda s: F.struct(s["start"].alias("start"), F.coalesce(*[F.when(s["type"] == k, v) for k, v in order.items()]).alias("o"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def has_pii(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    return body.rlike(CARD) | body.rlike(EMAIL) | body.rlike(PHONE)


def scrub(text: Column, spans: Column) -> Column:
    """text, with numbered placeholders for spans (by start), and how many spans were left out.

    A span that starts before the end of any earlier one is left out.
    """
    kinds = ("email", "phone", "card")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("cut"), F.lit(0).alias("seen"), F.lit(0).alias("dropped"), *[F.lit(0).alias(k) for k in kinds])

    def step(acc: Column, s: Column) -> Column:
        keep = s["start"] >= acc["seen"]
        number = F.coalesce(*[F.when(s["type"] == k, acc[k] + 1) for k in kinds])
        grown = F.concat(acc["out"], F.substring(text, acc["cut"] + 1, s["start"] - acc["cut"]), F.lit("["), F.upper(s["type"]), F.lit("_"), number.cast("string"), F.lit("]"))
        return F.struct(
            F.when(keep, grown).otherwise(acc["out"]).alias("out"), F.when(keep, s["end"]).otherwise(acc["cut"]).alias("cut"),
            F.greatest(acc["seen"], s["end"]).alias("seen"), (acc["dropped"] + (~keep).cast("int")).alias("dropped"),
            *[(acc[k] + (keep & (s["type"] == k)).cast("int")).alias(k) for k in kinds])

    return F.aggregate(spans, start, step, lambda acc: F.struct(F.concat(acc["out"], F.substring(text, acc["cut"] + 1, F.length(text))).alias("text"), acc["dropped"].alias("dropped")))


def token_estimate(text: Column) -> Column:
    """At least one; a token for each 3.2 characters."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3.2).cast("int"))


def extract_json(text: Column) -> Column:
    """The JSON text in a fenced block, or else from the first brace or bracket to the last; null if neither parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    outer = F.regexp_extract(text, r"(?s)([\{\[].*[\}\]])", 1)
    valid = lambda x: F.when(F.get_json_object(x, "$").isNotNull(), x)
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.coalesce(valid(bare(fenced)), valid(bare(text)), valid(outer))


def is_snake_case(name: Column) -> Column:
    return (name == F.lower(name)) & (F.instr(name, " ") == 0)


def plain_dashes(text: Column) -> Column:
    """Commas for long dashes, with or without a blank on both sides; null stays null."""
    return F.regexp_replace(text, " \u2014 | \u2013 |\u2014|\u2013", ", ")
