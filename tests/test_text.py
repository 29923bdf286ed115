import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T

TEXTS = [
    "a@b.co", "mail x.y@z-w.org now", "4111 1111 1111 1111", "4111-1111-1111-1111 and 415-555-0199", "call +1 (415) 555-0199.", "\U0001f600 a@b.co \U0001f600 c@d.io", "nothing", "", None,
    "tel 415 555 0199 x 4111111111111111 y 212.555.0100", "415-555-0199@mail.com",
]


def spans(text):
    text = text or ""
    cards = [("card", m.group(), m.start(), m.end()) for m in re.finditer(T.CARD, text)]
    out = cards + [("email", m.group(), m.start(), m.end()) for m in re.finditer(T.EMAIL, text)]
    out += [("phone", m.group(), m.start(), m.end()) for m in re.finditer(T.PHONE, text) if not any(c[2] <= m.start() < c[3] for c in cards)]
    return sorted(out, key=lambda s: (s[2], s[0]))


def test_spans_and_scrub(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").withColumn("s", T.pii_spans(F.col("text")))
    rows = df.withColumn("out", T.scrub(F.coalesce("text", F.lit("")), F.col("s"))).orderBy("id").collect()
    for r, text in zip(rows, TEXTS, strict=True):
        assert [tuple(s) for s in r["s"]] == spans(text)
        assert all((text or "")[s["start"] : s["end"]] == s["value"] for s in r["s"])
        for pattern in (T.CARD, T.EMAIL):
            assert not re.search(pattern, r["out"]["text"])
    assert rows[1]["out"]["text"] == "mail [EMAIL_1] now"
    assert rows[5]["out"]["text"].endswith("[EMAIL_2]")


def test_overlap_is_dropped(spark):
    row = spark.createDataFrame([("415-555-0199@mail.com",)], "text string").select(T.scrub(F.col("text"), T.pii_spans(F.col("text"))).alias("r")).first()["r"]
    assert row["dropped"] == 1


@pytest.mark.parametrize(("raw", "want"), [("Héllo,  World_1!", "héllo world_1"), ("", ""), ("a-b\tc", "a b c")])
def test_normalize(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(T.normalize(F.col("t"))).first()[0] == want


def test_tokens_and_scalars(spark):
    row = spark.createDataFrame([("The Quick_9 fox of 12ab é",)], "t string").select(T.tokens(F.col("t")).alias("t"), T.token_estimate(F.col("t")).alias("n")).first()
    assert row["t"] == ["quick_9", "fox"] and row["n"] == 7
    found = spark.createDataFrame([('x ```json\n{"a": 1}\n``` y',), ('see {"a": 2} end',), ("none",)], "t string").select(T.extract_json(F.col("t"))).collect()
    assert [r[0] for r in found] == ['{"a": 1}', '{"a": 2}', None]
    assert [r[0] for r in spark.createDataFrame([("a_b",), ("A",), ("a b",)], "t string").select(T.is_snake_case(F.col("t"))).collect()] == [True, False, False]
