import random

import pytest

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "st", "sh")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Texts with exact and near copies, shared passages, nulls, empty and very long texts, repeated rows and clashing column names."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(60)]
    base = prose(rng, 150)
    for k in range(12):  # near copies
        w = base.split()
        w[10 * k + 3] = "changed"
        texts.append(" ".join(w))
    texts += [base, base.upper(), base.replace(" ", "\n  "), texts[0], texts[0], None, None, "", " \t\n", "one", "one two", "One TWO", "été 日本 \U0001f600 " * 40, "=" * 1500, "ab" * 500 + "c"]
    passage = prose(rng, 120)
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 30) for _ in range(5)]
    texts.append(prose(rng, 12_000))
    rows = [(i, t, "en", ("s" + str(i % 3)) if i % 7 else None, len(t or ""), 1, "x", 2.0, b"y") for i, t in enumerate(texts)]
    rows += [(0, texts[0], "en", "s0", 1, 1, "x", 2.0, b"y"), (None, base, "en", "s1", 1, 1, "x", 2.0, b"y"), (None, "alone and unlike", None, None, 1, 1, "x", 2.0, b"y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, key string, score double, same binary").repartition(3)


@pytest.fixture(scope="session")
def rows(corpus):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in corpus.collect()]


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.where("doc_id < 0")
