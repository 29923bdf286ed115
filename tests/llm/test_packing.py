import struct
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm.packing import Sums, WordEncoder, default_tokenizer, pack, plan

ODD = ["", " ", "a,b.", "It's,. <|endoftext|>, x<|startoftext|>.", "ΣΑΣ, ΟΔΟΣ. İI, é,. \x1ca\x1c, 中文. ,,..", "don't. we'll, 9,. a..b,,", "été, É.", "A" * 9000, "x y z"]


@pytest.mark.parametrize("limit", [3, 100_000])
def test_ids_are_the_tokenizers(rows, limit):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    encoder = WordEncoder(default_tokenizer(), limit)
    texts = ODD + [t for _, t, _ in rows]
    for i in range(0, len(texts), 10):
        for text, ids in zip(texts[i : i + 10], encoder.encode(texts[i : i + 10]), strict=True):
            assert list(ids) == tok.encode(text, add_special_tokens=False).ids
    assert len(encoder.words) <= 100_000


def test_plain_words_go_to_the_model_alone():
    """Lower-case words of Latin letters, by far the most, do not take the way through the tokenizer's rules."""
    encoder, seen = WordEncoder(default_tokenizer()), []

    class Counted:
        def encode_batch_fast(self, words, **more):
            seen.extend(words)
            return tokenizer.encode_batch_fast(words, **more)

    tokenizer, encoder.tokenizer = encoder.tokenizer, Counted()
    plain = [f"{a}{b}{c}" for a in "abcxyzéßöñŀſÿ" for b in "thñêaŉ" for c in ("ing", "où", "æ", "ª")]
    ids = list(encoder.encode([" ".join([*plain, "中文", "don't"])]))
    assert set(seen) == {"中文", "don't"}
    assert list(ids[0]) == tokenizer.encode(" ".join([*plain, "中文", "don't"]), add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=20))
def test_plan_uses_every_piece_once(histogram):
    used = Counter()
    bins = plan(histogram, 64)
    for lengths, n in bins:
        assert sum(lengths) <= 64 and n > 0
        for k in lengths:
            used[k] += n
    assert used == Counter(histogram)
    volume = -(-sum(k * n for k, n in histogram.items()) // 64)
    assert sum(n for _, n in bins) <= max(volume * 2, 1)


def test_exact_combinations():
    assert sum(n for _, n in plan({30: 2, 34: 2, 10: 1, 24: 1}, 64)) == 3
    assert sorted(plan({50: 3, 7: 6}, 64)) == [((50, 7, 7), 3)]
    assert sum(n for _, n in plan({60: 4, 1: 4, 2: 4}, 64)) == 4


def test_index_of_sums():
    left = {30: 1, 20: 2, 14: 4, 10: 1, 4: 1}
    sums = Sums(left, 64)
    assert sums.pair(40, 30) == (20, 20) and sums.pair(34, 30) == (20, 14) and sums.pair(44, 20) is None
    assert sums.pair(28, 20) == (14, 14) and sums.triple(44, 30) == (20, 20, 4) and sums.triple(63, 20) is None
    assert sums.pair(24, 20) == (20, 4) and sums.pair(10, 30) is None
    del left[20]
    assert sums.pair(34, 14) is None and sums.pair(24, 14) == (14, 10) and sums.triple(28, 14) == (14, 10, 4)
    left[10] = 0
    assert sums.pair(24, 14) is None


def test_other_tokenizers_encode_whole_texts(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, encoder = Tokenizer.from_file(path), WordEncoder(path)
    texts = ODD + [t for _, t, _ in rows[:30]]
    assert not encoder.by_word and WordEncoder(default_tokenizer()).by_word
    assert [list(x) for x in encoder.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack(corpus, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    got = pack(corpus).collect()
    want = Counter()
    for doc_id, text, _ in rows:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            cut = ids[k : k + 4096]
            want[doc_id, k // 4096, k, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) == -(-sum(r["length"] for r in got) // 4096)


def test_no_rows(nothing):
    assert pack(nothing).collect() == []
