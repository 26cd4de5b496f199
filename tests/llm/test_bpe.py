import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codequarry.llm import bpe as B

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def codec():
    with open(B.default_path(), encoding="utf-8") as f:
        return B.WordBpe(f.read())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(B.default_path())


def same(codec, library, texts):
    got = codec.encode_batch(texts)
    for t, g, w in zip(texts, got, library.encode_batch(texts, add_special_tokens=False)):
        assert g.tolist() == w.ids, t
        assert codec.decode(g) == library.decode(w.ids, skip_special_tokens=False), t


def test_prose_and_odd_texts_match_the_library(codec, library):
    rng = random.Random(3)
    al = "aabbcc'ststrveml d  \t\n\x1c\x1f\x85 　éÉÀßİıΣς中文字ﬁ١２²½Ⅷ👍🏽é̈!!--..__09zq​﻿"
    texts = ["".join(rng.choice(al) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["", "  ", "<|endoftext|>", "a<|startoftext|><|endoftext|> b <|STARTOFTEXT|>", "a" * 300, "!" * 500,
              "ab" * 1000, "'s's''s 'll'", "ΑΣ ΑΣΑ"]
    same(codec, library, texts)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_any_text_matches_the_library(text):
    codec, library = _cached()
    same(codec, library, [text.encode("utf-8", "ignore").decode()])


_CACHE = []


def _cached():
    if not _CACHE:
        with open(B.default_path(), encoding="utf-8") as f:
            _CACHE.extend([B.WordBpe(f.read()), tokenizers.Tokenizer.from_file(B.default_path())])
    return _CACHE


def test_verification_agrees_with_exact_merging(codec):
    rng = random.Random(9)
    words = list({"".join(rng.choice("thanerionstdlbewh") for _ in range(rng.randrange(1, 14))).encode()
                  for _ in range(4000)})
    ids, n = codec.encode_words(words)
    exact = codec._merge_all(words, np.ones(len(words), dtype=bool))
    assert np.array_equal(ids, np.concatenate(exact)) and n.tolist() == [len(x) for x in exact]
    tokens, owner = codec._longest(words)
    first = np.bincount(owner, minlength=len(words))
    assert (first != n).any()  # some speculations fail and are repaired


def test_long_words_use_the_heap(codec, library):
    same(codec, library, ["than" * 400, "x" * 5000, "ionsth" * 90])


def test_words_beyond_the_memory_are_still_encoded(library, monkeypatch):
    monkeypatch.setattr(B, "WORDS_KEPT", 5)
    with open(B.default_path(), encoding="utf-8") as f:
        c = B.WordBpe(f.read())
    for _ in range(2):
        same(c, library, ["one two three four five six seven", "seven eight nine one"])
    assert len(c.slot) <= 7


def test_segments_cut_at_white_space_only():
    t = " ".join(f"w{i}" for i in range(500))
    parts = list(B.segments(t, 50))
    assert "".join(parts) == t and len(parts) > 10 and all(p[0] == " " for p in parts[1:])
    assert list(B.segments("x" * 500, 50)) == ["x" * 500]


def test_table_round_trip(spark, odd, library, monkeypatch):
    rows = B.tokenised(spark, odd, keep=("doc_id", "text", "size")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    d = B.decode(spark, spark.createDataFrame([(1, [518, 269])], "doc_id long, ids array<int>")).first()
    assert d.decoded == library.decode([518, 269], skip_special_tokens=False)


def test_empty_table(spark, none):
    assert B.tokenised(spark, none).count() == 0


@pytest.mark.parametrize("text", ["中" * 350_000, "字中文" * 600_000, "x" * 5_000_000, "ab" * 500_000 + "é" * 200_000],
                         ids=["chinese", "chinese 5 MB", "one letter 5 MB", "mixed"])
def test_long_texts_without_a_space(codec, library, text):
    import time
    t = time.perf_counter()
    ids = codec.encode_batch([text])[0]
    assert time.perf_counter() - t < 10 * max(1, len(text.encode()) / 1e6)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_long_random_word_in_a_five_megabyte_text(codec, library):
    rng = random.Random(9)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))
    text = "the cat sat on the mat " * 200_000 + word + " end"
    ids = np.concatenate([codec.encode_batch([s])[0] for s in B.segments(text)])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_and_short_walks_agree(codec, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéñ中!") for _ in range(rng.randrange(1, 90))).encode() for _ in range(300)]
    whole = codec.encode_words(words)
    monkeypatch.setattr(B, "LONG_WORD", 20)
    parts = codec.encode_words(words)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()
