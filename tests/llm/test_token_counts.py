import random
import time

import pytest
from tokenizers import Tokenizer

from codequarry.llm import token_counts as K


@pytest.fixture(scope="module")
def codec():
    with open(K.default_path(), encoding="utf-8") as f:
        return K.ByteBpe(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(K.default_path())


def lib(library, texts):
    return [len(e.ids) for e in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


PARTS = ["a", "b", "'s", " ", "  ", "\n", "\t", "1", "é", "中", "😀", "<|endoftext|>", "<|", "|>", "the", "'", "'ll", ".",
         " ", "　", "\x1c", "\x85", "\U0001fae8", "\U0001cc00", "²", "ǅ", "́"]


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(60))) for _ in range(n)]


def test_counts_equal_the_library(codec, library):
    some = texts(5000)
    assert [codec.count(t)[0] for t in some] == lib(library, some)


def test_pieces_change_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(K, "PIECE", 5)
    some = texts(3000, seed=2)
    assert [codec.count(t)[0] for t in some] == lib(library, some)


def test_proved_strings_are_single_tokens_and_others_are_not(codec, library):
    proved = codec.prove()
    assert len(proved) > 45_000
    assert set(lib(library, ["x" + p for p in proved if p.startswith(" ")])) <= {1, 2}
    alone = [p for p in proved if K.pre_tokens(p) == [p]]
    assert set(lib(library, alone)) == {1}
    rest = [s for s, i in codec.vocab.items() if codec.merge(bytes(codec.byte_of[c] for c in s)) != [i]]
    assert len(rest) + len(proved) <= len(codec.vocab)


def test_merging_short_and_long_agree(codec):
    r = random.Random(3)
    for _ in range(500):
        raw = "".join(r.choice("abetio nhr中é") for _ in range(r.randrange(48))).encode()[:48]
        assert codec.merge(raw) == codec._merge_long([codec.base[b] for b in raw])


def test_table_nulls_and_clashing_columns(spark, odd, none, library):
    rows = K.token_counts(spark, odd, keep=tuple(odd.columns)).collect()
    assert len(rows) == odd.count()
    assert [r.n_tokens for r in rows] == lib(library, [r.text for r in rows])
    assert [r.n_bytes for r in rows] == [len((r.text or "").encode()) for r in rows]
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert K.token_counts(spark, none).count() == 0


def test_corpus(spark, corpus, library):
    rows = K.token_counts(spark, corpus, keep=("doc_id", "text")).collect()
    assert [r.n_tokens for r in rows] == lib(library, [r.text for r in rows])
    assert sum(r.n_merged for r in rows) < sum(r.n_tokens for r in rows) / 2


@pytest.mark.parametrize("text", ["中" * 1_700_000, "x" * 5_000_000, "the cat " * 625_000, " " * 5_000_000],
                         ids=["chinese", "one word", "prose", "blank"])
def test_five_megabytes(codec, library, text):
    t = time.perf_counter()
    n, _ = codec.count(text)
    assert time.perf_counter() - t < 60
    assert n == lib(library, [text])[0]
