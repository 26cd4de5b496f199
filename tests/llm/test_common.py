import numpy as np

from codequarry.llm.common import joined_bytes, slices, spans, word_hashes


def hashes(texts, block=1 << 20):
    data, _ = joined_bytes(texts)
    start, end = spans((data != 32) & (data != 10))
    return word_hashes(data, start, end, block)


def test_a_words_hash_depends_on_the_word_alone():
    long = "y" * 200
    a = hashes(["one two", long + " one", "two " + "z" * 70])
    b = np.concatenate([hashes([w]) for w in ("one", "two", long, "one", "two", "z" * 70)])
    assert np.array_equal(a, b) and len(set(a.tolist())) == 4
    assert np.array_equal(hashes(["one two", long + " one"], block=5), hashes(["one two", long + " one"]))
    assert len(set(hashes(["q" * k for k in range(1, 200)]).tolist())) == 199


def test_slices_cover_all_texts_in_order():
    texts = ["a" * n for n in (5, 1, 100, 3, 3, 0, 50)]
    parts = list(slices(texts, 10))
    assert [i for i, _ in parts] + [7] == [0] + [j for _, j in parts]
    assert all(j - i == 1 or sum(map(len, texts[i:j])) <= 10 for i, j in parts)
    assert list(slices([], 10)) == []
