"""Contamination against a search of every reference in every document."""

import random
import re

import pytest

from codequarry.operators import contamination as C


def normal(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, refs):
    out = set()
    for d, t in docs:
        words = normal(t)
        for i, r in refs:
            ref = normal(r)
            at = [k for k in range(len(words) - len(ref) + 1) if ref and words[k:k + len(ref)] == ref]
            if at:
                out.add((d, i, at[0]))
    return sorted(out, key=repr)


def run(spark, docs, refs, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    r = spark.createDataFrame(refs, "item_id long, text string")
    return sorted(map(tuple, C.contamination(d, r, **kw).collect()), key=repr)


def corpus(n=300, seed=1):
    """A common gram in a third of the documents; references of one word up to long ones."""
    r = random.Random(seed)
    vocab = ["the", "of", "cat", "Éa", "x1", "中文", "so", "on"]
    words = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    hot = "the of the of the"
    docs = [(i, words(r.choice([0, 3, 40, 90])) + (f", {hot}! {hot} cat" if i % 3 == 0 else "")) for i in range(n)]
    docs += [(None, docs[1][1]), (5, docs[2][1]), (None, None), (900, ""), (901, hot), (901, hot)]
    refs = [(100 + k, words(k)) for k in (1, 2, 3, 4, 5, 6, 8, 12)] + [(1, hot), (2, hot + " cat"), (3, hot + " of the"), (4, None)]
    refs += [(5, " .,! "), (6, hot.upper() + "."), (7, hot), (None, "cat"), (8, docs[4][1]), (9, "never seen at all in any text")]
    refs += [(10 + i, " ".join(normal(docs[i][1])[5:17])) for i in range(0, min(60, n), 7)]
    return docs, refs


@pytest.mark.parametrize("kw", [{}, {"broadcast_grams": 0}, {"gram": 1}, {"gram": 3}])
def test_pairs_equal_brute_force(spark, kw):
    docs, refs = corpus()
    assert run(spark, docs, refs, **kw) == brute(docs, refs)


def test_empty_tables(spark):
    docs, refs = corpus(10)
    assert run(spark, docs, refs[:0]) == [] and run(spark, docs[:0], refs) == []
    assert run(spark, docs, [(5, "...")]) == []


def test_a_hot_gram_is_met_by_its_own_references_only(spark, monkeypatch):
    """A reference that holds the hot gram and a rare one is looked up by the rare one."""
    hot = "alpha beta gamma delta epsilon"
    docs = [(i, f"{hot} w{i} v{i} u{i} t{i} s{i}") for i in range(400)]
    refs = [(i, f"{hot} w{i} v{i} u{i} t{i} s{i}") for i in range(0, 400, 10)]
    kept = []
    whole = C.persisted
    monkeypatch.setattr(C, "persisted", lambda df, name: kept.append((name, whole(df, name))) or kept[-1][1])
    assert run(spark, docs, refs) == sorted(((i, i, 0) for i in range(0, 400, 10)), key=repr)
    candidates = next(df for name, df in kept if name == "candidates")
    assert candidates.count() == 40


def test_extra_columns_and_one_very_long_text(spark):
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    docs = [(1, long + " needle in the hay stack now"), (2, "needle in the hay")]
    refs = [(7, "Needle, in the hay-stack now"), (8, "w976 w0 w1 w2 w3 w4 w5 w6")]
    assert run(spark, docs, refs) == [(1, 7, 300_000), (1, 8, 976)]
