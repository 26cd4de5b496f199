import random
from collections import Counter, defaultdict

import numpy as np

from codequarry.llm import near_dedup as N
from codequarry.llm.components import components


def multiset(t):
    w = (t or "").split()
    if not w:
        return Counter()
    return Counter(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else Counter([tuple(w)])


def brute_classes(rows):
    """(doc_id, text) -> {row number: smallest doc_id of its class}, from all pairs."""
    m = [multiset(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = m[i], m[j]
            shared, size = sum((a & b).values()), sum((a | b).values())
            if (size == 0) or shared / size >= 0.8:
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    first = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [first[find(i)] for i in range(len(rows))]


def family(rng, n, words, edits):
    """Copies of one text, each with some words changed."""
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(words)] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(t))
    return out


def test_signature_is_unbiased_for_weighted_jaccard():
    rng = random.Random(1)
    z = []
    for trial in range(60):
        n = rng.choice([3, 30, 300])
        base = [str(rng.randrange(10 ** 6)) for _ in range(n)] * (rng.randrange(1, 9) if trial % 3 == 0 else 1)
        other = list(base)
        for _ in range(max(1, n // 25)):
            other[rng.randrange(len(other))] = "x"
        a, b = " ".join(base), " ".join(other + (base if trial % 4 == 0 else []))
        reg = N.signatures(*N.multisets([a, b]), 2)
        j = sum((multiset(a) & multiset(b)).values()) / sum((multiset(a) | multiset(b)).values())
        assert abs(N.overlaps([a], [b])[0] - j) < 1e-12
        z.append(((reg[0] == reg[1]).mean() - j) / max(np.sqrt(j * (1 - j) / N.REGISTERS), 0.02))
    assert abs(np.mean(z)) < 0.5 and np.std(z) < 1.4


def test_signature_does_not_depend_on_the_batch():
    texts = ["a b c d e f g", "one two", "", "q " * 900, " ".join(map(str, range(400)))]
    together = N.signatures(*N.multisets(texts), len(texts))
    for k, t in enumerate(texts):
        assert np.array_equal(N.signatures(*N.multisets([t]), 1)[0], together[k])


def test_classes_match_all_pairs(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for n, words, edits in ((40, 60, 3), (25, 30, 2), (12, 200, 9), (5, 8, 1), (30, 25, 3)):
        rows += family(rng, n, words, edits)
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [passage + " " + " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(20)) for _ in range(40)]
    rows += ["", None, " \n", "two words", "two\twords", "two words more", " ".join(["again"] * 50),
             " ".join(["again"] * 60)]
    rng.shuffle(rows)
    table = list(enumerate(rows)) + [(3, rows[3]), (None, rows[5]), (None, "alone here")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(path)
    got = N.near_classes(spark, spark.read.parquet(path)).collect()
    want = Counter((d, c) for (d, _), c in zip(table, brute_classes(table)))
    assert Counter((r.doc_id, r.component_id) for r in got) == want
    kept = Counter(r.component_id for r in got if r.kept)
    assert all(v == 1 for k, v in kept.items() if k is not None)
    assert set(kept) == {c for _, c in want}


def test_odd_rows_and_stage(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = Counter((r.doc_id, r.component_id) for r in N.near_classes(spark, odd).collect())
    assert got == Counter((d, c) for (d, _), c in zip(rows, brute_classes(rows)))
    out = N.deduplicate(spark, odd)
    assert out.columns == odd.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, c in got})


def test_empty_table(spark, none):
    assert N.near_classes(spark, none).count() == 0 and N.deduplicate(spark, none).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(7, 7), (201, 200), (200, 201)]
    got = {r.node: r.label for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
