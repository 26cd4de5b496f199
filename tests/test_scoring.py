import math

import numpy as np
from pyspark.sql import functions as F

from codequarry.operators import evaluate as E
from codequarry.operators import scoring as S


def test_greedy_kernel_fixture():
    p, r, f = S._greedy_np([np.array([1.0, 0.0]), np.array([0.0, 1.0])],
                           [np.array([1.0, 0.0]), np.array([0.6, 0.8])])
    assert math.isclose(p, 0.9) and math.isclose(r, 0.9) and math.isclose(f, 0.9)


def test_greedy_hof_matches_kernel(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [0.6, 0.8]])],
                               "pv array<array<double>>, rv array<array<double>>")
    p, r, f = S.greedy_scores(F.col("pv"), F.col("rv"))
    row = df.select(p.alias("p"), r.alias("r"), f.alias("f")).first()
    assert [round(x, 9) for x in row] == [0.9, 0.9, 0.9]


def test_greedy_match_end_to_end(spark):
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "vec_id bigint, embedding array<float>")
    df = spark.createDataFrame([(1, "same words", "same words"), (2, "", "x"), (3, None, "y")],
                               "id bigint, pred string, ref string")
    # one bucket: every token maps to vector 0, so any non-empty pair scores 1
    out = {r["id"]: (r["precision"], r["recall"], r["f1"])
           for r in S.greedy_match(df, ["id"], "pred", "ref", vecs, buckets=1).collect()}
    assert out[1] == (1.0, 1.0, 1.0)
    assert out[2] == (0.0, 0.0, 0.0) and out[3] == (0.0, 0.0, 0.0)


def test_greedy_match_partition_independent(spark):
    vecs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    a = S.greedy_match(conv.repartition(1), ["conv_id", "turn"], "text", "text", vecs)
    b = S.greedy_match(conv.repartition(8), ["conv_id", "turn"], "text", "text", vecs)
    key = ["conv_id", "turn"]
    ra = sorted((r["conv_id"], r["turn"], round(r["f1"], 9)) for r in a.collect())
    rb = sorted((r["conv_id"], r["turn"], round(r["f1"], 9)) for r in b.collect())
    assert ra == rb and all(x[2] in (0.0, 1.0) for x in ra)  # text vs itself: 1 (or 0 if empty)
    assert len(ra) == conv.select(*key).distinct().count()


def test_rescale(spark):
    df = spark.createDataFrame([(0.9,)], "f1 double")
    assert math.isclose(df.select(S.rescale("f1", 0.8).alias("r")).first()["r"], 0.5)


def test_grouping_sets_fixture(spark):
    df = spark.createDataFrame([("None", "Rename", 1.0, False), ("None", "None", 2.0, False)],
                               "primary_obfuscation string, secondary_obfuscation string, f1 double, is_error boolean")
    rows = {(r["scope"], r["secondary_obfuscation"]): r["mean_f1"] for r in E.grouped_report(df).collect()}
    assert rows == {("cell", "Rename"): 1.0, ("cell", "None"): 2.0, ("overall", None): 1.5}


def test_grouping_level_named_overall_and_empty_group(spark):
    df = spark.createDataFrame([("overall", "x", 1.0, True)],
                               "primary_obfuscation string, secondary_obfuscation string, f1 double, is_error boolean")
    rows = E.grouped_report(df).collect()
    assert {r["scope"] for r in rows} == {"cell", "overall"}
    assert all(r["mean_f1"] is None and r["n_errors"] == 1 for r in rows)  # all failed: NULL mean


def test_nested_report_roundtrip(spark):
    df = spark.createDataFrame([("A", "x", 1.0, False), ("A", "y", 3.0, False), ("B", "x", 2.0, False)],
                               "primary_obfuscation string, secondary_obfuscation string, f1 double, is_error boolean")
    nested = E.nested_report(E.grouped_report(df))
    row = nested.first()
    assert row["overall"] == 2.0 and row["by_primary"] == {"A": {"x": 1.0, "y": 3.0}, "B": {"x": 2.0}}
    assert '"overall":2.0' in E.nested_report_json(nested).first()["report"]


def test_encoder_hook(spark):
    def encode(texts):
        # stub contextual encoder: one 2-d vector per character class of each word
        return [[[1.0, 0.0] if w[0] < "n" else [0.0, 1.0] for w in t.split()] or [[0.0, 0.0]] for t in texts]
    enc = S.encoder_udf(encode)
    df = spark.createDataFrame([(1, "alpha zulu", "apple zebra")], "id bigint, p string, r string")
    row = S.greedy_match_encoded(df, ["id"], "p", "r", enc).first()
    assert (row["precision"], row["recall"], row["f1"]) == (1.0, 1.0, 1.0)


def test_vocabulary_covers_the_whole_table(spark):
    vecs = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)] + [(9, None), (None, [1.0, 1.0])],
                                 "vec_id bigint, embedding array<float>")
    df = spark.createDataFrame([(1, "a b c a", "c d e")], "id bigint, p string, r string")
    whole = S.greedy_match(df, ["id"], "p", "r", vecs).first()
    fixed = S.greedy_match(df, ["id"], "p", "r", vecs, buckets=10).first()  # ids 0..9
    assert whole[1:] == fixed[1:]


def test_repeated_ids_use_one_vector(spark):
    df = spark.createDataFrame([(1, "a b", "c d e")], "id bigint, p string, r string")
    one = [(i, [1.0, float(i)]) for i in range(5)]
    schema = "vec_id bigint, embedding array<float>"
    got = [S.greedy_match(df, ["id"], "p", "r", spark.createDataFrame(v, schema), buckets=5).first()
           for v in (one, one + [(2, [9.0, 0.0])], one + one)]
    assert got[0][1:] == got[1][1:] == got[2][1:]


def _brute_f1(pred, ref, nb=2):
    import hashlib
    import re

    def b(t):
        return int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % nb
    p = [b(t) for t in re.findall("[a-z0-9]+", pred.lower())]
    r = [b(t) for t in re.findall("[a-z0-9]+", ref.lower())]
    if not p or not r:
        return 0.0
    prec = sum(max(float(x == y) for y in r) for x in p) / len(p)
    rec = sum(max(float(x == y) for y in p) for x in r) / len(r)
    return 2 * prec * rec / (prec + rec) if prec + rec else 0.0


def test_score_samples_modes(spark):
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    gens = {1: ["alpha", "alpha beta gamma", "zzz qq"], 2: ["one two", "three"], 3: []}
    refs = {1: "alpha beta", 2: "four five six", 3: "x"}
    df = spark.createDataFrame([(k, gens[k], refs[k]) for k in gens], "id bigint, gen array<string>, ans string")
    got = {m: {r["id"]: round(r["f1"], 9) for r in
               S.score_samples(df, ["id"], "gen", "ans", vecs, m, buckets=2).collect()}
           for m in ("first", "best", "mean")}
    for k in (1, 2):
        f = [_brute_f1(g, refs[k]) for g in gens[k]]
        assert got["first"][k] == round(f[0], 9)
        assert got["best"][k] == round(max(f), 9)
        assert got["mean"][k] == round(sum(f) / len(f), 9)
    assert 3 not in got["first"] and 3 not in got["best"]


def _long_tables(spark, n=2000, words=4000):
    import random
    r = random.Random(1)
    vecs = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(0, n, 2)]
                                 + [(n - 1, [1.0] * 8), (1, [0.0] * 8), (3, [None] + [1.0] * 7), (5, [float("nan")] * 8)],
                                 "vec_id bigint, embedding array<double>")
    rows = [(1, " ".join(f"w{i}" for i in range(words)), " ".join(f"v{i}" for i in range(words))),
            (2, "été 中文 naïve", "été 中文 x"), (2, "été 中文 naïve", "été 中文 x"), (None, "a", "b"), (3, "", "b"), (4, None, None)]
    rows += [(10 + i, " ".join(f"a{r.randrange(9)}" for _ in range(i)), " ".join(f"a{r.randrange(9)}" for _ in range(20))) for i in range(9)]
    return vecs, spark.createDataFrame(rows, "id bigint, p string, r string")


def test_both_ways_give_the_same_scores(spark):
    """The broadcast matrix and the join of the sides, with an example of thousands of distinct tokens."""
    vecs, df = _long_tables(spark)
    fix = lambda rows: sorted((str(r["id"]), *[round(x, 9) for x in r[1:]]) for r in rows)
    a = fix(S.greedy_match(df, ["id"], "p", "r", vecs).collect())
    b = fix(S.greedy_match(df, ["id"], "p", "r", vecs, matrix_bytes=0).collect())
    assert a == b and len(a) == df.count()
    assert all(0 <= x <= 1 + 1e-9 or x < 0 for row in a for x in row[1:])


def test_letters_of_every_script_are_tokens(spark):
    vecs = spark.createDataFrame([(i, [1.0 if j == i else 0.0 for j in range(64)]) for i in range(64)],
                                 "vec_id bigint, embedding array<double>")
    df = spark.createDataFrame([(1, "中文 été", "中文 été"), (2, "中文", "日本")], "id bigint, p string, r string")
    got = {r["id"]: r["f1"] for r in S.greedy_match(df, ["id"], "p", "r", vecs).collect()}
    assert got[1] == 1.0 and got[2] < 1.0


def test_no_array_of_vectors_is_shuffled(spark):
    vecs, df = _long_tables(spark, 50, 5)
    plan = S.greedy_match(df, ["id"], "p", "r", vecs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = S.greedy_match(df, ["id"], "p", "r", vecs, matrix_bytes=0)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_tiles_change_nothing(monkeypatch):
    r = np.random.default_rng(3)
    m = r.normal(size=(300, 6))
    a, b = r.integers(0, 300, 130), r.integers(0, 300, 77)
    sim = m[a] @ m[b].T
    monkeypatch.setattr(S, "TILE", 16)
    x, y = S._best(m, a, b)
    assert np.allclose(x, sim.max(axis=1)) and np.allclose(y, sim.max(axis=0))
