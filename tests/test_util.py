from pyspark.sql import functions as F

from codequarry.operators import util as U


def test_distinct_by_key_has_one_exchange(spark):
    df = spark.createDataFrame([(i % 3, f"t{i % 3}") for i in range(30)], "k bigint, v string")
    out = U.distinct_by_key(df, "k")
    assert sorted((r["k"], r["v"]) for r in out.collect()) == [(0, "t0"), (1, "t1"), (2, "t2")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_join_on_key_null_stays_unmatched(spark):
    left = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, text string")
    right = spark.createDataFrame([("0cc175b9c0f1b6a831c399e269772661", "A")], "k string, v string")
    out = {r["id"]: r["v"] for r in U.join_on_key(left, right, F.md5("text"), "k", "left").collect()}
    assert out == {1: "A", 2: None}
    assert "k" not in U.join_on_key(left, right, F.md5("text"), "k", "left").columns
