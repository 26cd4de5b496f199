import math

from pyspark.sql import functions as F

from codequarry.functions import tokens as K


def test_log_softmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    got = df.select(K.log_softmax("v").alias("r")).first()["r"]
    assert [round(x, 6) for x in got] == [-2.407606, -1.407606, -0.407606]


def test_top_k_ties_by_index(spark):
    df = spark.createDataFrame([([0.5, 0.9, 0.9, 0.1],)], "v array<double>")
    got = df.select(K.top_k("v", 3).alias("r")).first()["r"]
    assert [(r["score"], r["idx"]) for r in got] == [(0.9, 1), (0.9, 2), (0.5, 0)]


def test_sequence_logprob_and_text(spark):
    df = spark.createDataFrame(
        [([("a", {"a": 0.2, "b": 0.1}), ("b", {"b": 0.1})],)],
        "toks array<struct<token:string,top_scores:map<string,double>>>")
    row = df.select(K.sequence_logprob("toks").alias("s"), K.sequence_text("toks").alias("t")).first()
    assert math.isclose(row["s"], 0.3) and row["t"] == "ab"


def test_eos_trim(spark):
    df = spark.createDataFrame([(["a", "<e>", "b"],), (["a", "b"],)], "t array<string>")
    got = [r["r"] for r in df.select(K.eos_trim("t", "<e>").alias("r")).collect()]
    assert got == [["a", "<e>"], ["a", "b"]]


def test_split_texts(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],)], "t array<string>")
    assert df.select(K.split_texts("t", 2).alias("r")).first()["r"] == [["a", "b"], ["c", "d"]]


def test_with_chosen_last_write_wins(spark):
    df = spark.createDataFrame([({"x": -1.0, "y": -2.0}, "y", -0.5)], "m map<string,double>, t string, s double")
    got = df.select(K.with_chosen("m", "t", "s").alias("r")).first()["r"]
    assert got == {"x": -1.0, "y": -0.5}


def test_missing_prompt_score(spark):
    df = spark.createDataFrame([(None, "t")], "m map<string,double>, t string")
    assert df.select(K.missing_prompt_score("m", "t").alias("r")).first()["r"] == {"t": 0.0}


def test_with_scalar_is_linear_and_correct(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],)], "v array<double>")
    got = df.select(K.with_scalar("v", F.array_max("v"), lambda x, m: x / m).alias("r")).first()["r"]
    assert got == [0.25, 0.5, 1.0]


def test_score_diff(spark):
    df = spark.createDataFrame([(("a", {"a": 0.2}), ("b", {"b": 0.1}))],
                               "x struct<token:string,top_scores:map<string,double>>, "
                               "y struct<token:string,top_scores:map<string,double>>")
    row = df.select(K.score_diff("x", "y").alias("d"), K.score_diff("x", 5).alias("e")).first()
    assert math.isclose(row["d"], 0.1) and math.isclose(row["e"], -4.8)
