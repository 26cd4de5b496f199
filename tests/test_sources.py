import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.sources import readers as R
from codequarry.sources import sinks

SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("code", T.StringType())])


def test_jsonl_bad_lines_counted(spark, tmp_dir):
    p = os.path.join(tmp_dir, "a.jsonl")
    with open(p, "w") as f:
        f.write('{"row_id": 1, "code": "x"}\n{bad\n{"row_id": 2, "code": "y"}\n')
    good, bad = R.read_jsonl(spark, p, SCHEMA)
    assert good.count() == 2 and bad.count() == 1


def test_json_array(spark, tmp_dir):
    p = os.path.join(tmp_dir, "a.json")
    with open(p, "w") as f:
        json.dump([{"row_id": 1, "code": "x"}, {"row_id": 2, "code": "y"}], f)
    assert R.read_json_array(spark, p, SCHEMA).count() == 2


def test_json_array_round_trip(spark, tmp_dir):
    rows = [(1, "x\ny"), (2, None), (None, 'q"uote'), (3, "é")]
    p = os.path.join(tmp_dir, "out")
    sinks.write_json_array(spark.createDataFrame(rows, SCHEMA).repartition(3), p)
    back = R.read_json_array(spark, p, SCHEMA).collect()
    assert sorted(map(tuple, back), key=str) == sorted(rows, key=str)
    sinks.write_json_array(spark.createDataFrame([], SCHEMA), os.path.join(tmp_dir, "none"))
    assert R.read_json_array(spark, os.path.join(tmp_dir, "none"), SCHEMA).count() == 0


def test_load_data_router(spark):
    with pytest.raises(ValueError):
        R.load_data(spark, "nope")
    with pytest.raises(NotImplementedError):
        R.load_data(spark, "codecontests")


def test_seeded_slice_partition_independent(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id")
    a = [r[0] for r in R.seeded_slice(d.repartition(1), "doc_id", 14, 5, 25).collect()]
    b = [r[0] for r in R.seeded_slice(d.repartition(7), "doc_id", 14, 5, 25).collect()]
    assert a == b and len(a) == 20


def test_seeded_slice_unshuffled(spark):
    d = spark.range(10).withColumnRenamed("id", "k")
    assert [r[0] for r in R.seeded_slice(d, "k", 0, 2, 5).collect()] == [2, 3, 4]


def test_open_slice_skips_the_first_rows_without_a_single_task_offset(spark):
    d = spark.range(10).withColumnRenamed("id", "k")
    out = R.seeded_slice(d, "k", 0, 7)
    assert [r[0] for r in out.collect()] == [7, 8, 9]
    assert "CollectLimit" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r[0] for r in R.seeded_slice(d, "k", 5, 0).collect()) == list(range(10))
    with_first = {r[0] for r in R.seeded_slice(d, "k", 5, 0, 4).collect()}
    assert with_first | {r[0] for r in R.seeded_slice(d, "k", 5, 4).collect()} == set(range(10))


def test_open_slice_counts_repeated_and_null_keys(spark):
    keys = [None, None, 1, 1, 1, 2, 3, 3]
    d = spark.createDataFrame([(k, i, -i) for i, k in enumerate(keys)], "k int, i int, o int").repartition(3)
    for start in range(1, len(keys) + 2):
        assert [r.k for r in R.seeded_slice(d, "k", 0, start).collect()] == keys[start:]
    assert [r.o for r in R.seeded_slice(d, "k", 0, 3, order_col="o").collect()] == [-4, -3, -2, -1, 0]
    whole = [r.k for r in R.seeded_slice(d, "k", 5).collect()]
    for start in range(1, len(keys)):
        assert [r.k for r in R.seeded_slice(d, "k", 5, start).collect()] == whole[start:]
    assert R.seeded_slice(d, "k", 5, 4).columns == d.columns


def test_answers_layout_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "m1", "with_code", 0.5), (2, "m2", "question_only", 0.7)],
                               "qa_id bigint, model string, prompt_mode string, f1 double")
    sinks.write_answers(df, tmp_dir, mode="overwrite")
    got = sinks.read_answers(spark, tmp_dir, model="m1")
    assert got.count() == 1 and set(got.columns) >= {"model", "prompt_mode"}


def test_docstring_examples(spark):
    df = spark.createDataFrame(
        [(1, 'def f():\n    """Doc. x"""\n    return 1', "Doc. x", ["Doc", ".", "x"], "p")],
        "row_id bigint, code string, docstring string, docstring_tokens array<string>, path string")
    row = R.clean_docstring_examples(df).first()
    assert row["input"] == "def f():\n    return 1" and row["output"] == "Doc. x" and row["path"] == "p"
    assert row["leaked"] is False


def test_sample_and_size_check(spark):
    d = spark.range(50).withColumnRenamed("id", "k")
    s = R.seeded_sample(d, "k", 11797, 10)
    assert R.check_size(s, 10) is s
    with pytest.raises(ValueError):
        R.check_size(s, 11)
    assert R.seeded_sample(d, "k", 1, None).count() == 50


def test_write_records_partitioned(spark, tmp_dir):
    df = spark.createDataFrame([(1, "None", "x"), (2, "Rename", "y")], "qa_id bigint, level string, code string")
    sinks.write_records(df, tmp_dir, partition_by=["level"])
    back = spark.read.parquet(tmp_dir)
    assert back.filter(F.col("level") == "Rename").count() == 1


def test_intent_examples(spark):
    df = spark.createDataFrame(
        [("def f_3844801(myList):\n", "check if all elements in list are identical", "\treturn len(set(myList)) == 1", "\n")],
        "prompt string, intent string, canonical_solution string, suffix string")
    row = R.intent_examples(df).first()
    assert row["input"] == "def check_if_all_elements(myList):\n    return len(set(myList)) == 1"
    assert row["output"] == "check if all elements in list are identical"


def test_load_data_csn(spark, tmp_dir):
    p = os.path.join(tmp_dir, "csn.jsonl")
    rows = [{"row_id": i, "code": f'def f{i}():\n    """Doc {i} ."""\n    return {i}',
             "docstring": f"Doc {i} .", "docstring_tokens": ["Doc", str(i), "."], "path": f"p{i}"}
            for i in range(6)]
    with open(p, "w") as f:
        for r in rows[:3]:
            f.write(json.dumps(r) + "\n")
        f.write("{broken\n")
        for r in rows[3:]:
            f.write(json.dumps(r) + "\n")
    out = R.load_data(spark, "csn", path=p, seed=14, start=1, end=4)
    got = out.collect()
    assert len(got) == 3
    for r in got:
        i = r["row_id"]
        assert r["input"] == f"def f{i}():\n    return {i}" and r["output"] == f"Doc {i}." and not r["leaked"]
    full = R.load_data(spark, "csn", path=p, seed=14)
    assert full.count() == 6


def test_answer_layout_prunes_partitions(spark, tmp_dir):
    import contextlib
    import io
    df = spark.createDataFrame([(1, "m1", "with_code", 0.5), (2, "m2", "question_only", 0.7)],
                               "qa_id bigint, model string, prompt_mode string, f1 double")
    sinks.write_answers(df, tmp_dir, mode="overwrite")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        sinks.read_answers(spark, tmp_dir, model="m1", prompt_mode="with_code").explain()
    plan = buf.getvalue()
    assert "PartitionFilters: [" in plan and "(model#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_corpus_scan_reads_two_columns(spark):
    import contextlib
    import io
    from codequarry.sources.tables import corpus
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        corpus(spark, "/root/testdata/sf0.001").explain()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in buf.getvalue()


def test_large_slices_are_cut_by_row_numbers(spark, monkeypatch):
    """Slices beyond the top-k bound: the same rows in the same order, with 1 and 200 partitions and a repeated key."""
    d = spark.range(0, 600).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    whole = [r.k for r in R.seeded_slice(d, "k", 5).collect()]
    small = [r.k for r in R.seeded_slice(d, "k", 5, 20, 450).collect()]
    monkeypatch.setattr(R, "TOP_ROWS", 10)
    for parts in (1, 200):
        df = R.seeded_slice(d.repartition(parts), "k", 5, 20, 450)
        assert [r.k for r in df.collect()] == small == whole[20:450]
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Limit" not in plan and "Offset" not in plan
    assert [r.k for r in R.seeded_slice(d, "k", 0, 20, 450).collect()] == sorted(r.k for r in d.collect())[20:450]


def hard_records(n):
    """Records whose strings hold braces, brackets, quotes, backslashes and record borders."""
    bits = ["}, {", "{", "}", "]", '"', "\\", '\\"', "é中😀", "\n", "plain", "[", '"}', "\\}"]
    return [{"row_id": i, "code": "".join(bits[(i * 7 + k * (i % 5 + 1)) % len(bits)] for k in range(i % 9)) if i % 11 else None,
             "more": [{"a": {"b": "}" * (i % 3)}}]} for i in range(n)]


@pytest.mark.parametrize("style", [{}, {"indent": 1}, {"separators": (",", ":")}, {"ensure_ascii": False}])
@pytest.mark.parametrize("split", [64, 997, 1 << 27])
def test_json_array_is_read_by_many_tasks(spark, tmp_dir, style, split):
    rows = hard_records(300)
    p = os.path.join(tmp_dir, "a.json")
    with open(p, "w", encoding="utf-8") as f:
        json.dump(rows, f, **style)
    schema = "row_id long, code string, more array<struct<a:struct<b:string>>>"
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = R.read_json_array(spark, p, schema)
        got = sorted((r.row_id, r.code, r.more[0].a.b) for r in df.collect())
        parts = spark.read.option("lineSep", "}").text(p).rdd.getNumPartitions()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted((r["row_id"], r["code"], r["more"][0]["a"]["b"]) for r in rows)
    assert parts > 1 or split == 1 << 27


def test_json_array_parts_make_one_array(spark, tmp_dir):
    rows = hard_records(200)
    df = spark.createDataFrame([(r["row_id"], r["code"]) for r in rows], SCHEMA).repartition(7)
    p = os.path.join(tmp_dir, "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_json_array(df, p)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    names = sorted(f for f in os.listdir(p) if f.startswith("part-"))
    whole = json.loads("".join(open(os.path.join(p, f), encoding="utf-8").read() for f in names))
    assert len(names) > 1
    assert sorted((r["row_id"], r["code"]) for r in whole) == sorted((r["row_id"], r["code"]) for r in rows)
    assert sorted(map(tuple, R.read_json_array(spark, p, SCHEMA).collect())) == sorted((r["row_id"], r["code"]) for r in rows)


def test_json_array_faults_are_errors(spark, tmp_dir):
    for name, text in (("cut", '[{"row_id": 1, "code": "x"}, {"row_id": 2'), ("tail", '[{"row_id": 1}] x'), ("bad", '[{"row_id": "x" 1}]')):
        p = os.path.join(tmp_dir, name)
        with open(p, "w") as f:
            f.write(text)
        with pytest.raises(Exception):
            R.read_json_array(spark, p, SCHEMA).collect()
    for name, text in (("none", "[]"), ("space", " [ ]\n"), ("empty", "")):
        p = os.path.join(tmp_dir, name)
        with open(p, "w") as f:
            f.write(text)
        assert R.read_json_array(spark, p, SCHEMA).count() == 0
