"""Distributed row numbers against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from codequarry.operators.ordinals import Ordered, numbered


def table(spark, n=3000, seed=1, hot=0.34):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]) if r.random() > hot else "hot", None if r.random() < 0.02 else r.randrange(500), i)
            for i in range(n)]
    return spark.createDataFrame(rows, "g string, k long, i long")


@pytest.mark.parametrize("ranges", [1, 8, 200])
def test_numbers_follow_the_order(spark, ranges):
    df = table(spark)
    rows = numbered(df, [F.col("k"), F.col("i")], total="n", ranges=ranges).collect()
    assert [(r.g, r.k, r.i) for r in sorted(rows, key=lambda r: r.ordinal)] == sorted(
        map(tuple, df.collect()), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert sorted(r.ordinal for r in rows) == list(range(3000)) and {r.n for r in rows} == {3000}


@pytest.mark.parametrize("parts", [1, 200])
def test_numbers_by_group_with_null_group(spark, parts):
    df = table(spark).repartition(parts)
    got = {r.i: (r.ordinal, r.n) for r in numbered(df, [F.col("k"), F.col("i")], [F.col("g")], total="n").collect()}
    groups = {}
    for g, k, i in map(tuple, df.collect()):
        groups.setdefault(g, []).append((k is not None, k or 0, i))
    assert got == {i: (n, len(v)) for v in groups.values() for n, (_, _, i) in enumerate(sorted(v))}


def test_a_repeated_key_is_dealt_to_many_ranges(spark):
    df = spark.range(0, 9000, 1, 40).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("k"))
    out = numbered(df, [F.col("k")], ranges=20)
    rows = out.collect()
    assert sorted(r.ordinal for r in rows) == list(range(9000))
    assert [r.k for r in sorted(rows, key=lambda r: r.ordinal)] == sorted(r.k for r in df.collect())
    placed = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in placed
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 9000


def test_clashing_names_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "x", 2)], "_row long, _w0 string, _at long")
    assert numbered(df, [F.col("_row")], [F.col("_w0")]).collect()[0].asDict() == {"_row": 1, "_w0": "x", "_at": 2, "ordinal": 0}
    assert numbered(df.limit(0), [F.col("_row")]).count() == 0


@pytest.mark.parametrize("ranges", [1, 7, 200])
def test_running_sums_and_next_rows_by_group(spark, ranges):
    df = table(spark).withColumn("v", F.when(F.col("i") % 11 != 0, F.col("i") % 7))
    o = Ordered(df, [F.col("k"), F.col("i")], [F.col("g")], ranges)
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append((r.k is not None, r.k or 0, r.i, r.v))
    sums, after = {}, {}
    for rows in groups.values():
        rows.sort(key=lambda x: x[:3])
        total = 0
        for n, (_, _, i, v) in enumerate(rows):
            sums[i], after[i] = total, (rows[n + 1][2], rows[n + 1][3]) if n + 1 < len(rows) else (None, None)
            total += v or 0
    assert {r.i: r.before for r in o.sums_before(before="v").collect()} == sums
    assert {r.i: (r.j, r.w) for r in o.next(j="i", w="v").collect()} == after


def test_next_row_of_a_table_without_groups(spark):
    df = spark.range(0, 500, 1, 9)
    rows = Ordered(df, [F.col("id")], ranges=16).next(after="id").collect()
    assert {r.id: r.after for r in rows} == {i: i + 1 if i < 499 else None for i in range(500)}
