import os
import time

from pyspark.sql import functions as F

from codequarry.streaming.ingest import once_writer, run_incremental


def test_incremental_runs_are_idempotent(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    sink, ckpt = os.path.join(tmp_dir, "sink"), os.path.join(tmp_dir, "ckpt")
    spark.range(0, 50).write.parquet(os.path.join(src, "part1"))
    schema = spark.read.parquet(os.path.join(src, "part1")).schema

    def double(df):
        return df.withColumn("twice", F.col("id") * 2)

    glob = os.path.join(src, "*")
    run_incremental(spark, glob, schema, ["id"], double, sink, ckpt)
    spark.range(40, 80).write.parquet(os.path.join(src, "part2"))  # overlaps 40..49
    out = run_incremental(spark, glob, schema, ["id"], double, sink, ckpt)
    out = run_incremental(spark, glob, schema, ["id"], double, sink, ckpt)  # nothing new
    ids = [r["id"] for r in out.collect()]
    assert sorted(ids) == list(range(80))


def test_key_that_returns_after_its_state_ended(spark, tmp_dir):
    src, sink, ckpt = (os.path.join(tmp_dir, x) for x in ("in", "sink", "ckpt"))
    glob, progress = os.path.join(src, "*"), []

    def arrive(n, df):
        df.write.parquet(os.path.join(src, f"part{n}"))
        reports: list = []
        out = run_incremental(spark, glob, df.schema, ["id"], lambda b: b.withColumn("twice", F.col("id") * 2), sink, ckpt,
                              ttl="1 second", progress=reports)
        progress.append(reports)
        time.sleep(3)
        return out

    arrive(1, spark.range(0, 2000))
    arrive(2, spark.range(5000, 5010))
    arrive(3, spark.range(6000, 6010))  # moves the watermark past the first keys
    held = [r["stateOperators"][0]["numRowsTotal"] for r in progress[-1]]
    out = arrive(4, spark.range(1990, 2005).union(spark.range(1990, 2005)))
    ids = sorted(r["id"] for r in out.collect())
    assert ids == [*range(0, 2005), *range(5000, 5010), *range(6000, 6010)]
    assert max(r["stateOperators"][0]["numRowsTotal"] for r in progress[0]) == 2000
    assert held[-1] <= 20


def test_replayed_batch_writes_its_rows_again(spark, tmp_dir):
    sink = os.path.join(tmp_dir, "sink")
    write = once_writer(sink, lambda b: b, ["id", "part"])
    first = spark.createDataFrame([(1, None), (1, ""), (None, "a")], "id long, part string")
    write(first, 0)
    write(first, 0)
    write(first.union(spark.createDataFrame([(2, None)], first.schema)), 1)
    rows = [tuple(r) for r in spark.read.parquet(sink).collect()]
    assert sorted(rows, key=repr) == sorted([(1, None, 0), (1, "", 0), (None, "a", 0), (2, None, 1)], key=repr)
