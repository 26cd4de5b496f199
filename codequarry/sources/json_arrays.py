"""JSON arrays of records, read and written by many tasks.

Reading.  Spark's text source splits a file into byte ranges and cuts it at
closing braces (``lineSep``).  A brace closes a record where it lies outside
of strings and no object is open any more.  Whether a range begins inside a
string, and how deep, is not known in its task; but the quotes and braces of
a range can be counted for both cases.  One small row for each range then
gives its start by prefix sums over the ranges of its file, running sums
inside the range do the rest, and the pieces of each record are put together
and parsed.  Strings and escapes are respected; a record may lie across
ranges.

Writing.  Rows are numbered in ranges (:mod:`..operators.ordinals`) and
written in that order as text, the first with an opening bracket, the others
with a comma before them, the last with a closing one: the part files, put
together in the order of their names, are one JSON array.

Defined results: an array of records in UTF-8, alone or as the parts of one
array; white space around records is free; ``[]`` and an empty file have no
rows; text after the last record other than the closing bracket, and a
record that does not parse, fail the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordinals import numbered

_END = "}"


def _objects(segments: Column, odd: int) -> Column:
    """Opening braces in every second segment, from the first or the second one."""
    kept = F.filter(segments, lambda s, i: F.pmod(i, F.lit(2)) == odd)
    return F.aggregate(F.transform(kept, lambda s: F.length(s) - F.length(F.replace(s, F.lit("{"), F.lit("")))),
                       F.lit(0), lambda a, x: a + x)


def read_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The records of the JSON array (or the parts of one) at ``path``."""
    place = F.monotonically_increasing_id().alias("at")
    raw = spark.read.option("lineSep", _END).text(path).select(
        F.col("value").alias("piece"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), place)
    # without escapes, every second segment between quotes is a string
    segments = F.split(F.regexp_replace("piece", r"(?s)\\.", "__"), '"', -1)
    cut = raw.select("*", segments.alias("s")).select(
        "file", "block", "at", "piece", (F.size("s") - 1).cast("long").alias("quotes"),
        _objects(F.col("s"), 0).cast("long").alias("open0"), _objects(F.col("s"), 1).cast("long").alias("open1"))

    # inside a range, for a range that begins outside (0) or inside (1) of a string
    row = Window.partitionBy("file", "block").orderBy("at")
    upto = row.rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("quotes").over(upto) - F.col("quotes")
    cut = cut.withColumn("inside", F.pmod(before, F.lit(2)))
    for start in (0, 1):
        here = F.pmod(F.col("inside") + start, F.lit(2))  # whether the piece itself begins in a string
        closes = F.when(F.pmod(here + F.col("quotes"), F.lit(2)) == 0, 1).otherwise(0)
        opens = F.when(here == 0, F.col("open0")).otherwise(F.col("open1"))
        cut = cut.withColumn(f"closes{start}", closes).withColumn(f"step{start}", opens - closes)
    # one row for each range of a file: its start
    ranges = cut.groupBy("file", "block").agg(F.sum("quotes").alias("q"), F.sum("step0").alias("d0"), F.sum("step1").alias("d1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("in_string", F.pmod(F.coalesce(F.sum("q").over(earlier), F.lit(0)), F.lit(2)))
    ranges = ranges.withColumn("d", F.when(F.col("in_string") == 0, F.col("d0")).otherwise(F.col("d1")))
    ranges = ranges.select("file", "block", "in_string", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("depth0"),
                           F.sum("d").over(Window.partitionBy("file")).alias("total"))

    here = cut.join(ranges, ["file", "block"])
    pick = lambda a, b: F.when(F.col("in_string") == 0, F.col(a)).otherwise(F.col(b))
    here = here.select("file", "block", "at", "piece", "depth0", "total", pick("closes0", "closes1").alias("closes"),
                       pick("step0", "step1").alias("step"))
    depth = F.col("depth0") + F.sum("step").over(upto)
    here = here.withColumn("end", F.when((F.col("closes") == 1) & (depth == 0), 1).otherwise(0))
    # a record is named by the range and number of the record end before it
    ends = here.groupBy("file", "block").agg(F.sum("end").alias("n"))
    ends = ends.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ends0"))
    here = here.withColumn("ends", F.sum("end").over(upto) - F.col("end")).join(ends, ["file", "block"])
    parts = here.groupBy("file", (F.col("ends0") + F.col("ends")).alias("record")).agg(
        F.max("end").alias("ended"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("block", "at", "piece"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x.piece), _END)
    body = F.regexp_replace(text, r"\A[\s,\[]+", "")
    # The last piece of a file has no brace behind it, but was counted with one: an array
    # that is whole ends one below.  What follows the last record is a bracket or white space.
    fault = F.raise_error(F.concat(F.lit("not an array of records: "), F.col("file"))).cast("boolean")
    keep = F.when(F.col("total") != -1, fault).when(F.col("ended") == 1, F.lit(True)).when(text.rlike(r"\A[\s\[\],]*\z"), F.lit(False)).otherwise(fault)
    records = parts.filter(keep).select(F.concat(body, F.lit(_END)).alias("r"))
    return records.select(F.from_json("r", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_array(df: DataFrame, path: str) -> None:
    """The rows, ordered by their JSON text, as the parts of one JSON array under ``path``.

    ``cat part-*`` gives the array; :func:`read_array` reads the folder.
    """
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("r"))
    rows = numbered(rows, [F.col("r")], ordinal="n", total="total")
    first, last = F.col("n") == 0, F.col("n") == F.col("total") - 1
    line = F.concat(F.when(first, F.lit("[")).otherwise(F.lit(",\n")), F.col("r"), F.when(last, F.lit("]\n")).otherwise(F.lit("")))
    # no line separator: a part goes on where the one before it ends
    out = rows.orderBy("n").select(line.alias("value"))
    out.write.mode("overwrite").option("lineSep", " ").text(path)
