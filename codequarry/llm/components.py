"""Connected components of a link table, by alternating large and small stars.

Each round hangs every node's larger neighbours, then its smaller ones, on
the smallest node it sees; both are a pre-aggregated minimum and a join, so
a hub's links are never gathered in one task.  Rounds are written tables in
the shared folder; the number of rounds grows with the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged


def _print(edges: DataFrame):
    """A fingerprint of a link set: equal sets, equal prints."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, label) for every node in ``links`` (a, b): the smallest node it can reach."""
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    a, b = F.col("a"), F.col("b")
    # every link once, larger node first
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(spark, edges, "links")
    before = None
    while (now := _print(edges)) != before:
        before = now
        # large star: each node's larger neighbours move to the least of all its neighbours
        both = edges.select(F.explode(F.array(pair(a, b), pair(b, a))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node and its smaller neighbours move to the least of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = (edges.join(least, "a").select(F.explode(F.array(pair(a, F.col("m")), pair(b, F.col("m")))).alias("e"))
                      .select("e.a", "e.b").filter("a <> b").distinct())
        edges = staged(spark, edges, "links")
    # all links now lead to a component's smallest node
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(own)
