"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

Two texts are equal when identical without white space.  Each text is cut
into chunks at places that its own characters choose, every chunk becomes a
verified identifier, and a document becomes the ordered list of its
identifiers: its recipe.  Equal recipes mean equal texts.

* Chunks: at least ``MIN_CHUNK`` characters, ending after a mark, at most
  ``MAX_CHUNK``.  A cut depends on the text alone, so equal texts are cut
  alike, and near copies share most chunks.
* Verified identifiers: ``width`` 64-bit hashes of the chunk.  The distinct
  (identifier, chunk) pairs, deduplicated within each map task, are shuffled
  once; if any identifier has two texts, the width grows and the check runs
  again.  So an identifier stands for one chunk text of this corpus exactly.
* Recipes (8 bytes for some hundreds of characters) are then grouped and
  joined; the long texts move no further than that one chunk shuffle.

A hot group of copies is pre-aggregated before the shuffle on recipes; in
the join back to the rows the hottest groups, a bounded number, are
broadcast, so their rows are not shuffled at all.

Defined results: a NULL text counts as empty, and empty texts are equal to
each other; a NULL ``doc_id`` sorts after all others; of rows that repeat
both ``doc_id`` and text exactly one is kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, join_hot, keep_rows, row_digest, staged

MIN_CHUNK = 256
MAX_CHUNK = 2048
# A chunk ends after one of these marks once it has MIN_CHUNK characters.
MARKS = ".!?;:,"


def normalised(text: Column) -> Column:
    """``text`` (NULL: empty) without white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", "")


def chunk_pattern(min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> str:
    """The shortest run of min..max characters that ends in a mark, else max characters or what is left."""
    return f"(?s).{{{min_chunk},{max_chunk - 1}}}?[{MARKS}]|.{{1,{max_chunk}}}"


def chunks(normal: Column, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> Column:
    return F.regexp_extract_all(normal, F.lit(chunk_pattern(min_chunk, max_chunk)), F.lit(0))


def identifier(chunk: Column, width: int, bits: int = 64) -> Column:
    """``width`` hashes of a chunk; fewer ``bits`` in the first force collisions, for tests."""
    first = F.xxhash64(chunk)
    if bits < 64:
        first = F.shiftrightunsigned(first, 64 - bits)
    return F.array(first, *[F.xxhash64(F.lit(i), chunk) for i in range(1, width)])


def verified_width(docs: DataFrame, bits: int = 64, **cut) -> int:
    """The least width at which no identifier stands for two chunk texts of ``docs``."""
    parts = docs.select(F.explode(chunks(normalised(F.col("text")), **cut)).alias("chunk"))
    width = 1
    while True:
        pairs = parts.select(identifier(F.col("chunk"), width, bits).alias("id"), "chunk").distinct()
        if pairs.groupBy("id").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").isEmpty():
            return width
        width += 1


def recipes(docs: DataFrame, width: int, bits: int = 64, **cut) -> DataFrame:
    """(doc_id, digest, n_chars, sha, recipe, rid): one small row for each row of ``docs``."""
    base = docs.select("doc_id", row_digest(F.col("text")).alias("digest"),
                       F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_chars"),
                       normalised(F.col("text")).alias("normal"))
    recipe = F.flatten(F.transform(chunks(F.col("normal"), **cut), lambda c: identifier(c, width, bits)))
    return base.select("doc_id", "digest", "n_chars", F.sha2("normal", 256).alias("sha"), recipe.alias("recipe"),
                       F.monotonically_increasing_id().alias("rid"))


def exact_groups(spark: SparkSession, docs: DataFrame, bits: int = 64, **cut) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256
    (and digest, keep_digest: of the row's own and of the kept row's raw text)."""
    docs = docs.select("doc_id", "text")
    rows = staged(spark, recipes(docs, verified_width(docs, bits, **cut), bits, **cut), "recipes")
    # longest text first, then smallest doc_id (NULL last); rid settles full repeats
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("u"), "doc_id", "rid", "digest")
    groups = rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
    groups = staged(spark, groups, "recipe-groups")
    sizes = groups.select("recipe", F.col("group_size").alias("n"))
    j = join_hot(rows, groups, "recipe", sizes, rows.count())
    return j.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
                    (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("sha").alias("text_sha256"),
                    "digest", F.col("best.digest").alias("keep_digest"))


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    g = exact_groups(spark, docs)
    same = g.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep_digest")))
    keys = same.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_dg")).agg(
        F.count(F.lit(1)).alias("_reps"))
    return keep_rows(docs, staged(spark, keys, "exact-keys"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(spark, docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = """
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS n,
             regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents) d
WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST)
"""
