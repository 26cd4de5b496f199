"""Contamination of the documents by the texts of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contamination as C
from ..sources.tables import table
from .registry import query


def _normal_sql(col: str) -> str:
    return f"(' ' || array_to_string(regexp_extract_all(lower(coalesce({col}, '')), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ')"


_SQL = f"""
    SELECT doc_id, item_id, source,
           (length(substr(dt, 1, strpos(dt, bt))) - length(replace(substr(dt, 1, strpos(dt, bt)), ' ', '')) - 1)::BIGINT
             AS first_word
    FROM (SELECT doc_id, source, {_normal_sql('text')} AS dt FROM documents) d
    JOIN (SELECT item_id, {_normal_sql('text')} AS bt FROM benchmark) b ON bt <> '  ' AND contains(dt, bt)"""


@query("contamination", sql=f"SELECT doc_id, item_id, first_word FROM ({_SQL}) c")
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark text that occurs in it, and the place."""
    return C.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("contamination_report", sql=f"""
    SELECT source, count(DISTINCT doc_id)::BIGINT AS n_documents, count(DISTINCT item_id)::BIGINT AS n_items,
           count(*)::BIGINT AS n_pairs, min(doc_id) AS first_doc_id
    FROM ({_SQL}) c GROUP BY source""")
def contamination_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents and leaked benchmark texts by source."""
    docs = table(spark, sf_dir, "documents")
    found = C.contamination(docs, table(spark, sf_dir, "benchmark"))
    pairs = docs.select("doc_id", "source").join(found, "doc_id")
    return pairs.groupBy("source").agg(
        F.count_distinct("doc_id").alias("n_documents"), F.count_distinct("item_id").alias("n_items"),
        F.count(F.lit(1)).alias("n_pairs"), F.min("doc_id").alias("first_doc_id"))
