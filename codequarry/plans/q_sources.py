"""Source, sampling and normalisation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing as H
from ..sources import readers as R
from ..sources import sinks
from ..sources.tables import corpus, table
from . import catalog
from .registry import query

SAMPLE_N = 100
SLICE_START, SLICE_END = 10, 60


@query("corpus_scan", sql="SELECT doc_id AS code_id, text AS code FROM documents")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text column of the corpus (the scan reads only two columns)."""
    return corpus(spark, sf_dir)


@query("row_count", sql="SELECT count(*)::BIGINT AS n_rows FROM documents")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.row_count(table(spark, sf_dir, "documents"))


PROPS_SCHEMA = T.StructType([T.StructField("k", T.LongType())])


@query("props_parse", sql="""
    SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k,
           json_valid(props) AS is_valid
    FROM events""")
def props_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-row JSON parse of ``events.props``; malformed text gives NULL."""
    ev = R.parse_json_column(table(spark, sf_dir, "events"), "props", PROPS_SCHEMA)
    valid = F.col("parsed").isNotNull()
    return ev.select("event_id", F.col("parsed.k").alias("k"), valid.alias("is_valid"))


@query("seeded_sample", sql=f"""
    SELECT doc_id AS code_id, source FROM documents
    ORDER BY md5('{catalog.DEFAULT_SEED}|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT {SAMPLE_N}""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded shuffle, first n: deterministic in (seed, key), partition-independent.

    Plan: TakeOrderedAndProject keeps n rows per task and merges them (the
    sample size is the feature, not a cap on the work: every row is read
    and ranked).
    """
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("code_id"), "source")
    return d.orderBy(H.seeded_order_key(catalog.DEFAULT_SEED, "code_id"), "code_id").limit(SAMPLE_N)


@query("seeded_slice", sql=f"""
    SELECT doc_id AS row_id, lang FROM documents
    ORDER BY md5('{catalog.DEFAULT_LOAD_SEED}|' || CAST(doc_id AS VARCHAR)), doc_id
    LIMIT {SLICE_END - SLICE_START} OFFSET {SLICE_START}""")
def seeded_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    return R.seeded_slice(d, "row_id", catalog.DEFAULT_LOAD_SEED, SLICE_START, SLICE_END)
