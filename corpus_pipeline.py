"""Corpus pipeline over ``documents``: from raw rows to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again as the next one's
docs.  All but the last return the columns of ``docs``:

1. quality: documents that the line CRF rejects go;
2. exact dedup: of equal texts one row stays;
3. near dedup: of each class of near copies one document stays;
4. mix: documents repeat, or end early, as the sources' targets ask;
5. bpe: doc_id, source, n_tokens, ids and the digests of the ids and of their decoded text.

A trained classifier cannot be written in SQL, so there is no oracle SQL; the
tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codequarry.llm import bpe, exact_dedup, mixing, near_dedup, quality
from codequarry.llm.common import staged
from codequarry.session import ship_package

ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return near_dedup.deduplicate(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return bpe.tokenised(spark, docs, keep=("doc_id", "source"))


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_equal),
    ("near_dedup", drop_near),
    ("mix", mix_sources),
    ("bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokenised corpus: every stage applied to ``documents`` in turn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
