"""Incremental ingest query (Structured Streaming, availableNow)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..operators import infer as I
from ..session import scratch_path
from . import catalog
from ..sources import readers as R
from ..streaming.ingest import run_incremental
from .q_sources import PROPS_SCHEMA
from .registry import query


_SQL_INGEST = """
    SELECT event_type, count(*)::BIGINT AS n_events,
           sum(TRY_CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS sum_k
    FROM events GROUP BY event_type"""


def _ingest(spark: SparkSession, sf_dir: str, ttl: str | None = None) -> DataFrame:
    src = f"{sf_dir.rstrip('/')}/events*.parquet"  # the stream source takes a folder or a glob
    schema = spark.read.parquet(src).schema
    run = uuid.uuid4().hex[:12]
    sink, ckpt = scratch_path(spark, f"ingest-{run}/sink"), scratch_path(spark, f"ingest-{run}/checkpoint")

    def parse(batch: DataFrame) -> DataFrame:
        parsed = R.parse_json_column(batch, "props", PROPS_SCHEMA)
        return parsed.select("event_id", "event_type", F.col("parsed.k").alias("k"))

    for _ in range(2):
        out = run_incremental(spark, src, schema, ["event_id"], parse, sink, ckpt, ttl=ttl)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).cast("bigint").alias("n_events"),
                                         F.sum("k").cast("bigint").alias("sum_k"))


@query("incremental_ingest", sql=_SQL_INGEST)
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving events ingested by a file stream, run twice (the second run
    finds nothing new), then summarised from the sink."""
    return _ingest(spark, sf_dir)


@query("incremental_ingest_ttl", sql=_SQL_INGEST)
def incremental_ingest_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a key state that ends after an hour, and a table of the keys written."""
    return _ingest(spark, sf_dir, ttl="1 hour")


_QO = P.sql_fill(catalog.QA_TEMPLATE_QUESTION_ONLY, question="text")


@query("incremental_answers", sql=f"""
    SELECT conv_id, turn, {I.sql_hash_completion(_QO)} AS answer
    FROM conversations WHERE role = 'user'""")
def incremental_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving transcript turns answered micro-batch by micro-batch.

    Each micro-batch renders question-only prompts for its user turns, calls
    the batched completer (identical prompts once) and writes its own batch
    partition; a second run finds nothing new.
    """
    src = f"{sf_dir.rstrip('/')}/conversations*.parquet"
    schema = spark.read.parquet(src).schema
    run = uuid.uuid4().hex[:12]
    sink, ckpt = scratch_path(spark, f"answers-{run}/sink"), scratch_path(spark, f"answers-{run}/checkpoint")

    def answer(batch: DataFrame) -> DataFrame:
        users = batch.filter(F.col("role") == "user").select(
            "conv_id", "turn", P.qa_prompt("", "text", "question_only").alias("prompt"))
        out = I.batch_infer(users, "prompt", I.hash_completer, I.GenerationConfig(n=1))
        return out.select("conv_id", "turn", F.get(F.col("generated_answer"), 0).alias("answer"))

    for _ in range(2):
        out = run_incremental(spark, src, schema, ["conv_id", "turn"], answer, sink, ckpt)
    return out.select("conv_id", "turn", "answer")
