"""Evaluation queries: answered records -> cleaned inputs -> greedy-match
scores -> grouped report (the flagship)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as TX
from ..operators import conversation as C
from ..operators import evaluate as E
from ..operators import scoring as S
from ..session import scratch_path
from ..sources import sinks
from ..sources.tables import table
from . import catalog
from . import sqlbits as Q
from .registry import query

KEYS = ["conv_id", "turn"]
LEVELS = ["primary_obfuscation", "secondary_obfuscation"]
RESCALE_BASELINE = 0.8
FAIL_EVERY = 7


def answered(spark: SparkSession, sf_dir: str, n_samples: int = catalog.DEFAULT_N_SAMPLES) -> DataFrame:
    """Answered records from transcripts.

    Question = a user turn, reference = the assistant turn after it; the two
    level keys come from ``labels`` (quality, toxic -> primary level) and a
    content hash (secondary level).  The answering model is the
    question-echo baseline: every sample repeats the question; a blank
    question, and one in ``FAIL_EVERY`` by hash of the key, yields no sample
    (a failed generation).
    """
    pairs = C.qa_pairs(table(spark, sf_dir, "conversations"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), "quality", "toxic")
    p_idx = F.coalesce(F.col("quality"), F.lit(0)) + 2 * F.coalesce(F.col("toxic"), F.lit(0))
    s_idx = H.md5_bucket(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 4)
    primary = F.array(*[F.lit(x) for x in catalog.PRIMARY_LEVELS])
    secondary = F.array(*[F.lit(x) for x in catalog.SECONDARY_LEVELS])
    key = F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    failed = (TX.strip_ws("question") == "") | (H.md5_bucket(key, FAIL_EVERY) == 0)
    echo = F.when(failed, F.array().cast("array<string>")).otherwise(
        F.array_repeat(F.col("question"), n_samples))
    return (pairs.join(labels, "conv_id", "left")
                 .select(*KEYS, F.try_element_at(primary, (p_idx + 1).cast("int")).alias(LEVELS[0]),
                         F.try_element_at(secondary, (s_idx + 1).cast("int")).alias(LEVELS[1]),
                         "question", "answer", echo.alias("generated_answer")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score row per answered record (every record scored once)."""
    cleaned = S.clean_answers(answered(spark, sf_dir))
    vectors = table(spark, sf_dir, "embeddings")
    return S.greedy_match(cleaned, KEYS + LEVELS + ["is_error"], "prediction", "reference", vectors)


_SQL_ANSWERED = f"""
    SELECT p.conv_id, p.turn,
           {Q.str_list(catalog.PRIMARY_LEVELS)}[1 + coalesce(l.quality, 0) + 2 * coalesce(l.toxic, 0)] AS primary_obfuscation,
           {Q.str_list(catalog.SECONDARY_LEVELS)}[1 + {Q.bucket("CAST(p.conv_id AS VARCHAR) || '|' || CAST(p.turn AS VARCHAR)", 4)}] AS secondary_obfuscation,
           p.question, p.answer,
           CASE WHEN {Q.strip('p.question')} = '' OR {Q.bucket("CAST(p.conv_id AS VARCHAR) || '|' || CAST(p.turn AS VARCHAR)", FAIL_EVERY)} = 0 THEN [] ELSE list_transform(range(5), lambda i: p.question) END AS generated_answer
    FROM ({Q.qa_pairs()}) p LEFT JOIN labels l ON l.doc_id = p.conv_id"""

_SQL_CLEAN = f"""
    SELECT conv_id, turn, primary_obfuscation, secondary_obfuscation,
           replace({Q.strip('answer')}, '"', '') AS reference,
           {Q.strip('generated_answer[1]')} AS prediction,
           coalesce(len(generated_answer) = 0, false) AS is_error
    FROM ({_SQL_ANSWERED}) a"""

_SQL_SCORED = f"""
    WITH c AS ({_SQL_CLEAN}),
    g AS ({Q.greedy('c', ['conv_id', 'turn'], 'prediction', 'reference')})
    SELECT c.*, g.precision, g.recall, {Q.f1('g.precision', 'g.recall')} AS f1
    FROM c JOIN g USING (conv_id, turn)"""


@query("eval_grouping_sets", headline=True, sql=f"""
    SELECT CASE WHEN grouping(primary_obfuscation, secondary_obfuscation) = 0 THEN 'cell' ELSE 'overall' END AS scope,
           primary_obfuscation, secondary_obfuscation,
           count(*)::BIGINT AS n_total, count_if(is_error)::BIGINT AS n_errors,
           round(avg(CASE WHEN NOT is_error THEN f1 END), 6) AS mean_f1
    FROM ({_SQL_SCORED}) s
    GROUP BY GROUPING SETS ((primary_obfuscation, secondary_obfuscation), ())""")
def eval_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.grouped_report(scored(spark, sf_dir))


@query("greedy_match_f1", headline=True, sql=f"""
    SELECT conv_id, turn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
    FROM ({_SQL_SCORED}) s""")
def greedy_match_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return s.select(*KEYS, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("clean_answers", sql=f"""
    SELECT conv_id, turn, reference, prediction, is_error FROM ({_SQL_CLEAN}) c""")
def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.clean_answers(answered(spark, sf_dir)).select(*KEYS, "reference", "prediction", "is_error")


@query("answered_filter", sql=f"""
    SELECT conv_id, turn, generated_answer[1] AS first_sample
    FROM ({_SQL_ANSWERED}) a WHERE len(generated_answer) > 0""")
def answered_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answered(spark, sf_dir)
    return a.filter(F.size("generated_answer") > 0).select(
        *KEYS, F.get(F.col("generated_answer"), 0).alias("first_sample"))


@query("eval_counts", sql=f"""
    SELECT count(*)::BIGINT AS n_total, count_if(len(generated_answer) = 0)::BIGINT AS n_errors
    FROM ({_SQL_ANSWERED}) a""")
def eval_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.eval_counts(answered(spark, sf_dir))


@query("eval_complete", sql=f"""
    SELECT conv_id, turn, primary_obfuscation, secondary_obfuscation, is_error,
           round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
    FROM ({_SQL_SCORED}) s""")
def eval_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return s.select(*KEYS, *LEVELS, "is_error", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("eval_report_nested", sql=f"""
    SELECT primary_obfuscation, secondary_obfuscation, round(avg(CASE WHEN NOT is_error THEN f1 END), 6) AS mean_f1
    FROM ({_SQL_SCORED}) s GROUP BY ALL""")
def eval_report_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested {primary: {secondary: mean}} report, read back as rows."""
    nested = E.nested_report(E.grouped_report(scored(spark, sf_dir)))
    return E.unnest_report(nested)


@query("rescaled_f1", sql=f"""
    SELECT conv_id, turn, round((f1 - {RESCALE_BASELINE}) / (1 - {RESCALE_BASELINE}), 6) AS f1_rescaled
    FROM ({_SQL_SCORED}) s""")
def rescaled_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return s.select(*KEYS, F.round(S.rescale("f1", RESCALE_BASELINE), 6).alias("f1_rescaled"))


# Baselines of two stand-in encoders: parameters of these queries, not measured values.
BASELINES = [("narrow", 0.8, 0.78, 0.79), ("wide", 0.5, 0.55, 0.52)]


@query("rescaled_scores", sql=f"""
    SELECT conv_id, turn, encoder, round((precision - p) / (1 - p), 6) AS precision,
           round((recall - r) / (1 - r), 6) AS recall, round((f1 - f) / (1 - f), 6) AS f1
    FROM ({_SQL_SCORED}) s,
         (VALUES {', '.join(f"('{e}', {p}::DOUBLE, {r}::DOUBLE, {f}::DOUBLE)" for e, p, r, f in BASELINES)}) AS b(encoder, p, r, f)""")
def rescaled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 rescaled by a table of baselines for each encoder."""
    s = S.rescale_by_encoder(scored(spark, sf_dir).select(*KEYS, "precision", "recall", "f1"), BASELINES)
    return s.select(*KEYS, "encoder", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def leaderboard_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of two baseline models under two prompt modes.

    'echo' repeats the question, 'lead' its first sentence; with code the
    answer is prefixed by the turn before the question (the shown context).
    """
    msgs = table(spark, sf_dir, "conversations")
    pairs = C.qa_pairs(msgs)
    ctx = msgs.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    base = pairs.join(ctx, KEYS, "left")
    models = F.array(
        F.struct(F.lit("echo").alias("model"), F.col("question").alias("ans")),
        F.struct(F.lit("lead").alias("model"), TX.first_sentence("question").alias("ans")))
    modes = F.array(F.lit("with_code"), F.lit("question_only"))
    rows = (base.select(*KEYS, "answer", "context", F.explode(models).alias("m"))
                .select(*KEYS, "answer", "context", "m.model", "m.ans", F.explode(modes).alias("prompt_mode")))
    pred = F.when(F.col("prompt_mode") == "with_code",
                  F.concat_ws(" ", F.col("context"), F.col("ans"))).otherwise(F.col("ans"))
    return rows.select(*KEYS, "model", "prompt_mode", pred.alias("prediction"),
                       S.clean_reference("answer").alias("reference"))


@query("leaderboard", sql=f"""
    WITH b AS (
        SELECT p.conv_id, p.turn, p.question, p.answer, c.text AS context
        FROM ({Q.qa_pairs()}) p LEFT JOIN conversations c ON c.conv_id = p.conv_id AND c.turn + 1 = p.turn),
    m AS (
        SELECT conv_id, turn, answer, context, 'echo' AS model, question AS ans FROM b
        UNION ALL
        SELECT conv_id, turn, answer, context, 'lead' AS model,
               CASE WHEN fs = '' THEN {Q.strip('question')} ELSE fs END AS ans
        FROM (SELECT *, regexp_extract(question, '(?s)^{Q.WS}*(.*?[.!?])(?:{Q.WS}|$)', 1) AS fs FROM b) b2),
    r AS (
        SELECT conv_id, turn, model, mode AS prompt_mode,
               CASE WHEN mode = 'with_code' THEN concat_ws(' ', context, ans) ELSE ans END AS prediction,
               replace({Q.strip('answer')}, '"', '') AS reference
        FROM m, (SELECT unnest(['with_code', 'question_only']) AS mode) md),
    g AS ({Q.greedy('r', ['conv_id', 'turn', 'model', 'prompt_mode'], 'prediction', 'reference')}),
    s AS (SELECT model, prompt_mode, {Q.f1()} AS f1 FROM g)
    SELECT model,
           round(avg(f1) FILTER (WHERE prompt_mode = 'with_code'), 6) AS f1_with_code,
           round(avg(f1) FILTER (WHERE prompt_mode = 'question_only'), 6) AS f1_question_only,
           round(avg(f1) FILTER (WHERE prompt_mode = 'with_code') - avg(f1) FILTER (WHERE prompt_mode = 'question_only'), 6) AS context_gain
    FROM s GROUP BY model""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leaderboard_input(spark, sf_dir)
    keys = KEYS + ["model", "prompt_mode"]
    s = S.greedy_match(rows, keys, "prediction", "reference", table(spark, sf_dir, "embeddings"))
    root = scratch_path(spark, f"scores-{uuid.uuid4().hex}")
    sinks.write_answers(s, root)  # prompt_mode= / model= folders
    return E.leaderboard(sinks.read_answers(spark, root))
