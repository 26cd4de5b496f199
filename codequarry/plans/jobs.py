"""End-to-end jobs: build the data set, answer it, score the answers.

Each job reads tables, runs the operators and writes its result, so stages
are restartable on their own (the original scripts pass JSON files between
stages; here they are Parquet tables partitioned by level or by model and
prompt mode).  Completers and encoders are user functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..operators import evaluate as E
from ..operators import fanout as FO
from ..operators import generate as G
from ..operators import infer as I
from ..operators import rewrite as RW
from ..operators import scoring as S
from ..session import persisted
from ..sources import readers as R
from ..sources import sinks
from . import catalog

RECORD_KEYS = ["code_id", "category"]
VARIANT_KEYS = RECORD_KEYS + ["primary_obfuscation", "secondary_obfuscation"]


def build_qa_dataset(spark: SparkSession, corpus: DataFrame, completer: I.CompleterFactory,
                     rewriter: I.CompleterFactory, out_path: str, n: int | None = catalog.DEFAULT_SAMPLE_N,
                     seed: int = catalog.DEFAULT_SEED, consistent: bool = True) -> DataFrame:
    """corpus (code_id, code) -> secondary records, written partitioned by level.

    Sample n codes (seeded), generate one question/answer per category, rewrite
    each code at the primary levels (one model call per code and level), then
    apply the parser-based levels with fallback and renamed Q/A.
    """
    sample = persisted(R.seeded_sample(corpus.select("code_id", "code"), "code_id", seed, n), "sample")
    if n is not None and sample.count() < n:  # the whole corpus then, or an error
        R.check_size(sample, corpus.count())
    qa = G.generate_qa(FO.over_categories(sample), completer)
    qa = persisted(qa, "qa").join(sample, "code_id")
    rewrites = G.primary_rewrites(sample, rewriter)
    variants = G.primary_records(qa.withColumnRenamed("code", "original_code")
                                   .withColumn("code", F.col("original_code")), rewrites)
    grid = RW.secondary_grid(variants, ["code_id"], seed, consistent)
    sinks.write_records(grid, out_path, partition_by=["primary_obfuscation", "secondary_obfuscation"])
    return spark.read.parquet(out_path)


def answer_records(spark: SparkSession, records: DataFrame, completer: I.CompleterFactory, model: str,
                   prompt_mode: str, out_root: str,
                   config: I.GenerationConfig = I.GenerationConfig(), commits: int = 1, share: bool = False,
                   examples: str | None = None) -> DataFrame:
    """Answer every record not yet answered by (model, prompt_mode); append results.

    ``prompt_mode`` is one of ``prompts.ANSWER_MODES`` (``examples``: the worked examples of the
    few-shot mode).  Each record gets its own samples unless ``share``.  Resume is by record key,
    so a rerun after a partial run answers exactly the rest; ``commits`` saves in that many parts.
    """
    shown = None if examples is None else F.lit(examples)
    prompt = P.answer_prompt("secondary_obfuscated_code", "question", prompt_mode, shown)
    recs = records.withColumn("prompt", prompt)
    out_path = f"{out_root.rstrip('/')}/prompt_mode={prompt_mode}/model={model}"
    return I.run_resumable(spark, recs, VARIANT_KEYS, "prompt", completer, out_path, config, commits=commits,
                           share=share)


def score_answers(spark: SparkSession, answered: DataFrame, vectors: DataFrame, out_path: str,
                  baseline: float | None = None, sample_mode: str = "first") -> tuple[DataFrame, DataFrame]:
    """Per-record scores (written) and the grouped report (cells + overall).

    The first sample (or the best / mean over samples) is scored against the
    cleaned reference answer; records without a sample count as errors and
    are not scored.
    """
    if sample_mode == "first":
        cleaned = S.clean_answers(answered)
        scored = S.greedy_match(cleaned, VARIANT_KEYS + ["is_error"], "prediction", "reference", vectors)
    else:
        flags = answered.select(*VARIANT_KEYS, F.coalesce(F.size("generated_answer") == 0, F.lit(True)).alias("is_error"))
        per = S.score_samples(answered, VARIANT_KEYS, "generated_answer", "answer", vectors, sample_mode)
        scored = flags.join(per, VARIANT_KEYS, "left")
    if baseline is not None:
        scored = scored.withColumn("f1", S.rescale("f1", baseline))
    sinks.write_records(scored, out_path)
    scored = spark.read.parquet(out_path)
    return scored, E.grouped_report(scored)
