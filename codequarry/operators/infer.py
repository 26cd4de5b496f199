"""Model calls as Spark jobs: batched, deduplicated, resumable.

A completer is a user function ``(prompts, n, seeds, config) -> list of n
completions per prompt``.  It is built once per Python worker by a
zero-argument factory and called with Arrow batches cut into
``batch_size`` prompts.  The plan around it is native:

* distinct prompts by md5 key (memoisation: identical prompts are answered
  once, whatever their row count; the partial aggregate dedups map-side),
* ``mapInPandas`` over the distinct prompts (the only Python step),
* an equi-join back on the prompt key (AQE splits a hot prompt's rows).

Completions of a sampling model are not reproducible, so jobs that reuse
them write them first (``session.persisted``) instead of recomputing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing as H
from ..plans import catalog
from ..session import path_has_data, persisted, scratch_path, ship_package
from .batches import length_batches
from .util import distinct_by_key, frames, join_on_key, pieces


@dataclass(frozen=True)
class GenerationConfig:
    """Sampling options handed to the completer unchanged."""
    n: int = catalog.DEFAULT_N_SAMPLES
    temperature: float = 0.7
    top_p: float = 0.95
    top_k: int = 40
    max_tokens: int = 512
    use_beam_search: bool = False
    seed: int = catalog.DEFAULT_SEED
    extra: tuple = field(default_factory=tuple)


Completer = Callable[[list[str], int, list[int], GenerationConfig], list[list[str]]]
CompleterFactory = Callable[[], Completer]


def prompt_seed(base_seed: int, prompt_key: str) -> int:
    """Per-prompt seed: reproducible sampling independent of batch order."""
    return int(hashlib.md5(f"{base_seed}|{prompt_key}".encode()).hexdigest()[:8], 16)


# --- shipped completers ------------------------------------------------------

def hash_completer() -> Completer:
    """Deterministic stub: sample i = first 16 hex of md5(prompt | i)."""
    def run(prompts, n, seeds, config):
        return [[hashlib.md5(f"{p}|{i}".encode()).hexdigest()[:16] for i in range(n)] for p in prompts]
    return run


def seeded_hash_completer() -> Completer:
    """Deterministic stand-in for sampling: sample i = first 16 hex of md5(prompt | seed | i)."""
    def run(prompts, n, seeds, config):
        return [[hashlib.md5(f"{p}|{s}|{i}".encode()).hexdigest()[:16] for i in range(n)]
                for p, s in zip(prompts, seeds)]
    return run


BREAK_EVERY = 5


def echo_code_completer() -> Completer:
    """Deterministic stub for rewrites: returns the code before the last blank
    line of the prompt inside chatty text, plus one marker statement derived
    from the instruction (so every rewrite level yields different code).  One
    rewrite in ``BREAK_EVERY``, by hash of the code, does not parse."""
    def run(prompts, n, seeds, config):
        out = []
        for p in prompts:
            code, _, instruction = p.rpartition("\n\n")
            mark = hashlib.md5(instruction.encode()).hexdigest()[:6]
            broken = int(hashlib.md5(code.encode()).hexdigest()[:8], 16) % BREAK_EVERY == 0
            text = (f"Here is the code:\n{code}\n    pass  # {mark}\n" + "    )\n" * broken
                    + "The behaviour is unchanged.")
            out.append([text] * n)
        return out
    return run


def replay_completer(recorded: dict[str, list[str]]) -> Completer:
    """Replays recorded outputs by prompt text (order-free)."""
    def run(prompts, n, seeds, config):
        return [list(recorded.get(p, [])) for p in prompts]
    return run


REFUSE_EVERY = 7


def refusing_completer() -> Completer:
    """Deterministic stub of a failing model: :func:`hash_completer`, but it raises
    where a batch holds one of the prompts that a hash marks, one in ``REFUSE_EVERY``."""
    answer = hash_completer()

    def run(prompts, n, seeds, config):
        if any(int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % REFUSE_EVERY == 0 for p in prompts):
            raise RuntimeError("refused")
        return answer(prompts, n, seeds, config)
    return run


COMPLETERS: dict[str, CompleterFactory] = {"hash": hash_completer, "seeded_hash": seeded_hash_completer, "echo_code": echo_code_completer}


def sql_hash_completion(prompt_expr: str, i: int = 0) -> str:
    """SQL twin of :func:`hash_completer` for sample ``i``."""
    return f"substr(md5({prompt_expr} || '|{i}'), 1, 16)"


# --- the job -----------------------------------------------------------------

def prompt_key(prompt_col: str, salt_col: str | None = None):
    """md5 key of a prompt, optionally per (salt, prompt)."""
    if salt_col is None:
        return H.content_key(F.col(prompt_col))
    return H.content_key(F.concat_ws("|", F.col(salt_col).cast("string"), F.col(prompt_col)))


OUT_SCHEMA = T.StructType([T.StructField("prompt_key", T.StringType()),
                           T.StructField("completions", T.ArrayType(T.StringType())),
                           T.StructField("error", T.StringType())])


def answer_batch(completer: Completer, prompts: list[str], seeds: list[int], config: GenerationConfig,
                 retries: int | None = None) -> list[tuple[list[str], str | None]]:
    """(completions, reason of failure or None) for each prompt.

    With ``retries`` a batch that raises is halved until the failing prompts
    are alone; these are tried ``retries`` times more and then fail: no
    completions, and the error as reason.  The others keep their answers.
    Without it (None) the error is raised, which ends the job.  A completer
    that answers None or no sample for a prompt has failed on it, too.
    """
    try:
        got = completer(prompts, config.n, seeds, config)
        if len(got) != len(prompts):
            raise ValueError("completer returned a different number of prompts")
    except Exception as e:  # noqa: BLE001 - a model call may raise anything; the reason is kept
        if retries is None:
            raise
        if len(prompts) > 1:
            mid = len(prompts) // 2
            return (answer_batch(completer, prompts[:mid], seeds[:mid], config, retries)
                    + answer_batch(completer, prompts[mid:], seeds[mid:], config, retries))
        if retries > 0:
            return answer_batch(completer, prompts, seeds, config, retries - 1)
        return [([], f"{type(e).__name__}: {e}")]
    return [(list(x), None) if x else ([], NO_ANSWER) for x in got]


NO_ANSWER = "no answer"


def _run_batches(factory: CompleterFactory, config: GenerationConfig, batch_size: int, retries: int | None):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        completer = factory()
        for pdf in frames(it, "prompt"):
            keys = pdf["prompt_key"].tolist()
            prompts = pdf["prompt"].fillna("").tolist()
            outs: list = []
            for s in range(0, len(prompts), batch_size):
                seeds = [prompt_seed(config.seed, k) for k in keys[s:s + batch_size]]
                outs += answer_batch(completer, prompts[s:s + batch_size], seeds, config, retries)
            yield pd.DataFrame({"prompt_key": keys, "completions": [o for o, _ in outs], "error": [e for _, e in outs]},
                               columns=["prompt_key", "completions", "error"])
    return run


def complete_distinct(prompts: DataFrame, prompt_col: str, factory: CompleterFactory,
                      config: GenerationConfig = GenerationConfig(),
                      batch_size: int = catalog.DEFAULT_BATCH_SIZE, salt_col: str | None = None,
                      stable: bool = True, retries: int | None = None) -> DataFrame:
    """(prompt_key, completions, error) for every distinct prompt text in ``prompts``.

    ``salt_col`` makes the key per (salt, prompt): rows that must each get
    their own sample (a sampling model) are not merged even when their
    prompt texts are equal.  ``stable`` (default) writes the completions as a table
    in the shared folder: a sampling model is then called once per key even
    when the result feeds several branches of the plan.  ``retries``: see
    :func:`answer_batch`.
    """
    ship_package(prompts.sparkSession)
    distinct = distinct_by_key(prompts.select(prompt_key(prompt_col, salt_col).alias("prompt_key"),
                                              F.col(prompt_col).alias("prompt")), "prompt_key")
    out = distinct.mapInPandas(_run_batches(factory, config, batch_size, retries), OUT_SCHEMA)
    return persisted(out, "completions") if stable else out


def _run_rows(factory: CompleterFactory, config: GenerationConfig, batch_size: int, prompt_col: str, out_col: str,
              seed_cols: Sequence[str], retries: int | None, error_col: str | None):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        completer = factory()
        for pdf in it:
            prompts = pdf[prompt_col].tolist()
            salts = pdf[list(seed_cols)].astype(str).agg("|".join, axis=1).tolist() if seed_cols else None
            outs: list = [None] * len(prompts)
            errors: list = [None] * len(prompts)
            todo = [i for i, p in enumerate(prompts) if p is not None]
            for s in range(0, len(todo), batch_size):
                idx = todo[s:s + batch_size]
                keys = [(salts[i] + "|" if salts else "") + prompts[i] for i in idx]
                seeds = [prompt_seed(config.seed, hashlib.md5(k.encode()).hexdigest()) for k in keys]
                for i, (g, e) in zip(idx, answer_batch(completer, [prompts[i] for i in idx], seeds, config, retries)):
                    outs[i], errors[i] = g, e
            pdf[out_col] = outs
            if error_col:
                pdf[error_col] = pd.Series(errors, dtype=object, index=pdf.index)
            yield pdf
    return run


def complete_rows(df: DataFrame, prompt_col: str, factory: CompleterFactory,
                  config: GenerationConfig = GenerationConfig(), out_col: str = "completions",
                  batch_size: int = catalog.DEFAULT_BATCH_SIZE, seed_cols: Sequence[str] = (),
                  retries: int | None = None, error_col: str | None = None, keep_prompt: bool = True) -> DataFrame:
    """Call the completer for every row (each row its own sample), in place.

    A narrow stage: no dedupe shuffle and no join back.  Chains of such
    stages consume each output once, so a retried task recomputes its whole
    chain and stays self-consistent; persist the final result before reusing
    it.  NULL prompts get NULL output.  Seeds derive from ``seed_cols`` and
    the prompt.  ``retries``: see :func:`answer_batch`; ``error_col`` takes
    the reasons.  ``keep_prompt=False`` leaves the prompts in Python, which
    no later projection can do.
    """
    ship_package(df.sparkSession)
    more = [T.StructField(out_col, T.ArrayType(T.StringType()))]
    more += [T.StructField(error_col, T.StringType())] if error_col else []
    rows = _run_rows(factory, config, batch_size, prompt_col, out_col, tuple(seed_cols), retries, error_col)
    if not keep_prompt:
        rest = [f for f in df.schema.fields if f.name != prompt_col]
        return df.mapInPandas(lambda it: (pdf.drop(columns=prompt_col) for pdf in rows(frames(it, prompt_col))),
                              T.StructType(rest + more))
    return df.mapInPandas(lambda it: rows(frames(it, prompt_col)), T.StructType(list(df.schema.fields) + more))


def _run_turns(factory: CompleterFactory, config: GenerationConfig, batch_size: int, n_keys: int, n_turns: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        completer = factory()
        for piece in pieces(it):
            keys = piece.columns[:n_keys]
            salts = ["|".join(map(str, k)) for k in zip(*(c.to_pylist() for c in keys))]
            asks = piece.column(n_keys).to_pylist()
            said: list = [""] * len(asks)  # the transcript so far; None once it has ended
            answers: list[list] = [[None] * n_turns for _ in asks]
            for t in range(n_turns):
                said = [None if s is None or a[t] is None else s + a[t] for s, a in zip(said, asks)]
                todo = [i for i, s in enumerate(said) if s is not None and asks[i][t]]
                for b in range(0, len(todo), batch_size):
                    idx = todo[b:b + batch_size]
                    seeds = [prompt_seed(config.seed, hashlib.md5(f"{salts[i]}|{said[i]}".encode()).hexdigest()) for i in idx]
                    for i, (got, _) in zip(idx, answer_batch(completer, [said[i] for i in idx], seeds, config)):
                        answers[i][t] = got[0] if got else None
                        said[i] = None if answers[i][t] is None else said[i] + answers[i][t] + "\n"
            yield pa.RecordBatch.from_arrays([*keys, pa.array(answers, pa.list_(pa.string()))],
                                             names=[*piece.schema.names[:n_keys], "answers"])
    return run


def complete_turns(df: DataFrame, keys: Sequence[str], turns: Sequence, factory: CompleterFactory,
                   config: GenerationConfig = GenerationConfig(n=1),
                   batch_size: int = catalog.DEFAULT_BATCH_SIZE) -> DataFrame:
    """(keys, answers): a conversation with the completer for every row, all turns in one Python step.

    ``turns`` are text columns: what a turn adds to the transcript, up to the
    mark of the coming answer.  Turn by turn the rows' transcripts so far are
    the prompts, in batches as in :func:`complete_rows`; the first completion
    and a newline are added to them, and it is the turn's entry in
    ``answers``.  An empty turn is passed over (its answer is NULL); a NULL
    turn, or one without an answer, ends the row's conversation.  Seeds derive
    from ``keys`` and the prompt.

    A stage for each turn would hold as many Python workers a core as there
    are turns, each with a batch of whole transcripts; here a core has one
    worker, which holds the transcripts of one piece (:func:`.util.pieces`).
    """
    ship_package(df.sparkSession)
    src = df.select(*keys, F.array(*turns).alias("_turns"))
    more = T.StructField("answers", T.ArrayType(T.StringType()))
    return src.mapInArrow(_run_turns(factory, config, batch_size, len(keys), len(turns)),
                          T.StructType(list(src.schema.fields[:-1]) + [more]))


def batch_infer(df: DataFrame, prompt_col: str, factory: CompleterFactory,
                config: GenerationConfig = GenerationConfig(), out_col: str = "generated_answer",
                batch_size: int = catalog.DEFAULT_BATCH_SIZE, stable: bool = True,
                share: bool = True, seed_cols: Sequence[str] = (),
                retries: int | None = None, error_col: str | None = None) -> DataFrame:
    """Attach ``out_col`` (n completions) to every row.

    ``share`` lets identical prompts share one call (memoised rewrites);
    otherwise each row, told apart by ``seed_cols``, gets its own samples and
    nothing is shuffled.  ``stable=False`` skips writing the completions when
    the caller materialises the result itself.  With ``retries`` a prompt
    that the completer fails on gets ``[]`` and its reason in ``error_col``
    (:func:`answer_batch`); without, the job ends with the error.
    """
    if not share:
        return complete_rows(df, prompt_col, factory, config, out_col, batch_size, seed_cols, retries, error_col)
    done = complete_distinct(df.filter(F.col(prompt_col).isNotNull()), prompt_col, factory, config,
                             batch_size, stable=stable, retries=retries)
    done = done.select(F.col("prompt_key").alias("_pk"), F.col("completions").alias(out_col),
                       *([F.col("error").alias(error_col)] if error_col else []))
    return join_on_key(df, done, H.content_key(F.col(prompt_col)), "_pk", "left")


def complete_by_length(df: DataFrame, prompt_col: str, length_col: str, keys: Sequence[str], factory: CompleterFactory,
                       budget: int, config: GenerationConfig = GenerationConfig(), out_col: str = "completions",
                       retries: int | None = None, error_col: str | None = None) -> DataFrame:
    """``df`` with ``out_col``: one call of the completer for each batch of similar lengths.

    Batches are those of :func:`.batches.length_batches`, so a model that pads
    a batch to its longest prompt holds ``budget`` tokens at most.  Rows with
    a NULL prompt are no part of any batch and get NULL.  Every row has its
    own sample; seeds derive from ``keys`` and the prompt.  ``retries`` and
    ``error_col`` as in :func:`complete_rows`.
    """
    ship_package(df.sparkSession)
    more = [T.StructField(out_col, T.ArrayType(T.StringType()))]
    more += [T.StructField(error_col, T.StringType())] if error_col else []
    asked = df.filter(F.col(prompt_col).isNotNull())
    batched = length_batches(asked, length_col, keys, budget)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        rows = _run_rows(factory, config, len(batch), prompt_col, out_col, tuple(keys), retries, error_col)
        return next(rows(iter([batch.drop(columns="batch_no").sort_values(list(keys), ignore_index=True)])))

    answered = batched.groupBy("batch_no").applyInPandas(run, T.StructType(list(df.schema.fields) + more))
    rest = df.filter(F.col(prompt_col).isNull())
    return answered.unionByName(rest.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in more]))


# --- resume ---------------------------------------------------------------------

def pending(records: DataFrame, done: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Records without a written result (anti-join on the record key)."""
    if done is None:
        return records
    return records.join(done.select(*keys).dropDuplicates(list(keys)), list(keys), "left_anti")


def pending_rows(df: DataFrame, out_col: str = "generated_answer") -> DataFrame:
    """Rows whose output column is still NULL (in-table resume marker)."""
    return df.filter(F.col(out_col).isNull())


def last_attempts(written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each record's written rows the one of its last attempt (rows without ``attempt``: as they are)."""
    if "attempt" not in written.columns:
        return written
    row = F.struct(*[F.col(f"`{c}`") for c in written.columns]).alias("_row")
    last = written.groupBy(*keys).agg(F.max_by(row, "attempt").alias("_row"))
    return last.select("_row.*")


def run_resumable(spark: SparkSession, records: DataFrame, keys: Sequence[str], prompt_col: str,
                  factory: CompleterFactory, out_path: str,
                  config: GenerationConfig = GenerationConfig(), out_col: str = "generated_answer",
                  batch_size: int = catalog.DEFAULT_BATCH_SIZE,
                  commits: int = 1, share: bool = False, retries: int | None = None, attempts: int = 3) -> DataFrame:
    """Answer every record not yet in ``out_path`` and append the results.

    Each append is a complete set of rows, so an interrupted run leaves only
    whole results and running again answers exactly the rest (idempotent).
    Only a missing output means that nothing is done; an output that cannot
    be read is an error.  ``commits`` splits the pending rows by a hash of
    their key into that many appends (the partial-save interval); they are
    written once, partitioned by commit, so no commit scans the input again.

    With ``retries`` failing prompts do not end the run: they are written
    with ``[]``, their reason (``error``) and the number of the run that
    tried them (``attempt``).  A later run tries the failed records again,
    and only these, until they were tried in ``attempts`` runs.  The result
    has each record's last attempt.
    """
    done = spark.read.parquet(out_path) if path_has_data(spark, out_path) else None
    todo = pending(records, done, keys)
    if retries is not None:
        todo = todo.withColumn("attempt", F.lit(1))
        if done is not None and "attempt" not in done.columns:
            raise ValueError(f"{out_path} was written without attempts")
        if done is not None:
            last = last_attempts(done, keys)
            failed = last.filter((F.size(out_col) == 0) & (F.col("attempt") < attempts))
            again = records.join(failed.select(*keys, (F.col("attempt") + 1).alias("attempt")), list(keys))
            todo = todo.unionByName(again.select(*todo.columns))
    if commits > 1:
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        path = scratch_path(spark, f"pending-{uuid.uuid4().hex}")
        todo.withColumn("_commit", H.md5_bucket(key, commits).cast("int")).write.partitionBy("_commit").parquet(path)
        staged = spark.read.parquet(path) if path_has_data(spark, path) else todo.withColumn("_commit", F.lit(0))
        parts = [staged.filter(F.col("_commit") == i).drop("_commit") for i in range(commits)]
    else:
        parts = [todo]
    for part in parts:
        answered = batch_infer(part, prompt_col, factory, config, out_col, batch_size, share=share, seed_cols=keys,
                               retries=retries, error_col=None if retries is None else "error")
        answered.write.mode("append").parquet(out_path)
    return last_attempts(spark.read.parquet(out_path), keys) if retries is not None else spark.read.parquet(out_path)


# --- replay ---------------------------------------------------------------------

def replay(df: DataFrame, prompt_col: str, recorded: DataFrame, out_col: str = "generated_answer") -> DataFrame:
    """Attach recorded outputs (prompt, texts) by prompt key instead of by position.

    A prompt recorded more than once keeps its smallest output list, so the
    result does not depend on which copy a task sees first.
    """
    rec = (recorded.filter(F.col("prompt").isNotNull())
                   .select(H.content_key(F.col("prompt")).alias("_pk"), F.col("texts"))
                   .groupBy("_pk").agg(F.min("texts").alias(out_col)))
    return join_on_key(df, rec, H.content_key(F.col(prompt_col)), "_pk", "left")
