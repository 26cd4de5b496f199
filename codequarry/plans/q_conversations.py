"""Transcript queries: Q/A pairing, running context, chat rendering, batching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as TX
from ..operators import batches as B
from ..operators import conversation as C
from ..sources.tables import table
from . import sqlbits as Q
from .registry import query

BATCH_SIZE = 8
EXAMPLES_PER_BATCH = 2


@query("qa_pairs", headline=True, sql=Q.qa_pairs())
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.qa_pairs(table(spark, sf_dir, "conversations"))


@query("running_context", sql="""
    SELECT conv_id, turn, role,
           (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS n_prev_turns,
           coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prev_chars
    FROM conversations""")
def running_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.running_context(table(spark, sf_dir, "conversations"))


@query("context_window", sql=f"""
    WITH m AS (
      SELECT *, sum(n) OVER w - n AS s
      FROM (SELECT conv_id, turn, role, seg, len(regexp_extract_all(seg, '[^{TX.WS[1:]}+'))::BIGINT AS n
            FROM (SELECT *, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS seg
                  FROM conversations) a) b
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT c.conv_id, c.turn, min(t.turn) AS first_turn, count(*)::BIGINT AS n_turns, sum(t.n)::BIGINT AS n_tokens,
           string_agg(t.seg, '' ORDER BY t.turn) || {Q.lit(P.GENERATION_PROMPT)} AS context
    FROM m c JOIN m t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.turn <= c.turn
     AND (t.turn = c.turn OR c.s + c.n - t.s <= {C.CONTEXT_TOKENS})
    WHERE c.role = 'user' GROUP BY c.conv_id, c.turn""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered turns that each call sees within the context length."""
    return C.context_window(table(spark, sf_dir, "conversations"))


@query("render_chat", sql="""
    SELECT c.conv_id, c.turn, c.role,
           '<|' || c.role || '|>' || chr(10) || c.text || chr(10)
           || CASE WHEN c.turn = l.last_turn AND c.role = 'user' THEN '<|assistant|>' || chr(10) ELSE '' END AS segment,
           c.turn = l.last_turn AS is_last
    FROM conversations c JOIN (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id) l
      ON l.conv_id = c.conv_id""")
def render_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chat_segments(table(spark, sf_dir, "conversations"))


_SQL_BATCHES = f"""
    SELECT conv_id, turn, text, ((row_number() OVER (ORDER BY conv_id, turn) - 1) // {BATCH_SIZE})::BIGINT AS batch_no
    FROM conversations"""


@query("batch_assign", sql=f"SELECT conv_id, turn, batch_no FROM ({_SQL_BATCHES}) b")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 8 records, numbered densely in the order of the record key."""
    recs = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return B.assign_batches(recs, ["conv_id", "turn"], BATCH_SIZE)


BATCH_TOKENS = 16384
_SQL_LENGTHS = f"""
    SELECT doc_id, n_tokens, (dense_rank() OVER (ORDER BY bound, part) - 1)::BIGINT AS batch_no FROM (
      SELECT *, (row_number() OVER (PARTITION BY bound ORDER BY n_tokens, doc_id) - 1)
                // greatest({BATCH_TOKENS} // bound, 1) AS part FROM (
        SELECT *, (greatest(n_tokens, 1) + step - 1) // step * step AS bound FROM (
          SELECT *, greatest((2 ** (length(bin(greatest(n_tokens, 1))) - 3))::BIGINT, 1) AS step FROM (
            SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^{TX.WS[1:]}+'))::BIGINT AS n_tokens
            FROM documents) a) b) c) d"""


@query("length_batches", sql=_SQL_LENGTHS)
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in batches of similar length, 16,384 tokens between white space at most when padded."""
    n = F.coalesce(TX.whitespace_token_count("text"), F.lit(0)).cast("bigint")
    lengths = table(spark, sf_dir, "documents").select("doc_id", n.alias("n_tokens"))
    return B.length_batches(lengths, "n_tokens", ["doc_id"], BATCH_TOKENS)


@query("batch_waste", sql=f"""
    SELECT batch_no, count(*)::BIGINT AS n_records, max(n_tokens)::BIGINT AS max_tokens,
           (count(*) * max(n_tokens))::BIGINT AS padded_tokens, (count(*) * max(n_tokens) - sum(n_tokens))::BIGINT AS waste_tokens
    FROM ({_SQL_LENGTHS}) e GROUP BY batch_no""")
def batch_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What padding to the longest document adds to each of these batches."""
    return B.batch_waste(length_batches(spark, sf_dir), "n_tokens")


@query("split_batch", sql=f"""
    SELECT c.conv_id, c.turn, (c.turn // n.per)::BIGINT AS example_no, (c.turn % n.per)::BIGINT AS sample_no, c.text
    FROM conversations c JOIN (SELECT conv_id, count(*) // {EXAMPLES_PER_BATCH} AS per FROM conversations GROUP BY conv_id) n
      ON n.conv_id = c.conv_id
    WHERE n.per > 0 AND c.turn < n.per * {EXAMPLES_PER_BATCH}""")
def split_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one flat model output of 2 examples x n samples."""
    flat = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("batch_id"), F.col("turn").alias("pos"), "text")
    out = B.split_flat(flat, EXAMPLES_PER_BATCH)
    return out.select(F.col("batch_id").alias("conv_id"), F.col("pos").alias("turn"),
                      "example_no", "sample_no", "text")


@query("merge_batch", sql=f"""
    SELECT batch_no, count(*)::BIGINT AS n_texts, string_agg(text, chr(10) ORDER BY conv_id, turn) AS merged,
           string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY conv_id, turn) AS scores
    FROM ({_SQL_BATCHES}) b GROUP BY batch_no""")
def merge_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-example outputs of each batch (at most 8) merged back into one list in order."""
    recs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    batched = B.assign_batches(recs, ["conv_id", "turn"], BATCH_SIZE)
    w = Window.partitionBy("batch_no").orderBy("conv_id", "turn")
    parts = batched.select(F.col("batch_no").alias("batch_id"),
                           (F.row_number().over(w) - 1).alias("example_no"), F.array("text").alias("texts"),
                           F.array(F.length("text")).alias("scores"))
    merged = B.merge_outputs(parts, ("texts", "scores"))
    return merged.select(F.col("batch_id").alias("batch_no"),
                         F.size("texts").cast("bigint").alias("n_texts"), F.array_join("texts", "\n").alias("merged"),
                         F.array_join("scores", ",").alias("scores"))


@query("completions_align", sql="""
    SELECT c.conv_id, (c.turn // 2)::BIGINT AS prompt_no, (c.turn % 2)::BIGINT AS sample_no,
           p.text AS prompt, c.text AS completion
    FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = (c.turn // 2) * 2""")
def completions_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat example-major completions (2 per prompt) aligned to their prompt by key."""
    msgs = table(spark, sf_dir, "conversations")
    flat = msgs.select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("pos"),
                       F.col("text").alias("completion"))
    aligned = B.align_completions(flat, 2).withColumn("first_pos", F.col("prompt_no") * 2)
    # prompt i is the message at the first position of its slice
    prompts = msgs.select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("first_pos"),
                          F.col("text").alias("prompt"))
    return (aligned.join(prompts, ["batch_id", "first_pos"])
                   .select(F.col("batch_id").alias("conv_id"), F.col("prompt_no").cast("bigint").alias("prompt_no"),
                           F.col("sample_no").cast("bigint").alias("sample_no"), "prompt", "completion"))
