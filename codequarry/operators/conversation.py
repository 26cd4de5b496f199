"""Transcript operators over the long message table (conv_id, turn, role, text).

Turns are in order but may have gaps, so the next message is found by order
and earlier ones are counted, not computed from the turn number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as TX
from ..session import persisted
from .ordinals import Ordered

CHUNK_TURNS = 256
CONTEXT_TOKENS = 4096  # FIXED VALUE: the context length of the answering models


def qa_pairs(messages: DataFrame, question_role: str = "user", answer_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, question, answer): a question turn and the answer right after it.

    The next turn is found in ranges of (conversation, turn), so a
    conversation that holds a third of all rows is dealt to many tasks.
    Turns with the same number come by role and text; NULL numbers come first.
    """
    m = messages.select("conv_id", "turn", "role", F.col("text").alias("question"))
    order = [F.col("turn"), F.col("role"), F.md5("question")]
    nxt = Ordered(m, order, [F.col("conv_id")]).next(_next_role="role", answer="question")
    return (nxt.filter((F.col("role") == question_role) & (F.col("_next_role") == answer_role))
               .select("conv_id", "turn", "question", "answer"))


def context_window(messages: DataFrame, budget: int = CONTEXT_TOKENS, caller_role: str = "user") -> DataFrame:
    """What each call sees: (conv_id, turn, first_turn, n_turns, n_tokens, context).

    A call is a turn of ``caller_role``.  It sees that turn whole, and the
    newest turns before it as long as all of them together, rendered with
    their role markers, hold ``budget`` tokens at most.  ``context`` is these
    turns in order and the generation prompt, whose marker is not counted.

    Running sums of tokens place every turn on a line; a call reaches back
    ``budget`` tokens from its own end.  The line is cut into pieces of
    ``budget`` tokens, so a call meets the turns of two pieces at most (its
    join keys), and each piece has at most ``budget`` turns of a token or
    more: work grows with the rows, not with their pairs, and no key holds a
    whole conversation.  NULL roles and texts render as empty ones; NULL
    turns come first, NULL conversations are one.
    """
    m = messages.select("conv_id", "turn", "role", P.chat_segment(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
                        .alias("segment"), F.md5(F.coalesce("text", F.lit(""))).alias("_dg"))
    m = m.withColumn("n", TX.whitespace_token_count("segment").cast("bigint"))
    order = [F.col("turn"), F.col("role"), F.col("_dg")]
    placed = Ordered(m.withColumn("one", F.lit(1).cast("bigint")), order, [F.col("conv_id")]).sums_before(start="n", at="one")
    placed = persisted(placed.drop("one", "_dg"), "context")
    size = F.lit(budget)
    turns = placed.select(F.col("conv_id").alias("_c"), F.floor(F.col("start") / size).alias("_piece"), F.col("start").alias("_s"),
                          F.col("at").alias("_at"), F.col("turn").alias("_t"), F.col("n").alias("_n"), "segment")
    # the call's own turn, and what starts at or after its end less the budget
    reach = F.least(F.col("start"), F.greatest(F.lit(0), F.col("start") + F.col("n") - size))
    calls = placed.filter(F.col("role") == caller_role).select("conv_id", "turn", "start", "at", reach.alias("reach"))
    pieces = F.sequence(F.floor(F.col("reach") / size), F.floor(F.col("start") / size))
    calls = calls.select("*", F.explode(pieces).alias("piece"))
    seen = calls.join(turns, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("piece") == F.col("_piece"))
                      & (F.col("_s") >= F.col("reach")) & (F.col("_at") <= F.col("at")))
    row = F.struct("_at", F.col("_t").alias("turn"), F.col("_n").alias("n"), "segment")
    g = seen.groupBy("conv_id", "turn", "at").agg(F.array_sort(F.collect_list(row)).alias("w"))
    text = F.concat(F.array_join(F.transform("w", lambda x: x.segment), ""), F.lit(P.GENERATION_PROMPT))
    return g.select("conv_id", "turn", F.get("w", 0).getField("turn").alias("first_turn"),
                    F.size("w").cast("bigint").alias("n_turns"),
                    F.aggregate("w", F.lit(0).cast("bigint"), lambda a, x: a + x.n).alias("n_tokens"), text.alias("context"))


def running_context(messages: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """Context each call sees: number and characters of all previous turns.

    Two-level prefix sum: totals per (conv_id, turn chunk) are summed with a
    map-side partial aggregate, offsets come from a window over the chunk
    totals (one row per chunk), and the in-chunk running sum is a window over
    at most ``chunk_turns`` rows.  No window ever holds a whole conversation.
    Rows with a NULL turn come after the others of their conversation, as in
    the SQL, and rows with a NULL conv_id are one conversation.
    """
    m = (messages.select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars"))
         .withColumn("chunk", F.floor(F.col("turn") / chunk_turns).cast("bigint")))
    totals = m.groupBy("conv_id", "chunk").agg(F.sum("n_chars").alias("chunk_chars"),
                                               F.count(F.lit(1)).alias("chunk_turns"))
    before = Window.partitionBy("conv_id").orderBy(F.col("chunk").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"),
                            F.coalesce(F.sum("chunk_chars").over(before), F.lit(0)).alias("offset"),
                            F.coalesce(F.sum("chunk_turns").over(before), F.lit(0)).alias("turns_before"))
    inner = Window.partitionBy("conv_id", "chunk").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    local = (m.withColumn("local_prev", F.coalesce(F.sum("n_chars").over(inner), F.lit(0)))
              .withColumn("local_turns", F.count(F.lit(1)).over(inner)))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("chunk").eqNullSafe(F.col("_chunk"))
    return (local.join(offsets, same)
                 .select("conv_id", "turn", "role", (F.col("turns_before") + F.col("local_turns")).cast("bigint").alias("n_prev_turns"),
                         (F.col("offset") + F.col("local_prev")).cast("bigint").alias("prev_chars")))


def chat_segments(messages: DataFrame, add_generation_prompt: bool = True) -> DataFrame:
    """Chat rendering, one segment per turn: role markers + text.

    The transcript is the concatenation of segments in turn order; the last
    turn of a conversation ending on a user message gets the generation
    prompt.  The last turn comes from a partial max per conversation.
    """
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    seg = P.chat_segment("role", "text")
    if add_generation_prompt:
        seg = F.when((F.col("turn") == F.col("last_turn")) & (F.col("role") == "user"),
                     F.concat(seg, F.lit(P.GENERATION_PROMPT))).otherwise(seg)
    return (messages.join(last, "conv_id")
                    .select("conv_id", "turn", "role", seg.alias("segment"),
                            (F.col("turn") == F.col("last_turn")).alias("is_last")))

