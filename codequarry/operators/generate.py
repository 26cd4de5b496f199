"""Q/A generation and the primary (model) rewrite as jobs.

Generation: per (code, category) record, an optional context turn, then a
question turn, then an answer turn; each turn sees the messages before it
(at most six, so the message list lives in one row).  All turns of a record
run in one Python stage, turn by turn in batches over its rendered prompts.

Primary rewrite: records x levels; the model is called once per distinct
(code, level) (the nine questions on one code share a rewrite), the
chained level reads the first-stage output of the same code, and the
results are joined back to every record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import prompts as P
from ..functions import text as TX
from ..plans import catalog
from ..session import persisted
from . import fanout as FO
from . import infer as I
from .util import distinct_by_key, join_on_key

def _first(col: str) -> Column:
    return F.get(F.col(col), 0)


def generate_qa(records: DataFrame, factory: I.CompleterFactory,
                config: I.GenerationConfig = I.GenerationConfig(n=1),
                answer_prompt: str = catalog.ANSWER_PROMPT) -> DataFrame:
    """records (code_id, code, category, pre_prompt, prompt) -> (code_id, category, question, answer).

    Every record gets its own calls (as sampling requires).  The transcript
    is carried as rendered text: each turn appends its chat segment, and a
    prompt is the transcript so far plus the generation prompt.  All turns
    run in one Python step (:func:`.infer.complete_turns`), which is given
    the segments that a turn adds and returns the answers alone.
    """
    gen = F.lit(P.GENERATION_PROMPT)

    def turn(text) -> Column:
        return F.concat(P.chat_segment(F.lit("user"), text), gen)

    context = F.when(F.col("pre_prompt").isNotNull(), turn("pre_prompt")).otherwise(F.lit(""))
    r = I.complete_turns(records, ["code_id", "category"],
                         [context, turn(P.question_turn("code", "prompt")), turn(F.lit(answer_prompt))], factory, config)
    return r.select("code_id", "category", F.get("answers", 1).alias("question"), F.get("answers", 2).alias("answer"))


# --- primary rewrite ---------------------------------------------------------------

CHAINED = "Refactor and Dead Code"


def primary_rewrites(codes: DataFrame, factory: I.CompleterFactory,
                     config: I.GenerationConfig = I.GenerationConfig(n=1),
                     double_refactor: bool = False, out: Callable[[Column], Column] | None = None) -> DataFrame:
    """(code_id, code) -> (code_id, level, obfuscated_code) for the model levels.

    ``codes`` must hold each code once (the memo key).  Single-step levels
    rewrite the original; the chained level rewrites the refactored code
    (a code without a first-stage output has no chained row).

    ``out`` is what the caller needs of a rewritten code, such as its digest.
    It is made where the code is, so that no rewritten code is shuffled to
    its ``code_id`` and only those that the chained level reads are written.
    """
    single = [("Refactor", catalog.REFACTOR_PROMPT), ("Dead Code", catalog.DEAD_CODE_PROMPT)]
    second = [(CHAINED, catalog.REFACTOR_PROMPT if double_refactor else catalog.DEAD_CODE_PROMPT)]
    level, made = F.col("level"), F.col("_code") if out is None else out(F.col("_code"))

    # the first stage feeds both the result and the chained stage: written
    # once, so the model is called once per code and level
    s1 = _rewrite(codes, single, factory, config).select(
        "_text", "level", made.alias("obfuscated_code"),
        *([] if out is None else [F.when(level == "Refactor", F.col("_code")).alias("_refactored")]))
    s1 = persisted(s1, "first-stage", free_shuffles=True)
    refactored = s1.filter(level == "Refactor").select(
        "_text", F.col("obfuscated_code" if out is None else "_refactored").alias("code")).filter(F.col("code").isNotNull())
    s2 = _rewrite(refactored, second, factory, config).select("_text", "level", made.alias("obfuscated_code"))

    # codes find their rewrites by digest: their own, and that of their refactored code
    after = refactored.select(F.col("_text").alias("_of"), H.content_key("code").alias("_next"))
    keyed = join_on_key(codes.select("code_id", H.content_key("code").alias("_text")), after, "_text", "_of", "left")
    keyed = persisted(keyed, "code-digests", free_shuffles=True)
    rewrites = _of_codes(keyed, [lv for lv, _ in single], "_text", s1)
    chained = _of_codes(keyed.filter(F.col("_next").isNotNull()), [lv for lv, _ in second], "_next", s2)
    # one after the other: the texts that one join shuffles are gone when the next begins
    return persisted(rewrites, "rewrites", free_shuffles=True).unionByName(persisted(chained, "chained", free_shuffles=True))


def _of_codes(keyed: DataFrame, levels: list[str], text: str, done: DataFrame) -> DataFrame:
    """(code_id, level, obfuscated_code): for each code and level what ``done`` (_text, level, obfuscated_code) has for its ``text``."""
    wanted = FO.fan_out(keyed.select("code_id", text), [(lv,) for lv in levels], ["level"])
    made = done.select(F.concat("_text", F.lit("|"), "level").alias("_made"), "obfuscated_code")
    found = join_on_key(wanted, made, F.concat(text, F.lit("|"), "level"), "_made", "left")
    return found.select("code_id", "level", "obfuscated_code")


def _rewrite(codes: DataFrame, instructions: list[tuple[str, str]], factory, config) -> DataFrame:
    """(.., code) -> (_text, level, _code): a rewrite of each distinct code at each level; ``_text`` is the code's md5.

    Equal codes share their calls.  A code is shuffled once for all its levels;
    the prompts are made after that, in the stage that calls the model.
    """
    # a NULL code is left out behind the Python step: a filter before it would be pushed down and make each code twice
    distinct = distinct_by_key(codes.select(H.content_key("code").alias("_text"), "code"), "_text")
    asks = FO.fan_out(distinct, instructions, ["level", "instruction"])
    asks = asks.select("_text", "level", P.question_turn("code", "instruction").alias("_prompt"))
    got = I.complete_rows(asks, "_prompt", factory, config, out_col="_out", keep_prompt=False)
    return got.filter(F.col("_text").isNotNull()).select("_text", "level", TX.keep_code_lines(_first("_out")).alias("_code"))


def primary_records(records: DataFrame, rewrites: DataFrame) -> DataFrame:
    """records (qa keys, code_id, code) x primary levels with their code.

    'None' keeps the original code; other levels take the memoised rewrite.
    A code's rewrites (one for each level) are gathered first, records join
    them once by ``code_id`` and only then fan out over the levels, in place.
    """
    by_code = rewrites.groupBy("code_id").agg(F.map_from_entries(F.collect_list(
        F.struct("level", "obfuscated_code"))).alias("_by_level"))
    fan = FO.over_primary(records.join(by_code, "code_id", "left"))
    level = F.col("primary_obfuscation")
    code = F.when(level == "None", F.col("code")).otherwise(F.try_element_at("_by_level", level))
    return fan.withColumn("obfuscated_code", code).drop("_by_level")




FOLLOWUP_ROWS = [(c, f, n, c == "extractive") for c, f, n in zip(
    catalog.FOLLOWUP_CATEGORIES, catalog.FOLLOWUP_FIRST_PROMPTS, catalog.FOLLOWUP_NEXT_PROMPTS)]


def generate_followups(codes: DataFrame, factory: I.CompleterFactory,
                       config: I.GenerationConfig = I.GenerationConfig(n=1),
                       n: int = catalog.FOLLOWUP_N) -> DataFrame:
    """codes (code_id, code) -> (code_id, category, q_no, question, answer).

    Per category one transcript: an optional context turn (extractive
    category), then n rounds of question turn + answer turn (a span for the
    extractive category); every call sees the whole transcript so far,
    which holds at most 2n + 3 messages.
    """
    gen = F.lit(P.GENERATION_PROMPT)

    def turn(text) -> Column:
        return F.concat(P.chat_segment(F.lit("user"), text), gen)

    r = FO.fan_out(codes.select("code_id", "code"), FOLLOWUP_ROWS, ["category", "first_prompt", "next_prompt", "extractive"])
    turns = [F.when(F.col("extractive"), turn(F.lit(catalog.FOLLOWUP_EXTRACTIVE_CONTEXT))).otherwise(F.lit(""))]
    answer_turn = F.when(F.col("extractive"), F.lit(catalog.FOLLOWUP_SPAN_PROMPT)).otherwise(
        F.lit(catalog.FOLLOWUP_ANSWER_PROMPT))
    for i in range(n):
        turns += [turn(P.question_turn("code", "first_prompt") if i == 0 else F.col("next_prompt")), turn(answer_turn)]
    r = I.complete_turns(r, ["code_id", "category"], turns, factory, config)
    rounds = F.array(*[F.struct(F.lit(i).cast("bigint").alias("q_no"), F.get("answers", 2 * i + 1).alias("question"),
                                F.get("answers", 2 * i + 2).alias("answer")) for i in range(n)])
    return r.select("code_id", "category", F.explode(rounds).alias("x")).select(
        "code_id", "category", "x.q_no", "x.question", "x.answer")
