"""Fan-out and prompt-rendering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as TX
from ..operators import conversation as C
from ..operators import fanout as FO
from ..sources.tables import corpus, table
from . import catalog
from . import sqlbits as Q
from .registry import query

N_FEWSHOT = 3


def _values(rows, names) -> str:
    def v(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, int):
            return str(x)
        return Q.lit(x)
    body = ", ".join("(" + ", ".join(v(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(names)})"


_CATS = _values([(i, c, p, q) for i, (c, p, q) in enumerate(
    zip(catalog.CATEGORIES, catalog.PRE_PROMPTS, catalog.QUESTION_PROMPTS))],
    ["category_no", "category", "pre_prompt", "prompt"])
_PRIM = _values([(x,) for x in catalog.PRIMARY_LEVELS], ["primary_obfuscation"])
_SEC = _values([(x,) for x in catalog.SECONDARY_LEVELS], ["secondary_obfuscation"])


def qa_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code_id, category_no, category) keys: every corpus row x 9 categories."""
    return FO.over_categories(corpus(spark, sf_dir).select("code_id")).select(
        "code_id", F.col("category_no").cast("bigint").alias("category_no"), "category")


@query("fanout_categories", sql=f"""
    SELECT d.doc_id AS code_id, t.category_no::BIGINT AS category_no, t.category
    FROM documents d, {_CATS}""")
def fanout_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_records(spark, sf_dir)


@query("fanout_primary", sql=f"""
    SELECT d.doc_id AS code_id, c.category, p.primary_obfuscation
    FROM documents d, {_CATS.replace(' AS t(', ' AS c(')}, {_PRIM.replace(' AS t(', ' AS p(')}""")
def fanout_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.over_primary(qa_records(spark, sf_dir)).select("code_id", "category", "primary_obfuscation")


@query("fanout_grid", headline=True, sql=f"""
    SELECT d.doc_id AS code_id, c.category, p.primary_obfuscation, s.secondary_obfuscation
    FROM documents d, {_CATS.replace(' AS t(', ' AS c(')}, {_PRIM.replace(' AS t(', ' AS p(')},
         {_SEC.replace(' AS t(', ' AS s(')}""")
def fanout_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.over_grid(qa_records(spark, sf_dir)).select(
        "code_id", "category", "primary_obfuscation", "secondary_obfuscation")


@query("render_questions", sql=f"""
    SELECT d.doc_id AS code_id, c.category, c.pre_prompt AS context_prompt,
           md5(concat_ws(chr(10) || chr(10), d.text, c.prompt)) AS question_md5
    FROM documents d, {_CATS.replace(' AS t(', ' AS c(')}""")
def render_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-generation turns: optional context turn, then code + instruction."""
    recs = FO.over_categories(corpus(spark, sf_dir))
    return recs.select("code_id", "category", F.col("pre_prompt").alias("context_prompt"),
                       F.md5(P.question_turn("code", "prompt")).alias("question_md5"))


_FOLLOW = [(c, f, n, c == "extractive") for c, f, n in zip(
    catalog.FOLLOWUP_CATEGORIES, catalog.FOLLOWUP_FIRST_PROMPTS, catalog.FOLLOWUP_NEXT_PROMPTS)]


@query("render_followups", sql=f"""
    SELECT d.doc_id AS code_id, f.category, q.q_no::BIGINT AS q_no,
           CASE WHEN f.extractive THEN {Q.lit(catalog.FOLLOWUP_EXTRACTIVE_CONTEXT)} END AS context_prompt,
           md5(CASE WHEN q.q_no = 0 THEN concat_ws(chr(10) || chr(10), d.text, f.first_prompt) ELSE f.next_prompt END) AS question_md5,
           CASE WHEN f.extractive THEN {Q.lit(catalog.FOLLOWUP_SPAN_PROMPT)} ELSE {Q.lit(catalog.FOLLOWUP_ANSWER_PROMPT)} END AS answer_prompt
    FROM documents d, {_values(_FOLLOW, ['category', 'first_prompt', 'next_prompt', 'extractive']).replace(' AS t(', ' AS f(')},
         (SELECT unnest(range({catalog.FOLLOWUP_N})) AS q_no) q""")
def render_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n questions per category: first asks with the code, later ones ask for 'another'."""
    recs = FO.numbered(FO.fan_out(corpus(spark, sf_dir), _FOLLOW,
                                  ["category", "first_prompt", "next_prompt", "extractive"]),
                       catalog.FOLLOWUP_N)
    question = F.when(F.col("q_no") == 0, P.question_turn("code", "first_prompt")).otherwise(F.col("next_prompt"))
    return recs.select(
        "code_id", "category", F.col("q_no").cast("bigint").alias("q_no"),
        F.when(F.col("extractive"), F.lit(catalog.FOLLOWUP_EXTRACTIVE_CONTEXT)).alias("context_prompt"),
        F.md5(question).alias("question_md5"),
        F.when(F.col("extractive"), F.lit(catalog.FOLLOWUP_SPAN_PROMPT))
         .otherwise(F.lit(catalog.FOLLOWUP_ANSWER_PROMPT)).alias("answer_prompt"))


@query("render_qa_prompt", headline=True, sql=f"""
    WITH p AS (SELECT q.conv_id, q.turn, q.question, coalesce(c.text, '') AS code
               FROM ({Q.qa_pairs()}) q LEFT JOIN conversations c ON c.conv_id = q.conv_id AND c.turn + 1 = q.turn)
    SELECT conv_id, turn, 'with_code' AS prompt_mode,
           {P.sql_fill(catalog.QA_TEMPLATE_WITH_CODE, prompt='code', question='question')} AS prompt FROM p
    UNION ALL
    SELECT conv_id, turn, 'question_only' AS prompt_mode,
           {P.sql_fill(catalog.QA_TEMPLATE_QUESTION_ONLY, question='question')} AS prompt FROM p""")
def render_qa_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answering prompts in both modes; the 'code' is the turn before the question."""
    msgs = table(spark, sf_dir, "conversations")
    ctx = msgs.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("code"))
    recs = C.qa_pairs(msgs).join(ctx, ["conv_id", "turn"], "left").fillna({"code": ""})
    modes = F.explode(F.array(F.lit("with_code"), F.lit("question_only"))).alias("prompt_mode")
    rows = recs.select("conv_id", "turn", "code", "question", modes)
    return rows.select("conv_id", "turn", "prompt_mode",
                       P.qa_prompt_by_column("code", "question", "prompt_mode").alias("prompt"))


def fewshot_text(examples: DataFrame, n: int) -> DataFrame:
    """One-row frame holding the first n examples rendered and joined by a blank line."""
    first = examples.orderBy("ex_no").limit(n)
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ex_no", "piece"))),
                                              lambda s: s["piece"]), "\n\n").alias("examples"))


@query("render_fewshot", sql=f"""
    WITH ex AS (SELECT item_id,
                       {P.sql_fill(catalog.FEWSHOT_EXAMPLE_TEMPLATE, input='text',
                                   output=f"CASE WHEN fs = '' THEN {Q.strip('text')} ELSE fs END")} AS piece
                FROM (SELECT item_id, text, regexp_extract(text, '(?s)^{Q.WS}*(.*?[.!?])(?:{Q.WS}|$)', 1) AS fs
                      FROM benchmark) b ORDER BY item_id LIMIT {N_FEWSHOT}),
    e AS (SELECT string_agg(piece, chr(10) || chr(10) ORDER BY item_id) AS examples FROM ex)
    SELECT d.doc_id AS code_id, md5({P.sql_fill(catalog.FEWSHOT_SUMMARIZE_TEMPLATE, fewshot_examples='(SELECT examples FROM e)', code='d.text')}) AS prompt_md5
    FROM documents d""")
def render_fewshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few-shot summary prompts; examples are benchmark passages and their first sentence.

    The example block is a scalar subquery (computed once, inlined), so it
    reaches every row without a join.
    """
    ex = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("ex_no"), P.fewshot_example("text", TX.first_sentence("text")).alias("piece"))
    block = fewshot_text(ex, N_FEWSHOT).scalar()
    docs = corpus(spark, sf_dir)
    return docs.select("code_id", F.md5(P.fewshot_prompt("code", block)).alias("prompt_md5"))


@query("render_edge_case", sql=f"""
    SELECT doc_id AS code_id, md5({P.sql_fill(catalog.EDGE_CASE_TEMPLATE, code='text')}) AS prompt_md5
    FROM documents""")
def render_edge_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-shot edge-case prompt with fenced code tags, per corpus row."""
    return corpus(spark, sf_dir).select("code_id", F.md5(P.edge_case_prompt("code")).alias("prompt_md5"))


@query("render_summarize", sql=f"""
    SELECT doc_id AS code_id, md5({P.sql_fill(catalog.SUMMARIZE_TEMPLATE, code='text')}) AS prompt_md5
    FROM documents""")
def render_summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-shot one-sentence summary prompt per corpus row."""
    return corpus(spark, sf_dir).select("code_id", F.md5(P.summarize_prompt("code")).alias("prompt_md5"))


@query("render_codegen", sql=f"""
    SELECT doc_id AS code_id,
           md5({P.sql_fill(catalog.CODEGEN_TEMPLATE, prompt='text',
                           summary=f"CASE WHEN fs = '' THEN {Q.strip('text')} ELSE fs END")}) AS prompt_md5
    FROM (SELECT doc_id, text, regexp_extract(text, '(?s)^{Q.WS}*(.*?[.!?])(?:{Q.WS}|$)', 1) AS fs FROM documents) d""")
def render_codegen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code-completion prompt: the code and its summary (first sentence)."""
    c = corpus(spark, sf_dir)
    return c.select("code_id", F.md5(P.codegen_prompt("code", TX.first_sentence("code"))).alias("prompt_md5"))
