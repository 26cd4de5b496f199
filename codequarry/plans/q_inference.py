"""Model-call queries: batched inference, Q/A generation, memoised and
chained rewrites, resume and replay.  The shipped completers are
deterministic stubs (md5 of the prompt; echo of the code), so each job has an
exact SQL twin."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as TX
from ..operators import conversation as C
from ..operators import fanout as FO
from ..operators import generate as G
from ..operators import infer as I
from ..sources.tables import corpus, sql_synth_code, synth_code, table
from . import catalog
from . import sqlbits as Q
from .registry import query

N_SAMPLES = catalog.DEFAULT_N_SAMPLES


def _sql_hash(prompt: str, i: int = 0) -> str:
    return I.sql_hash_completion(prompt, i)


# --- batched inference ------------------------------------------------------------

_SQL_QO = P.sql_fill(catalog.QA_TEMPLATE_QUESTION_ONLY, question="question")


@query("batch_infer", headline=True, sql=f"""
    SELECT conv_id, turn, array_to_string([{', '.join(_sql_hash('p', i) for i in range(N_SAMPLES))}], ',') AS samples
    FROM (SELECT conv_id, turn, {_SQL_QO} AS p FROM ({Q.qa_pairs()}) q) x""")
def batch_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-only prompts answered in batches of 8, five samples each."""
    pairs = C.qa_pairs(table(spark, sf_dir, "conversations"))
    prompts = pairs.select("conv_id", "turn", P.qa_prompt("", "question", "question_only").alias("prompt"))
    out = I.batch_infer(prompts, "prompt", I.hash_completer, I.GenerationConfig(n=N_SAMPLES))
    return out.select("conv_id", "turn", F.array_join("generated_answer", ",").alias("samples"))


@query("failed_generations", sql=f"""
    SELECT conv_id, turn, CASE WHEN failed THEN 0 ELSE {N_SAMPLES} END::BIGINT AS n_samples,
           CASE WHEN NOT failed THEN {_sql_hash('p')} END AS first_sample,
           CASE WHEN failed THEN 'RuntimeError: refused' END AS error
    FROM (SELECT conv_id, turn, p, {Q.bucket('p', I.REFUSE_EVERY)} = 0 AS failed
          FROM (SELECT conv_id, turn, {_SQL_QO} AS p FROM ({Q.qa_pairs()}) q) x) y""")
def failed_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model that raises on some prompts: only these fail, with the reason."""
    pairs = C.qa_pairs(table(spark, sf_dir, "conversations"))
    prompts = pairs.select("conv_id", "turn", P.qa_prompt("", "question", "question_only").alias("prompt"))
    out = I.batch_infer(prompts, "prompt", I.refusing_completer, I.GenerationConfig(n=N_SAMPLES), retries=1, error_col="error")
    return out.select("conv_id", "turn", F.size("generated_answer").cast("bigint").alias("n_samples"),
                      F.get("generated_answer", 0).alias("first_sample"), "error")


@query("batch_infer_by_length", sql=f"""
    SELECT conv_id, turn, array_to_string([{', '.join(_sql_hash('p', i) for i in range(N_SAMPLES))}], ',') AS samples
    FROM (SELECT conv_id, turn, {_SQL_QO} AS p FROM ({Q.qa_pairs()}) q) x""")
def batch_infer_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same prompts in batches of similar length, one call a batch of 1,024 padded tokens at most."""
    pairs = C.qa_pairs(table(spark, sf_dir, "conversations"))
    prompts = pairs.select("conv_id", "turn", P.qa_prompt("", "question", "question_only").alias("prompt"))
    sized = prompts.withColumn("n_tokens", TX.whitespace_token_count("prompt"))
    out = I.complete_by_length(sized, "prompt", "n_tokens", ["conv_id", "turn"], I.hash_completer, 1024,
                               I.GenerationConfig(n=N_SAMPLES))
    return out.select("conv_id", "turn", F.array_join("completions", ",").alias("samples"))


_SQL_SEED = (f"('0x' || substr(md5('{I.GenerationConfig().seed}|' || md5(CAST(conv_id AS VARCHAR) || '|' || "
             "CAST(turn AS VARCHAR) || '|' || p)), 1, 8))::BIGINT")


@query("batch_infer_per_record", sql=f"""
    SELECT conv_id, turn, array_to_string([{', '.join(f"substr(md5(p || '|' || CAST(s AS VARCHAR) || '|{i}'), 1, 16)"
                                                      for i in range(N_SAMPLES))}], ',') AS samples
    FROM (SELECT *, {_SQL_SEED} AS s FROM (SELECT conv_id, turn, {_SQL_QO} AS p FROM ({Q.qa_pairs()}) q) x) y""")
def batch_infer_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record its own samples (a seeded stand-in for sampling), equal prompts included; no shuffle for it."""
    pairs = C.qa_pairs(table(spark, sf_dir, "conversations"))
    prompts = pairs.select("conv_id", "turn", P.qa_prompt("", "question", "question_only").alias("prompt"))
    out = I.batch_infer(prompts, "prompt", I.seeded_hash_completer, I.GenerationConfig(n=N_SAMPLES), share=False,
                        seed_cols=("conv_id", "turn"))
    return out.select("conv_id", "turn", F.array_join("generated_answer", ",").alias("samples"))


def _mode_prompts(code, question, examples) -> list[tuple[str, object]]:
    return [(m, P.answer_prompt(code, question, m, examples)) for m in P.ANSWER_MODES]


_SQL_EXAMPLES = (f"(SELECT string_agg(piece, chr(10) || chr(10) ORDER BY item_id) FROM (SELECT item_id, "
                 f"{P.sql_fill(catalog.FEWSHOT_EXAMPLE_TEMPLATE, input='text', output='text')} AS piece "
                 f"FROM benchmark ORDER BY item_id LIMIT 3) e)")
_SQL_MODES = {
    "with_code": P.sql_fill(catalog.QA_TEMPLATE_WITH_CODE, prompt="question", question="answer"),
    "question_only": P.sql_fill(catalog.QA_TEMPLATE_QUESTION_ONLY, question="answer"),
    "raw": "question",
    "summarize": P.sql_fill(catalog.SUMMARIZE_TEMPLATE, code="question"),
    "fewshot": P.sql_fill(catalog.FEWSHOT_SUMMARIZE_TEMPLATE, fewshot_examples=_SQL_EXAMPLES, code="question"),
    "codegen": P.sql_fill(catalog.CODEGEN_TEMPLATE, prompt="question", summary="answer"),
}


@query("answer_modes", sql=" UNION ALL ".join(
    f"SELECT conv_id, turn, '{m}' AS mode, {_sql_hash('(' + p + ')')} AS sample FROM ({Q.qa_pairs()}) q"
    for m, p in _SQL_MODES.items()))
def answer_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt type of the answering job, for each question turn (as code) and its answer (as
    question or summary); the few-shot block is a scalar subquery over three benchmark passages."""
    ex = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(3).select(
        "item_id", P.fewshot_example("text", F.col("text")).alias("piece"))
    block = ex.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "piece"))),
                                            lambda x: x["piece"]), "\n\n")).scalar()
    pairs = C.qa_pairs(table(spark, sf_dir, "conversations"))
    one = pairs.select("conv_id", "turn", *[p.alias(m) for m, p in _mode_prompts("question", "answer", block)])
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("prompt")) for m in P.ANSWER_MODES])
    rows = one.select("conv_id", "turn", F.explode(modes).alias("x")).select("conv_id", "turn", "x.mode", "x.prompt")
    out = I.batch_infer(rows, "prompt", I.hash_completer, I.GenerationConfig(n=1), share=False,
                        seed_cols=("conv_id", "turn", "mode"))
    return out.select("conv_id", "turn", "mode", F.get("generated_answer", 0).alias("sample"))


@query("render_messages", sql=f"""
    SELECT conv_id, turn, md5('<|user|>' || chr(10) || question || chr(10) || '<|assistant|>' || chr(10) || answer || chr(10)
           || '<|user|>' || chr(10) || {Q.lit(catalog.ANSWER_PROMPT)} || chr(10) || '<|assistant|>' || chr(10)) AS chat_md5
    FROM ({Q.qa_pairs()}) q""")
def render_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message list of three (question, answer, next user message) rendered as chat text."""
    pairs = C.qa_pairs(table(spark, sf_dir, "conversations"))
    said = F.array(F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    messages = F.concat(P.user_message("question"), said, P.user_message(F.lit(catalog.ANSWER_PROMPT)))
    return pairs.select("conv_id", "turn", F.md5(P.render_messages(messages)).alias("chat_md5"))


def _sql_generate() -> str:
    nl = "chr(10)"
    cats = ", ".join(f"({i}, {Q.lit(c)}, {'NULL' if p is None else Q.lit(p)}, {Q.lit(q)})"
                     for i, (c, p, q) in enumerate(zip(catalog.CATEGORIES, catalog.PRE_PROMPTS,
                                                       catalog.QUESTION_PROMPTS)))
    u, a = f"'<|user|>' || {nl}", f"'<|assistant|>' || {nl}"
    return f"""
    WITH r AS (SELECT d.doc_id AS code_id, d.text AS code, c.category, c.pre_prompt, c.prompt
               FROM documents d, (VALUES {cats}) AS c(category_no, category, pre_prompt, prompt)),
    ra AS (SELECT *, CASE WHEN pre_prompt IS NOT NULL THEN {u} || pre_prompt || {nl} || {a} END AS pa FROM r),
    rb AS (SELECT *, CASE WHEN pre_prompt IS NOT NULL
                          THEN {u} || pre_prompt || {nl} || {a} || {_sql_hash('pa')} || {nl} ELSE '' END
                     || {u} || concat_ws({nl} || {nl}, code, prompt) || {nl} AS body FROM ra),
    rq AS (SELECT *, {_sql_hash(f"body || {a}")} AS question FROM rb)
    SELECT code_id, category, question,
           {_sql_hash(f"body || {a} || question || {nl} || {u} || {Q.lit(catalog.ANSWER_PROMPT)} || {nl} || {a}")} AS answer
    FROM rq"""


@query("generate_qa", sql=_sql_generate())
def generate_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three chained completer stages per (code, category): context, question, answer."""
    recs = FO.over_categories(corpus(spark, sf_dir))
    out = G.generate_qa(recs, I.hash_completer)
    return out.select("code_id", "category", "question", "answer")


# --- primary rewrite with memo and chain -----------------------------------------------

def _mark(instruction: str) -> str:
    return hashlib.md5(instruction.encode()).hexdigest()[:6]


def sql_echo_rewrite(code: str, instruction: str) -> str:
    prompt = f"({code}) || chr(10) || chr(10) || {Q.lit(instruction)}"
    part = f"regexp_extract({prompt}, '(?s)^(.*)\\n\\n', 1)"
    text = (f"'Here is the code:' || chr(10) || {part} || chr(10) || '    pass  # {_mark(instruction)}'"
            f" || chr(10) || CASE WHEN {Q.bucket(part, I.BREAK_EVERY)} = 0 THEN '    )' || chr(10) ELSE '' END"
            f" || 'The behaviour is unchanged.'")
    return Q.keep_lines(text)


def _sql_primary_codes(src: str) -> str:
    """(code_id, code, refactor, dead_code, combined) for synthesised codes of ``src``."""
    ref = sql_echo_rewrite("code", catalog.REFACTOR_PROMPT)
    dead = sql_echo_rewrite("code", catalog.DEAD_CODE_PROMPT)
    return f"""
    SELECT *, {sql_echo_rewrite('refactor', catalog.DEAD_CODE_PROMPT)} AS combined
    FROM (SELECT *, {ref} AS refactor, {dead} AS dead_code FROM {src} s0) s1"""


def _sql_primary_long(src: str) -> str:
    return f"""
    SELECT code_id, 'Refactor' AS level, refactor AS obfuscated_code FROM ({_sql_primary_codes(src)}) a
    UNION ALL SELECT code_id, 'Dead Code', dead_code FROM ({_sql_primary_codes(src)}) b
    UNION ALL SELECT code_id, 'Refactor and Dead Code', combined FROM ({_sql_primary_codes(src)}) c"""


def _doc_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth_code(table(spark, sf_dir, "documents")).select("code_id", "code")


def _primary(spark: SparkSession, sf_dir: str, out=None) -> DataFrame:
    return G.primary_rewrites(_doc_codes(spark, sf_dir), I.echo_code_completer, out=out)


_SHARED = sql_synth_code(name="'shared'")


@query("memo_rewrite", sql=" UNION ALL ".join(f"""
    SELECT md5(code) AS code_key, '{level}' AS primary_obfuscation, count(*)::BIGINT AS n_codes,
           ({len(catalog.CATEGORIES)} * count(*))::BIGINT AS n_records, md5(min({col})) AS code_md5
    FROM ({_sql_primary_codes(_SHARED)}) p GROUP BY code"""
    for level, col in (("Refactor", "refactor"), ("Dead Code", "dead_code"), ("Refactor and Dead Code", "combined"))))
def memo_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model call for each distinct code and level: functions here share a name, so equal texts
    share their rewrites; returns how many codes and records each call serves."""
    codes = synth_code(table(spark, sf_dir, "documents"), name=F.lit("shared"))
    keyed = codes.select(F.md5("code").alias("code_id"), "code")
    rewrites = G.primary_rewrites(keyed.dropDuplicates(["code_id"]), I.echo_code_completer)
    uses = keyed.groupBy("code_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_codes"))
    records = FO.over_categories(uses).groupBy("code_id").agg(
        F.first("n_codes").alias("n_codes"), F.sum("n_codes").cast("bigint").alias("n_records"))
    # only the digests meet the counts: no text is joined a second time
    digests = rewrites.select("code_id", "level", F.md5("obfuscated_code").alias("code_md5"))
    return digests.join(records, "code_id").select(
        F.col("code_id").alias("code_key"), F.col("level").alias("primary_obfuscation"), "n_codes", "n_records", "code_md5")


@query("chained_rewrite", sql=f"""
    SELECT code_id, md5(combined) AS code_md5, md5(refactor) AS first_stage_md5
    FROM ({_sql_primary_codes(sql_synth_code())}) p""")
def chained_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined level rewrites the cached first-stage (refactor) output."""
    rw = _primary(spark, sf_dir)
    first = rw.filter(F.col("level") == "Refactor").select("code_id", F.md5("obfuscated_code").alias("first_stage_md5"))
    comb = rw.filter(F.col("level") == "Refactor and Dead Code").select(
        "code_id", F.md5("obfuscated_code").alias("code_md5"))
    return comb.join(first, "code_id")


@query("primary_rewrite", sql=f"""
    WITH s AS {sql_synth_code()},
    p AS ({_sql_primary_long(sql_synth_code())}),
    cats AS (SELECT unnest({Q.str_list(catalog.CATEGORIES)}) AS category),
    lv AS (SELECT unnest({Q.str_list(catalog.PRIMARY_LEVELS)}) AS primary_obfuscation)
    SELECT s.code_id, cats.category, lv.primary_obfuscation,
           md5(CASE WHEN lv.primary_obfuscation = 'None' THEN s.code ELSE p.obfuscated_code END) AS code_md5
    FROM s CROSS JOIN cats CROSS JOIN lv
    LEFT JOIN p ON p.code_id = s.code_id AND p.level = lv.primary_obfuscation""")
def primary_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records (code x category) x primary levels with their (memoised) code."""
    # only digests are joined; the categories of a code share its rewrites: they fan out after the join
    digests = _doc_codes(spark, sf_dir).select("code_id", F.md5("code").alias("code"))
    out = G.primary_records(digests, _primary(spark, sf_dir, out=F.md5))
    out = out.select("code_id", "primary_obfuscation", F.col("obfuscated_code").alias("code_md5"))
    return FO.over_categories(out).select("code_id", "category", "primary_obfuscation", "code_md5")


# --- resume and replay -----------------------------------------------------------------

@query("resume_pending", sql="""
    SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a written result: documents anti-join the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    done = table(spark, sf_dir, "labels").select("doc_id")
    return I.pending(docs, done, ["doc_id"])


@query("pending_rows", sql="""
    SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL""")
def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose output column is still NULL after attaching results."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    out = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return I.pending_rows(out, "quality").select("doc_id")


@query("replay_outputs", sql=f"""
    WITH rec AS (SELECT md5(question) AS k, min([answer]) AS texts FROM ({Q.qa_pairs()}) q GROUP BY md5(question))
    SELECT c.conv_id, c.turn, rec.texts[1] AS replayed
    FROM conversations c LEFT JOIN rec ON rec.k = md5(c.text) WHERE c.role = 'user'""")
def replay_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers attached to user turns by prompt text, not by position."""
    msgs = table(spark, sf_dir, "conversations")
    recorded = C.qa_pairs(msgs).select(F.col("question").alias("prompt"), F.array("answer").alias("texts"))
    users = msgs.filter(F.col("role") == "user").select("conv_id", "turn", "text")
    out = I.replay(users, "text", recorded)
    return out.select("conv_id", "turn", F.get(F.col("generated_answer"), 0).alias("replayed"))


def _sql_followups(n: int = catalog.FOLLOWUP_N) -> str:
    nl = "chr(10)"

    def u(x: str) -> str:
        return f"('<|user|>' || {nl} || {x} || {nl})"

    def a(x: str) -> str:
        return f"('<|assistant|>' || {nl} || {x} || {nl})"
    gen = f"('<|assistant|>' || {nl})"
    rows = ", ".join(f"({Q.lit(c)}, {Q.lit(f)}, {Q.lit(nx)}, {'true' if c == 'extractive' else 'false'})"
                     for c, f, nx in zip(catalog.FOLLOWUP_CATEGORIES, catalog.FOLLOWUP_FIRST_PROMPTS,
                                         catalog.FOLLOWUP_NEXT_PROMPTS))
    ctx = u(Q.lit(catalog.FOLLOWUP_EXTRACTIVE_CONTEXT))
    ans = (f"CASE WHEN extractive THEN {Q.lit(catalog.FOLLOWUP_SPAN_PROMPT)} "
           f"ELSE {Q.lit(catalog.FOLLOWUP_ANSWER_PROMPT)} END")
    ctes = [f"""r AS (SELECT d.doc_id AS code_id, d.text AS code, f.* FROM documents d,
                (VALUES {rows}) AS f(category, first_prompt, next_prompt, extractive))""",
            f"t0 AS (SELECT *, CASE WHEN extractive THEN {ctx} || {a(_sql_hash(ctx + ' || ' + gen))} ELSE '' END AS t FROM r)"]
    for i in range(n):
        ask = "concat_ws(chr(10) || chr(10), code, first_prompt)" if i == 0 else "next_prompt"
        ctes.append(f"q{i} AS (SELECT *, {_sql_hash(f't || {u(ask)} || {gen}')} AS question{i},"
                    f" t || {u(ask)} AS tq FROM t{i})")
        ctes.append(f"a{i} AS (SELECT *, tq || {a(f'question{i}')} || {u(ans)} AS ta FROM q{i})")
        ctes.append(f"t{i + 1} AS (SELECT * EXCLUDE (t, tq, ta), {_sql_hash(f'ta || {gen}')} AS answer{i},"
                    f" ta || {a(_sql_hash(f'ta || {gen}'))} AS t FROM a{i})")
    union = " UNION ALL ".join(
        f"SELECT code_id, category, {i}::BIGINT AS q_no, question{i} AS question, answer{i} AS answer FROM t{n}"
        for i in range(n))
    return "WITH " + ",\n".join(ctes) + "\n" + union


@query("generate_followups", sql=_sql_followups())
def generate_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n follow-up question/answer rounds per category in one growing transcript."""
    return G.generate_followups(corpus(spark, sf_dir), I.hash_completer)
