"""Parser-based rewrite queries (undocument, rename, substitution, fallback).

The code is synthesised from the tables (see ``synth_code``), so its
re-printed form is known in advance and the DuckDB twin can state it: a
function parses unless one of its three words is a keyword or starts with a
digit; aliases are md5(seed | md5(code) | name) in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversation as C
from ..operators import evaluate as E
from ..operators import generate as G
from ..operators import infer as I
from ..operators import rewrite as RW
from ..operators import table_functions as TF
from ..operators.util import join_on_key
from ..session import persisted
from ..sources.tables import sql_synth_code, synth_code, table
from . import catalog
from . import sqlbits as Q
from .q_inference import sql_echo_rewrite
from .registry import query

SEED = catalog.DEFAULT_SEED
# FIXED VALUES: Python's reserved words (lower-case ones can occur as words).
KEYWORDS = ["and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif",
            "else", "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda",
            "nonlocal", "not", "or", "pass", "raise", "return", "try", "while", "with", "yield"]


def _sql_ok(*words: str) -> str:
    kws = ", ".join(Q.lit(k) for k in KEYWORDS)
    return " AND ".join(f"NOT ({w} IN ({kws}) OR regexp_matches({w}, '^[0-9]'))" for w in words)


def _sql_alias(key: str, name: str) -> str:
    return f"('_' || substr(md5('{SEED}|' || {key} || '|' || {name}), 1, 16))"


def _sql_unparse(ident: str, doc: str, key: str, n_pass: str, rename: bool, undoc: bool,
                 w=("w1", "w2", "w3")) -> str:
    """Re-printed synthesised function (ast.unparse form) as SQL."""
    w1, w2, w3 = w
    a = (lambda x: _sql_alias(key, x)) if rename else (lambda x: x)
    ln = (f"CASE WHEN 'len' IN ({w1}, {w2}, {w3}) THEN {_sql_alias(key, Q.lit('len'))} ELSE 'len' END"
          if rename else "'len'")
    nl = "chr(10)"
    parts = [f"'def ' || {a(f'(' + Q.lit('f_') + ' || ' + ident + ')')} || '(' || {a(w1)} || ', ' || {a(w2)} || '):'"]
    if not undoc:
        parts.append(f"{nl} || '    ' || repeat(chr(34), 3) || {doc} || repeat(chr(34), 3)")
    parts.append("CASE WHEN notes = '' THEN '' ELSE chr(10) || rtrim(notes, chr(10)) END")
    parts.append(f"{nl} || '    ' || {a(w3)} || ' = ' || {ln} || '(' || {a(w1)} || ') + ' || {a(w2)}")
    parts.append(f"{nl} || '    return ' || {a(w3)}")
    parts.append(f"repeat({nl} || '    pass', {n_pass})")
    return "(" + " || ".join(parts) + ")"


def _sql_names(ident: str, key: str) -> str:
    """Renamed identifiers of one synthesised function in first-visit order."""
    return f"""
    SELECT code_id, name, {_sql_alias('k0', 'name')} AS alias, name = ('f_' || {ident}) AS is_def,
           (dense_rank() OVER (PARTITION BY code_id ORDER BY p) - 1)::BIGINT AS first_pos
    FROM (SELECT code_id, k0, {ident}, name, min(pos) AS p FROM (
            SELECT code_id, k0, {ident}, unnest(nm) AS name, unnest(range(len(nm))) AS pos FROM (
                SELECT *, {key} AS k0,
                       ['f_' || {ident}, w1, w2, w3] || CASE WHEN 'len' IN (w1, w2, w3) THEN ['len'] ELSE [] END AS nm
                FROM s) a) b GROUP BY ALL) c"""


# --- documents corpus -----------------------------------------------------------------

_DOCS = sql_synth_code(extra="CAST(doc_id AS VARCHAR) AS ident_s,")


def _doc_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code_id, code, _key) of the documents, written once: the parser's job reads the codes, the
    join back to the rows only the keys, so no code is synthesised a second time for its key."""
    code = synth_code(table(spark, sf_dir, "documents")).select("code_id", "code")
    return persisted(code.withColumn("_key", F.md5("code")), "codes")


def _doc_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _doc_codes(spark, sf_dir)
    res = RW.rewrite_distinct(code, "code", SEED)
    return join_on_key(code.select("code_id", "_key"), res, "_key", "code_key").drop("_key")


@query("undocument", sql=f"""
    SELECT code_id, {_sql_ok('w1', 'w2', 'w3')} AS ok,
           CASE WHEN {_sql_ok('w1', 'w2', 'w3')} THEN {_sql_unparse('ident_s', 'docstring', 'md5(code)', '0', False, True)} END AS undocumented
    FROM {_DOCS} s""")
def undocument(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_results(spark, sf_dir).select("code_id", "ok", "undocumented")


@query("rename_code", sql=f"""
    SELECT code_id,
           CASE WHEN {_sql_ok('w1', 'w2', 'w3')} THEN {_sql_unparse('ident_s', 'docstring', 'md5(code)', '0', True, False)} END AS renamed,
           CASE WHEN {_sql_ok('w1', 'w2', 'w3')} THEN {_sql_unparse('ident_s', 'docstring', 'md5(code)', '0', True, True)} END AS both
    FROM {_DOCS} s""")
def rename_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_results(spark, sf_dir).select("code_id", "renamed", "both")


@query("identifier_table", sql=f"""
    WITH s AS (SELECT * FROM {_DOCS} x WHERE {_sql_ok('w1', 'w2', 'w3')})
    {_sql_names('ident_s', 'md5(code)')}""")
def identifier_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = _doc_results(spark, sf_dir)
    return res.select("code_id", F.explode("idents").alias("i")).select(
        "code_id", "i.name", "i.alias", "i.is_def", "i.first_pos")


@query("identifiers_lateral", sql=f"""
    WITH s AS (SELECT * FROM {_DOCS} x WHERE {_sql_ok('w1', 'w2', 'w3')})
    {_sql_names('ident_s', 'md5(code)')}""")
def identifiers_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by the table function ``identifiers`` and LATERAL."""
    return TF.identifiers(synth_code(table(spark, sf_dir, "documents")), "code_id")


@query("alias_map", sql=f"""
    WITH s AS (SELECT * FROM {_DOCS} x WHERE {_sql_ok('w1', 'w2', 'w3')})
    SELECT code_id, name, alias FROM ({_sql_names('ident_s', 'md5(code)')}) n""")
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias map per code (map column built from the identifier rows), as rows."""
    res = _doc_results(spark, sf_dir).select("code_id", RW.alias_map(F.col("idents")).alias("m"))
    return res.select("code_id", F.explode("m").alias("name", "alias"))


# --- transcripts: code made from each question, Q/A renamed ------------------------------

def _qa_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = C.qa_pairs(table(spark, sf_dir, "conversations"))
    pairs = pairs.withColumn("qa_key", F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return synth_code(pairs, key="qa_key", text="question", name=F.col("qa_key"),
                      keep=("conv_id", "turn", "question", "answer"))


_QA = sql_synth_code(src=f"({Q.qa_pairs()})",
                     key="(CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR))", text="question",
                     extra="conv_id, turn, question, answer, ident AS ident_s,")

_RUNS = "'([\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+)'"


def _sql_sub(text: str, key: str, ok: str) -> str:
    names = ["'f_' || ident_s", "w1", "w2", "w3"]
    whens = " ".join(f"WHEN r = {n} THEN {_sql_alias(key, n)}" for n in names)
    ln = f"WHEN r = 'len' AND 'len' IN (w1, w2, w3) THEN {_sql_alias(key, Q.lit('len'))}"
    return (f"CASE WHEN {ok} THEN array_to_string(list_transform(regexp_extract_all({text}, {_RUNS}, 1),"
            f" lambda r: CASE {whens} {ln} ELSE r END), '') ELSE {text} END")


@query("substitute_names", sql=f"""
    SELECT conv_id, turn, {_sql_sub('question', 'md5(code)', _sql_ok('w1', 'w2', 'w3'))} AS question,
           {_sql_sub('answer', 'md5(code)', _sql_ok('w1', 'w2', 'w3'))} AS answer
    FROM {_QA} s""")
def substitute_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer renamed with the alias map of the code they ask about."""
    codes = _qa_codes(spark, sf_dir)
    res = RW.rewrite_distinct(codes, "code", SEED)
    j = join_on_key(codes, res.select("code_key", RW.alias_map(F.col("idents")).alias("m")), F.md5("code"), "code_key")
    return j.select("conv_id", "turn", RW.substitute("question", "m").alias("question"),
                    RW.substitute("answer", "m").alias("answer"))


def qa_secondary_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full rewrite grid for transcript Q/A: 4 primary x 4 secondary levels."""
    codes = _qa_codes(spark, sf_dir)
    rewrites = G.primary_rewrites(codes.select("code_id", "code"), I.echo_code_completer)
    variants = G.primary_records(codes.withColumnRenamed("code", "original_code")
                                      .withColumn("code", F.col("original_code")), rewrites)
    return RW.secondary_grid(variants, ["conv_id", "turn"], SEED, extra=())


_PCODE = {
    "None": "code",
    "Refactor": sql_echo_rewrite("code", catalog.REFACTOR_PROMPT),
    "Dead Code": sql_echo_rewrite("code", catalog.DEAD_CODE_PROMPT),
}
_PCODE["Refactor and Dead Code"] = sql_echo_rewrite(_PCODE["Refactor"], catalog.DEAD_CODE_PROMPT)


def _sql_grid() -> str:
    prim = " ".join(f"WHEN {Q.lit(k)} THEN {v}" for k, v in _PCODE.items())
    npass = "CASE p.lv WHEN 'None' THEN 0 WHEN 'Refactor and Dead Code' THEN 2 ELSE 1 END"
    ok = _sql_ok("w1", "w2", "w3")
    sec = {
        "Undocument": _sql_unparse("ident_s", "docstring", "pkey", "npass", False, True),
        "Rename": _sql_unparse("ident_s", "docstring", "pkey", "npass", True, False),
        "Undocument and Rename": _sql_unparse("ident_s", "docstring", "pkey", "npass", True, True),
    }
    secw = " ".join(f"WHEN {Q.lit(k)} THEN {v}" for k, v in sec.items())
    return f"""
    WITH p AS (
        SELECT s.*, lv.lv, CASE lv.lv {prim} END AS pcode
        FROM {_QA} s, (SELECT unnest({Q.str_list(catalog.PRIMARY_LEVELS)}) AS lv) lv),
    g AS (
        SELECT p.*, CASE WHEN broken THEN md5(code) ELSE md5(pcode) END AS pkey,
               CASE WHEN broken THEN 0 ELSE {npass} END AS npass, sl.sl
        FROM (SELECT *, contains(pcode, chr(10) || '    )') AS broken FROM p) p, (SELECT unnest({Q.str_list(catalog.SECONDARY_LEVELS)}) AS sl) sl)
    SELECT conv_id, turn, lv AS primary_obfuscation, sl AS secondary_obfuscation,
           (sl <> 'None' AND (broken OR NOT ({ok}))) AS error,
           md5(CASE WHEN sl = 'None' OR NOT ({ok}) THEN pcode ELSE CASE sl {secw} END END) AS code_md5,
           CASE WHEN sl IN ('Rename', 'Undocument and Rename') THEN {_sql_sub('question', 'pkey', ok)} ELSE question END AS question,
           CASE WHEN sl IN ('Rename', 'Undocument and Rename') THEN {_sql_sub('answer', 'pkey', ok)} ELSE answer END AS answer
    FROM g"""


_SQL_GRID = _sql_grid()


@query("secondary_grid", headline=True, sql=_SQL_GRID)
def secondary_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = qa_secondary_grid(spark, sf_dir)
    return g.select("conv_id", "turn", "primary_obfuscation", "secondary_obfuscation", "error",
                    F.md5("secondary_obfuscated_code").alias("code_md5"), "question", "answer")


@query("fallback_rate", sql=f"""
    SELECT primary_obfuscation, secondary_obfuscation, count(*)::BIGINT AS n_rows,
           count_if(error)::BIGINT AS n_errors, round(avg(error::INT::DOUBLE), 6) AS error_rate
    FROM ({_SQL_GRID}) g GROUP BY ALL""")
def fallback_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of variants whose rewrite fell back, per level cell."""
    return E.fallback_rate(qa_secondary_grid(spark, sf_dir))


_O2 = "CASE WHEN w2 = w1 THEN 1 ELSE 2 END"
_O3 = f"CASE WHEN w3 = w1 THEN 1 WHEN w3 = w2 THEN {_O2} ELSE 2 + (w2 <> w1)::INT END"
_OL = (f"CASE WHEN w1 = 'len' THEN 1 WHEN w2 = 'len' THEN {_O2} WHEN w3 = 'len' THEN {_O3} "
       f"ELSE 1 + (1 + (w2 <> w1)::INT + (w3 <> w1 AND w3 <> w2)::INT) END")


def _sql_ordinal_code() -> str:
    def a(o: str) -> str:
        return f"('_' || CAST({o} AS VARCHAR))"
    nl = "chr(10)"
    return (f"('def ' || {a('0')} || '(' || {a('1')} || ', ' || {a(_O2)} || '):' || {nl}"
            f" || '    ' || repeat(chr(34), 3) || docstring || repeat(chr(34), 3) || {nl} || notes"
            f" || '    ' || {a(_O3)} || ' = ' || {a(_OL)} || '(' || {a('1')} || ') + ' || {a(_O2)} || {nl}"
            f" || '    return ' || {a(_O3)})")


def _sql_ordinal() -> str:
    return f"""
    SELECT code_id, CASE WHEN {_sql_ok('w1', 'w2', 'w3')} THEN {_sql_ordinal_code()} END AS renamed
    FROM {_DOCS} s"""


@query("rename_ordinal", sql=_sql_ordinal())
def rename_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older rename scheme: every name becomes _0, _1, ... in first-visit order."""
    code = _doc_codes(spark, sf_dir)
    res = RW.rename_ordinal_distinct(code, "code")
    return join_on_key(code.select("code_id", "_key"), res, "_key", "code_key").select("code_id", "renamed")


@query("identifier_stats", sql=f"""
    WITH s AS (SELECT * FROM {_DOCS} x WHERE {_sql_ok('w1', 'w2', 'w3')}),
    n AS ({_sql_names('ident_s', 'md5(code)')})
    SELECT code_id, count(*)::BIGINT AS n_names, count(DISTINCT alias)::BIGINT AS n_aliases,
           count_if(is_def)::BIGINT AS n_defs, count(DISTINCT alias) = count(*) AS aliases_unique
    FROM n GROUP BY code_id""")
def identifier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per code: renamed names, distinct aliases (must equal names), definitions."""
    ids = identifier_table(spark, sf_dir)
    return ids.groupBy("code_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_names"),
        F.countDistinct("alias").cast("bigint").alias("n_aliases"),
        F.count_if("is_def").cast("bigint").alias("n_defs"),
        (F.countDistinct("alias") == F.count(F.lit(1))).alias("aliases_unique"))


def _sql_sub_ordinal(text: str) -> str:
    whens = (f"WHEN r = 'f_' || ident_s THEN '_0' WHEN r = w1 THEN '_1' WHEN r = w2 THEN '_' || CAST({_O2} AS VARCHAR) "
             f"WHEN r = w3 THEN '_' || CAST({_O3} AS VARCHAR) WHEN r = 'len' THEN '_' || CAST({_OL} AS VARCHAR)")
    return (f"array_to_string(list_transform(regexp_extract_all({text}, {_RUNS}, 1),"
            f" lambda r: CASE {whens} ELSE r END), '')")


def _sql_older_grid() -> str:
    ok = _sql_ok("w1", "w2", "w3")
    code = (f"CASE lv WHEN 'None' THEN code"
            f" WHEN 'Undocument' THEN CASE WHEN {ok} THEN {_sql_unparse('ident_s', 'docstring', 'k', '0', False, True)} ELSE code END"
            f" WHEN 'Rename' THEN CASE WHEN {ok} THEN {_sql_ordinal_code()} ELSE code END"
            f" WHEN 'Refactor' THEN {_PCODE['Refactor']} WHEN 'Dead Code' THEN {_PCODE['Dead Code']} END")
    return f"""
    SELECT conv_id, turn, lv AS obfuscation, md5({code}) AS code_md5,
           (lv IN ('Undocument', 'Rename') AND NOT ({ok})) AS error,
           CASE WHEN lv = 'Rename' AND {ok} THEN {_sql_sub_ordinal('question')} ELSE question END AS question,
           CASE WHEN lv = 'Rename' AND {ok} THEN {_sql_sub_ordinal('answer')} ELSE answer END AS answer
    FROM (SELECT *, md5(code) AS k FROM {_QA} s0) s,
         (SELECT unnest({Q.str_list(catalog.PRIMARY_LEVELS_V1)}) AS lv) l"""


@query("older_grid", sql=_sql_older_grid())
def older_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older five-level variant over transcript Q/A with code made from each question."""
    codes = _qa_codes(spark, sf_dir)
    rewrites = G.primary_rewrites(codes.select("code_id", "code"), I.echo_code_completer)
    g = RW.older_grid(codes, ["conv_id", "turn"], rewrites)
    return g.select("conv_id", "turn", "obfuscation", F.md5("obfuscated_code").alias("code_md5"), "error",
                    "question", "answer")
