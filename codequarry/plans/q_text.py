"""Text-cleaning queries over whole documents (and code synthesised from them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import evaluate as E
from ..operators import sentences as SE
from ..sources import readers as R
from ..sources.tables import SQL_SYNTH_CODE, synth_code, table
from . import catalog
from . import sqlbits as Q
from .registry import query

WS = Q.WS
_PREFIX_SQL = "regexp_replace({col}, '^(?:r\"\"\"|r''''''|u\"\"\")" + WS + "*', '')"
_STRIP_DOC_SQL = (
    "regexp_replace(code, '\\s*\\w*r?u?(\"\"\"|\"|''|'''''')\\s*' || "
    "regexp_replace(docstring, '([\\\\.+*?^$()\\[\\]{}|])', '\\\\\\1', 'g') || "
    "'\\s*(\"\"\"|\"|''|'''''')\\s*\\n', chr(10), 'gs')")


@query("strip_docstring", sql=f"""
    SELECT code_id, {_STRIP_DOC_SQL} AS code FROM {SQL_SYNTH_CODE} s""")
def strip_docstring(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = synth_code(table(spark, sf_dir, "documents"))
    return code.select("code_id", TX.strip_docstring("code", "docstring").alias("code"))


@query("leak_flag", sql=f"""
    SELECT code_id, contains(code, docstring) AS leaked_before,
           contains({_STRIP_DOC_SQL}, docstring) AS leaked_after
    FROM {SQL_SYNTH_CODE} s""")
def leak_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = synth_code(table(spark, sf_dir, "documents"))
    return code.select("code_id", TX.leak_flag("code", "docstring").alias("leaked_before"),
                       TX.leak_flag(TX.strip_docstring("code", "docstring"), "docstring").alias("leaked_after"))


@query("leak_report", sql=f"""
    SELECT d.source, s.code_id
    FROM {SQL_SYNTH_CODE} s JOIN documents d ON d.doc_id = s.code_id
    WHERE contains({_STRIP_DOC_SQL.replace('code,', 's.code,').replace('(docstring,', '(s.docstring,')}, s.docstring)""")
def leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the rows whose docstring survives stripping, with their source."""
    code = synth_code(table(spark, sf_dir, "documents"), keep=("source",))
    leaked = TX.leak_flag(TX.strip_docstring("code", "docstring"), "docstring")
    # a filter would be pushed into the scan with a copy of the synthesised code for each use of it; an array of one is not
    found = F.filter(F.array(F.struct("source", "code_id", leaked.alias("leaked"))), lambda x: x["leaked"])
    return code.select(F.explode(found).alias("x")).select("x.source", "x.code_id")


@query("strip_prefix", sql=f"""
    SELECT doc_id,
           md5({_PREFIX_SQL.replace("{col}", "text")}) AS comment_md5,
           md5(regexp_replace(text, '^[ru] {WS}*', '')) AS token_md5
    FROM documents""")
def strip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(TX.strip_comment_prefix("text")).alias("comment_md5"),
                    F.md5(TX.strip_token_prefix("text")).alias("token_md5"))


@query("join_tokens", sql=f"""
    SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> ''), ' ')) AS doc_md5
    FROM documents""")
def join_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(TX.join_tokens(TX.whitespace_tokens("text"))).alias("doc_md5"))


@query("fix_punct", sql="""
    SELECT doc_id, md5(replace(regexp_replace(text, '\\s([?.!"](\\s|$))', '\\1', 'g'), ' - ', '-')) AS text_md5
    FROM documents""")
def fix_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(TX.fix_punctuation("text")).alias("text_md5"))


_NUM = ("^[+-]?(?:(?:\\d(?:_?\\d)*(?:\\.(?:\\d(?:_?\\d)*)?)?|\\.\\d(?:_?\\d)*)"
        "(?:e[+-]?\\d(?:_?\\d)*)?|nan|inf|infinity)$")
_PUNCT_SQL = Q.lit("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _entry_sql(text_expr: str, src: str, key: str) -> str:
    stop = Q.str_list(catalog.ENTRY_STOP_WORDS)
    return f"""
    SELECT {key}, array_to_string(
        [CASE WHEN starts_with(w5[1], '¿') THEN substr(w5[1], 2) ELSE w5[1] END] || w5[2:], '_') AS name
    FROM (SELECT {key}, CASE WHEN len(w4) < 2 THEN list_prepend('f', w4) ELSE w4 END AS w5
      FROM (SELECT {key}, list_filter(list_transform(w3, lambda x: translate(x, {_PUNCT_SQL}, '')), lambda x: x <> '') AS w4
        FROM (SELECT {key}, CASE WHEN p3 = 0 THEN w2 ELSE w2[1:p3 - 1] END AS w3
          FROM (SELECT {key}, w2, coalesce(list_position(list_transform(w2, lambda x: starts_with(x, '`') OR starts_with(x, '''')), true), 0) AS p3
            FROM (SELECT {key}, CASE WHEN p2 = 0 THEN w1 ELSE w1[1:p2 - 1] END AS w2
              FROM (SELECT {key}, w1, coalesce(list_position(list_transform(w1, lambda x, i: i > 2 AND list_contains({stop}, x)), true), 0) AS p2
                FROM (SELECT {key}, CASE WHEN p1 = 0 THEN w0 ELSE w0[1:p1 - 1] END AS w1
                  FROM (SELECT {key}, w0, coalesce(list_position(list_transform(w0, lambda x: regexp_matches(x, '{_NUM}')), true), 0) AS p1
                    FROM (SELECT {key}, list_transform(list_filter(regexp_split_to_array({text_expr}, '\\s+'), lambda x: x <> '')[1:{catalog.ENTRY_FIRST_NWORDS}], lambda x: lower(x)) AS w0
                          FROM {src}) a) b) c) d) e) f) g) h) i"""


@query("entry_point_name", sql=_entry_sql("text", "documents", "doc_id"))
def entry_point_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.entry_point_name("text").alias("name"))


@query("replace_head", sql=f"""
    WITH s AS {SQL_SYNTH_CODE},
    n AS ({_entry_sql("text", "documents", "doc_id")})
    SELECT s.code_id,
           regexp_replace(replace(
               ('def ' || n.name || CASE WHEN strpos(split_part(s.code, chr(10), 1), '(') > 0
                    THEN substr(split_part(s.code, chr(10), 1), strpos(split_part(s.code, chr(10), 1), '(')) END)
               || substr(s.code, strpos(s.code, chr(10))) || '', chr(9), '    '),
               '^{WS}+|{WS}+$', '', 'g') AS input
    FROM s JOIN n ON n.doc_id = s.code_id""")
def replace_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent-style examples: head renamed from the text, body and an empty suffix appended."""
    code = synth_code(table(spark, sf_dir, "documents"), keep=("text",))
    head = F.substring_index("code", "\n", 1)
    body = F.col("code").substr(F.locate("\n", F.col("code")), F.length("code"))
    new_head = TX.rename_head(head, TX.entry_point_name("text"))
    return code.select("code_id", TX.assemble_solution(new_head, body, F.lit("")).alias("input"))


@query("first_sentence", sql=f"""
    SELECT doc_id, CASE WHEN fs = '' THEN {Q.strip('text')} ELSE fs END AS sentence
    FROM (SELECT doc_id, text, regexp_extract(text, '(?s)^{WS}*(.*?[.!?])(?:{WS}|$)', 1) AS fs FROM documents) d""")
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.first_sentence("text").alias("sentence"))


_TYPE_SQL = """regexp_replace(lower({w}), '^[(\\["'']+|[)\\]"'',;:!?]*\\.?$', '', 'g')"""
_TOKS_SQL = "list_filter(regexp_split_to_array(text, '[\\x09-\\x0D\\x20]+'), lambda w: w <> '')"


@query("learned_sentence", sql=f"""
    WITH t AS (SELECT doc_id, text, {_TOKS_SQL} AS toks FROM documents),
    seen AS (SELECT {_TYPE_SQL.format(w='tok')} AS type, count(*) AS n, count_if(ends_with(tok, '.')) AS c
             FROM (SELECT unnest(toks) AS tok FROM t) x GROUP BY 1),
    s AS (SELECT type, n::DOUBLE AS n, c::DOUBLE AS c, (SELECT sum(c)::DOUBLE / sum(n)::DOUBLE FROM seen) AS p,
                 least(c::DOUBLE / n, 0.99) AS q, length(type) - length(replace(type, '.', '')) AS inner_stops
          FROM seen WHERE n >= {SE.MIN_SEEN} AND c > 0 AND length(type) BETWEEN 1 AND {SE.MAX_TYPE}
          AND regexp_full_match(type, '[\\p{{L}}.]+')),
    abbr AS (SELECT type FROM s WHERE c / n > p AND
             -2 * ((c * ln(p) + (n - c) * ln(1 - p)) - (c * ln(q) + (n - c) * ln(1 - q)))
             * (inner_stops + 1) * exp(-(length(type) - inner_stops)::DOUBLE) * pow(n, -(n - c)) >= {SE.MIN_SCORE}),
    e AS (SELECT doc_id, i, w FROM (SELECT doc_id, unnest(toks) AS w, unnest(range(len(toks))) AS i FROM t) x
          WHERE regexp_matches(w, '[.!?][)\\]"'']*$')),
    f AS (SELECT doc_id, min(i) AS i FROM e
          WHERE NOT (ends_with(w, '.') AND {_TYPE_SQL.format(w='w')} IN (SELECT type FROM abbr)) GROUP BY doc_id)
    SELECT t.doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(toks[1:coalesce(f.i + 1, len(toks))], ' ') END AS sentence
    FROM t LEFT JOIN f ON f.doc_id = t.doc_id""")
def learned_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentences, with abbreviations learned from all documents."""
    d = table(spark, sf_dir, "documents")
    return SE.first_sentences(d, SE.abbreviations(d))


_CHATTER = "Sure! Here is the code:\n```python\n"
_CHATTER_END = "\n```\nThe behaviour is unchanged."


@query("keep_code_lines", sql=f"""
    SELECT code_id, array_to_string(list_filter(string_split({Q.lit(_CHATTER)} || code || {Q.lit(_CHATTER_END)}, chr(10)),
        lambda l: starts_with(l, chr(9)) OR starts_with(l, ' ') OR starts_with(l, 'def ') OR starts_with(l, 'class ')), chr(10)) AS code
    FROM {SQL_SYNTH_CODE} s""")
def keep_code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trim a chatty completion wrapped around each synthesised function."""
    code = synth_code(table(spark, sf_dir, "documents"))
    wrapped = F.concat(F.lit(_CHATTER), F.col("code"), F.lit(_CHATTER_END))
    return code.select("code_id", TX.keep_code_lines(wrapped).alias("code"))


@query("max_token_len", sql=f"""
    SELECT max(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')))::BIGINT AS max_tokens
    FROM documents""")
def max_token_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.max_token_len(table(spark, sf_dir, "documents"), "text")


@query("normalise_examples", sql=f"""
    WITH s0 AS {SQL_SYNTH_CODE},
    s AS (SELECT code_id, code, docstring AS raw_doc,
                 {_PREFIX_SQL.replace("{col}", "docstring")} AS docstring FROM s0),
    c AS (SELECT code_id, docstring AS doc0, {_STRIP_DOC_SQL} AS code,
                 list_filter(regexp_split_to_array(raw_doc, '{WS}+'), lambda w: w <> '') AS toks
          FROM s)
    SELECT code_id, md5(code) AS input_md5,
           regexp_replace(replace(regexp_replace(array_to_string(toks, ' '), '\\s([?.!"](\\s|$))', '\\1', 'g'), ' - ', '-'),
                          '^[ru] \\s*', '') AS output,
           contains(code, doc0) AS leaked
    FROM c""")
def normalise_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Docstring corpus -> (input, output): strip, rebuild from tokens, fix spacing."""
    code = synth_code(table(spark, sf_dir, "documents"))
    corpus = code.withColumn("docstring_tokens", TX.whitespace_tokens("docstring"))
    ex = R.clean_docstring_examples(corpus)
    return ex.select("code_id", F.md5("input").alias("input_md5"), "output", "leaked")
