"""Readers for the Parquet tables and the code corpus derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``spark.read.parquet`` of one table; Catalyst prunes columns and pushes filters."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code corpus (code_id, code): one text column of the document table."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("code_id"),
                                                    F.col("text").alias("code"))


LEAK_EVERY = 5


def _notes(text: str) -> Column:
    """One line ``    assert '<words>'`` for each line of ``text`` that has words."""
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda x: F.array_join(T.word_tokens(x), " "))
    return F.array_join(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.concat(
        F.lit("    assert '"), x, F.lit("'\n"))), "")


def synth_code(docs: DataFrame, key: str = "doc_id", text: str = "text", name=None,
               out_key: str = "code_id", keep: tuple = ()) -> DataFrame:
    """Python functions synthesised from prose: (code_id, code, docstring).

    ``def f_<id>(<w1>, <w2>):`` with the first sentence (one line) as
    docstring, one assertion for each line of the text that has words, down
    to the last word, a local built from a builtin call and a return.  In
    one of ``LEAK_EVERY`` codes, by hash of the key, a comment repeats the
    docstring.  The names are the first three lower-case ASCII words, so some
    rows use keywords and do not parse; the rewrite jobs' fallback handles
    them.
    """
    # Stage the whole-text regex results once; later expressions refer to
    # them several times and Catalyst keeps such non-cheap columns shared.
    ident = name if name is not None else F.col(key).cast("string")
    staged = docs.select(*keep, F.col(key).alias("_key"), ident.alias("_ident"),
                         T.first_ascii_words(text, 3).alias("_w"), T.first_sentence(text).alias("_fs"),
                         _notes(text).alias("_notes"))
    w1, w2, w3 = (F.coalesce(F.try_element_at(F.col("_w"), F.lit(i)), F.lit("x")) for i in (1, 2, 3))
    doc = F.replace(F.col("_fs"), F.lit("\\"), F.lit(""))
    doc = F.replace(F.replace(doc, F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))
    ident = F.col("_ident")
    again = F.when(H.md5_bucket(ident, LEAK_EVERY) == 0, F.concat(F.lit("    # "), doc, F.lit("\n"))).otherwise("")
    code = F.concat(
        F.lit("def f_"), ident, F.lit("("), w1, F.lit(", "), w2, F.lit("):\n"),
        F.lit('    """'), doc, F.lit('"""\n'), again, F.col("_notes"),
        F.lit("    "), w3, F.lit(" = len("), w1, F.lit(") + "), w2, F.lit("  # total\n"),
        F.lit("    return "), w3, F.lit("\n"))
    return staged.select(*keep, F.col("_key").alias(out_key), code.alias("code"), doc.alias("docstring"),
                       w1.alias("w1"), w2.alias("w2"), w3.alias("w3"))


_WSC = T.WS


def sql_synth_code(src: str = "documents", key: str = "doc_id", text: str = "text",
                   name: str | None = None, out_key: str = "code_id", extra: str = "") -> str:
    """SQL twin of :func:`synth_code` as a parenthesised subquery."""
    ident = name or f"CAST({key} AS VARCHAR)"
    q3 = "repeat(chr(34), 3)"
    return (
        f"(SELECT {out_key}, {extra}"
        f" 'def f_' || ident || '(' || w1 || ', ' || w2 || '):' || chr(10)"
        f" || '    ' || {q3} || doc || {q3} || chr(10)"
        f" || CASE WHEN ('0x' || substr(md5(ident), 1, 8))::BIGINT % {LEAK_EVERY} = 0"
        f" THEN '    # ' || doc || chr(10) ELSE '' END || notes"
        f" || '    ' || w3 || ' = len(' || w1 || ') + ' || w2 || '  # total' || chr(10)"
        f" || '    return ' || w3 || chr(10) AS code, doc AS docstring, notes, w1, w2, w3"
        f" FROM (SELECT *, coalesce(toks[1], 'x') AS w1, coalesce(toks[2], 'x') AS w2,"
        f" coalesce(toks[3], 'x') AS w3,"
        f" replace(replace(replace(CASE WHEN fs = '' THEN regexp_replace({text}, '^{_WSC}+|{_WSC}+$', '', 'g')"
        f" ELSE fs END, chr(92), ''), chr(34), chr(39)), chr(10), ' ') AS doc"
        f" FROM (SELECT *, {key} AS {out_key}, {ident} AS ident,"
        f" regexp_extract_all(lower({text}), '[a-z0-9]+') AS toks,"
        f" array_to_string(list_transform(list_filter(list_transform(string_split({text}, chr(10)),"
        f" lambda x: array_to_string(regexp_extract_all(lower(x), '{T.WORD}'), ' ')), lambda x: x <> ''),"
        f" lambda x: '    assert ' || chr(39) || x || chr(39) || chr(10)), '') AS notes,"
        f" regexp_extract({text}, '(?s)^{_WSC}*(.*?[.!?])(?:{_WSC}|$)', 1) AS fs"
        f" FROM {src}) s0) s1)")


SQL_SYNTH_CODE = sql_synth_code()
