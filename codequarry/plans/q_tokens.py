"""Token-score queries with ``embeddings`` rows read as logit vectors.

Each row is one decoding position: its 64 values are logits over token ids
0..63; ``id2str(i) = 't' || (i % 50)`` maps several ids to one string (the
duplicate case the score maps must handle); ``label`` is the chosen token id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..functions import tokens as K
from ..sources.tables import table
from . import sqlbits as Q
from .registry import query

TOP_K = 5
EOS = "<e>"


def id2str(i: Column) -> Column:
    return F.concat(F.lit("t"), (i % 50).cast("string"))


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", K.log_softmax("embedding").alias("lp"))


_SQL_LP = """
    SELECT a.vec_id, a.label, a.idx, a.x - m.mx - ln(m.se) AS lp
    FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS idx FROM embeddings) a
    JOIN (SELECT vec_id, mx, sum(exp(x - mx)) AS se FROM (
              SELECT vec_id, x, max(x) OVER (PARTITION BY vec_id) AS mx FROM (
                  SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) u) v GROUP BY vec_id, mx) m
      ON m.vec_id = a.vec_id"""

_SQL_RANKED = f"""
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY lp DESC, idx) AS rk FROM ({_SQL_LP}) l"""

_SQL_TOPK = f"""
    SELECT vec_id, label, idx, lp, rk FROM (
        SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY lp DESC, idx) AS rk FROM ({_SQL_LP}) l) r
    WHERE rk <= {{k}}"""


@query("log_softmax", sql=f"SELECT vec_id, idx::BIGINT AS idx, round(lp, 6) AS logprob FROM ({_SQL_LP}) l")
def log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    lg = _logits(spark, sf_dir)
    return lg.select("vec_id", F.posexplode("lp").alias("idx", "logprob")).select(
        "vec_id", F.col("idx").cast("bigint").alias("idx"), F.round("logprob", 6).alias("logprob"))


@query("topk_logprobs", sql=f"""
    SELECT vec_id, (rk - 1)::BIGINT AS rank, idx::BIGINT AS idx, round(lp, 6) AS logprob
    FROM ({_SQL_TOPK.format(k=TOP_K)}) t""")
def topk_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _logits(spark, sf_dir).select("vec_id", K.top_k("lp", TOP_K).alias("top"))
    return top.select("vec_id", F.posexplode("top").alias("rank", "t")).select(
        "vec_id", F.col("rank").cast("bigint").alias("rank"), F.col("t.idx").cast("bigint").alias("idx"),
        F.round("t.score", 6).alias("logprob"))


def _sequence_tokens(lp: Column) -> Column:
    """A generated sequence per row: all ids by score, as strings; ids divisible by 10 are end tokens."""
    return F.transform(K.ranked(lp), lambda s: F.when(s["idx"] % 10 == 0, F.lit(EOS))
                       .otherwise(id2str(s["idx"])))


@query("eos_trim", sql=f"""
    SELECT vec_id, count(*)::BIGINT AS n_kept, string_agg(tok, ' ' ORDER BY rk) AS text FROM (
        SELECT vec_id, rk, tok, min(CASE WHEN tok = '{EOS}' THEN rk END) OVER (PARTITION BY vec_id) AS first_eos FROM (
            SELECT vec_id, rk, CASE WHEN idx % 10 = 0 THEN '{EOS}' ELSE 't' || CAST(idx % 50 AS VARCHAR) END AS tok
            FROM ({_SQL_RANKED}) t) a) b
    WHERE first_eos IS NULL OR rk <= first_eos
    GROUP BY vec_id""")
def eos_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = _logits(spark, sf_dir).select("vec_id", _sequence_tokens(F.col("lp")).alias("toks"))
    kept = K.eos_trim("toks", EOS)
    return seq.select("vec_id", F.size(kept).cast("bigint").alias("n_kept"), F.array_join(kept, " ").alias("text"))


def score_maps(lg: DataFrame, k: int = TOP_K) -> DataFrame:
    """Per position: top-k token strings -> score, first string wins on duplicate
    ids, and the chosen token (``label``) always present with its own score."""
    top = F.transform(K.top_k("lp", k), lambda s: F.struct(id2str(s["idx"]).alias("k"), s["score"].alias("v")))
    empty = F.create_map().cast("map<string,double>")
    first = F.aggregate(top, empty, lambda acc, e: F.when(F.map_contains_key(acc, e["k"]), acc)
                        .otherwise(F.map_concat(acc, F.create_map(e["k"], e["v"]))))
    chosen = id2str(F.col("label"))
    chosen_score = F.get(F.col("lp"), F.col("label"))
    m = K.with_chosen(first, chosen, chosen_score)
    return lg.select("vec_id", chosen.alias("token"), K.missing_prompt_score(m, chosen).alias("top_scores"))


@query("token_score_maps", sql=f"""
    WITH t AS (SELECT vec_id, label, 't' || CAST(idx % 50 AS VARCHAR) AS tok, lp, rk FROM ({_SQL_TOPK.format(k=TOP_K)}) x),
    f AS (SELECT vec_id, label, tok, arg_min(lp, rk) AS lp FROM t GROUP BY vec_id, label, tok),
    c AS (SELECT vec_id, 't' || CAST(label % 50 AS VARCHAR) AS tok, lp FROM ({_SQL_LP}) l WHERE idx = label)
    SELECT f.vec_id, f.tok AS token, round(f.lp, 6) AS score FROM f JOIN c ON c.vec_id = f.vec_id WHERE f.tok <> c.tok
    UNION ALL
    SELECT vec_id, tok AS token, round(lp, 6) AS score FROM c""")
def token_score_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = score_maps(_logits(spark, sf_dir))
    return maps.select("vec_id", F.explode("top_scores").alias("token", "score")).select(
        "vec_id", "token", F.round("score", 6).alias("score"))


def sequences(lg: DataFrame) -> DataFrame:
    """Model-output rows: tokens array<struct<token, top_scores>>, every id of the row by score."""
    toks = F.transform(K.ranked("lp"), lambda s: F.struct(
        id2str(s["idx"]).alias("token"), F.create_map(id2str(s["idx"]), s["score"]).alias("top_scores")))
    return lg.select("vec_id", toks.alias("tokens"))


@query("seq_logprob", sql=f"""
    SELECT vec_id, round(sum(lp), 6) AS logprob, string_agg('t' || CAST(idx % 50 AS VARCHAR), '' ORDER BY rk) AS text
    FROM ({_SQL_RANKED}) t GROUP BY vec_id""")
def seq_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequences(_logits(spark, sf_dir))
    return s.select("vec_id", F.round(K.sequence_logprob("tokens"), 6).alias("logprob"),
                    K.sequence_text("tokens").alias("text"))


SCORES_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("top_scores", T.MapType(T.StringType(), T.DoubleType()))]))


@query("scores_roundtrip", sql=f"""
    SELECT vec_id, (rk - 1)::BIGINT AS pos, 't' || CAST(idx % 50 AS VARCHAR) AS token, round(lp, 6) AS score
    FROM ({_SQL_RANKED}) t""")
def scores_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token scores to JSON text and back (the dict form of model outputs): what is read back."""
    s = sequences(_logits(spark, sf_dir))
    back = s.select("vec_id", F.posexplode(F.from_json(F.to_json("tokens"), SCORES_SCHEMA)).alias("pos", "t"))
    return back.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.col("t.token").alias("token"),
                       F.round(K.token_score(F.col("t")), 6).alias("score"))


@query("score_gaps", sql=f"""
    SELECT vec_id, (rk - 1)::BIGINT AS pos, round(lp - nxt, 6) AS to_next, round(lp - 1.5, 6) AS to_number,
           round(1.5 - lp, 6) AS from_number
    FROM (SELECT *, lead(lp) OVER (PARTITION BY vec_id ORDER BY rk) AS nxt FROM ({_SQL_RANKED}) t) u
    WHERE nxt IS NOT NULL""")
def score_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score arithmetic: token minus next token, token minus number, number minus token."""
    s = sequences(_logits(spark, sf_dir))
    pairs = F.arrays_zip(F.col("tokens").alias("a"), F.slice("tokens", 2, 1 << 20).alias("b"))
    rows = s.select("vec_id", F.posexplode(F.filter(pairs, lambda z: z["b"].isNotNull())).alias("pos", "z"))
    a, b = F.col("z.a"), F.col("z.b")
    return rows.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round(K.score_diff(a, b), 6).alias("to_next"),
                       F.round(K.score_diff(a, 1.5), 6).alias("to_number"),
                       F.round(K.score_diff(1.5, a), 6).alias("from_number"))


@query("ordinal_alias", sql=f"""
    SELECT doc_id, tok AS name, '_' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS VARCHAR) AS alias
    FROM (SELECT doc_id, tok, min(pos) AS p FROM (
              SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS pos
              FROM (SELECT doc_id, {Q.tokens('text')} AS toks FROM documents) a) b
          GROUP BY doc_id, tok) c""")
def ordinal_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-seen ordinal aliases _0, _1, ... per text.

    ``array_distinct`` keeps first occurrences in order, so the whole job is
    per row: no shuffle, no window over a document.
    """
    d = table(spark, sf_dir, "documents")
    names = F.array_distinct(TX.word_tokens("text"))
    return d.select("doc_id", F.posexplode(names).alias("i", "name")).select(
        "doc_id", "name", F.concat(F.lit("_"), F.col("i").cast("string")).alias("alias"))
