"""Answer scoring: input cleaning and embedding greedy-match P/R/F1.

Greedy matching (the metric of the original evaluation): with unit token
vectors, precision is the mean over prediction tokens of the best cosine to
any reference token, recall the same the other way, F1 their harmonic mean.
An example with no known tokens on a side scores 0.

Plan: prediction and reference lie in one row, so each is turned into vector
ids where it lies, and nothing of an example is shuffled.  A token's id is
its hash modulo the largest vector id plus one, so every vector can be met.
The vectors are measured first.  Up to ``MATRIX_BYTES`` they are broadcast
once as one matrix, and a numpy kernel takes each example's maxima tile by
tile over its distinct ids and their counts, so its memory is that of a tile
however long the texts.  Beyond that, ids are counted by (example, side,
id), joined to their vectors one by one, and the maxima are partial
aggregates of a join of the two sides by example: no array of vectors is
gathered in any row.  Both give the same scores.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing as H
from ..functions import text as TX
from ..functions import tokens as K
from ..session import persisted, ship_package


def clean_reference(col) -> Column:
    """Reference answer: strip, then drop double quotes."""
    return F.replace(TX.strip_ws(col), F.lit('"'), F.lit(""))


def first_prediction(answers) -> Column:
    """First generated sample, stripped (NULL when none)."""
    return TX.strip_ws(F.get(F.col(answers) if isinstance(answers, str) else answers, 0))


def clean_answers(df: DataFrame, answer: str = "answer", generated: str = "generated_answer") -> DataFrame:
    """Add ``reference``, ``prediction`` and ``is_error`` (no generated sample)."""
    gen = F.col(generated)
    return (df.withColumn("reference", clean_reference(answer))
              .withColumn("prediction", first_prediction(generated))
              .withColumn("is_error", F.coalesce(F.size(gen) == 0, F.lit(False))))


MATRIX_BYTES = 64 << 20  # vectors up to this size are broadcast
TILE = 1024              # ids of one side that are compared at once


def token_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Vector table normalised once to unit length: (vec_id, v array<double>).

    NULL ids and vectors, and vectors that are zero or hold NULL or
    non-finite components, are left out; a repeated id counts with the least
    of its vectors.
    """
    finite = lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))
    known = vectors.filter(F.col(id_col).isNotNull() & F.forall(vec_col, finite) & F.exists(vec_col, lambda x: x != 0))
    one = known.groupBy(F.col(id_col).alias("vec_id")).agg(F.min(vec_col).alias("_e"))
    return one.select("vec_id", K.unit_vector("_e").alias("v"))


def vocabulary_size(vectors: DataFrame, id_col: str = "vec_id") -> int:
    """Largest vector id plus one (1 for an empty table)."""
    most = vectors.agg(F.max(id_col)).first()[0]
    return 1 if most is None else int(most) + 1


def greedy_scores(pv, rv) -> tuple[Column, Column, Column]:
    """(precision, recall, f1) from two arrays of unit vectors in one row."""
    def best(xs, ys):
        per = F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: K.dot(x, y))))
        return F.when((F.size(xs) > 0) & (F.size(ys) > 0),
                      F.try_divide(K.array_sum(per), F.size(xs).cast("double"))).otherwise(F.lit(0.0))
    p = best(pv, rv)
    r = best(rv, pv)
    f = F.when(p + r > 0, F.try_divide(2 * p * r, p + r)).otherwise(F.lit(0.0))
    return p, r, f


SCORE_STRUCT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("precision", "recall", "f1")])


def _greedy_np(a, b) -> tuple[float, float, float]:
    """P, R, F1 of two lists of unit vectors."""
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0.0, 0.0, 0.0
    x, y = np.stack(list(a)), np.stack(list(b))
    of_a, of_b = _best(np.concatenate((x, y)), np.arange(len(x)), np.arange(len(x), len(x) + len(y)))
    p, r = float(of_a.mean()), float(of_b.mean())
    return p, r, _f1(p, r)


@F.pandas_udf(SCORE_STRUCT)
def greedy_scores_np(pv: pd.Series, rv: pd.Series) -> pd.DataFrame:
    """Greedy match of the token vectors of each row."""
    return pd.DataFrame([_greedy_np(*x) for x in zip(pv, rv)], columns=["precision", "recall", "f1"])


def _best(m: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``m`` named by ``a`` its greatest product with one named by ``b``, and the other way round."""
    of_a, of_b = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
    for i in range(0, len(a), TILE):
        x = m[a[i:i + TILE]]
        for j in range(0, len(b), TILE):
            sim = x @ m[b[j:j + TILE]].T
            np.maximum(of_a[i:i + TILE], sim.max(axis=1), out=of_a[i:i + TILE])
            np.maximum(of_b[j:j + TILE], sim.max(axis=0), out=of_b[j:j + TILE])
    return of_a, of_b


def _f1(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def _matrix(unit: DataFrame, most: int):
    """(ids ascending, matrix) of a vector table of at most ``most`` bytes, else None."""
    size = unit.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if not size["n"]:
        return np.empty(0, np.int64), np.empty((0, 1))
    if size["lo"] != size["hi"] or size["n"] * (size["hi"] + 1) * 8 > most:
        return None
    t = unit.select(F.col("vec_id").cast("long").alias("vec_id"), "v").toArrow().combine_chunks()
    ids = t.column("vec_id").to_numpy()
    m = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), size["hi"])
    order = np.argsort(ids)
    return ids[order], m[order]


def _match_by_matrix(examples: DataFrame, keys: list[str], known) -> DataFrame:
    shared = examples.sparkSession.sparkContext.broadcast(known)

    def side(ids, found):
        """Rows of the matrix for the distinct ids of a side, and how often each occurs."""
        if ids is None or not len(ids) or not len(found):
            return np.empty(0, np.int64), None
        u, n = np.unique(np.asarray(ids, dtype=np.int64), return_counts=True)
        at = np.minimum(np.searchsorted(found, u), len(found) - 1)
        hit = found[at] == u
        return at[hit], n[hit]

    @F.pandas_udf(SCORE_STRUCT)
    def scores(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        found, m = shared.value
        out = []
        for x, y in zip(p, r):
            (a, na), (b, nb) = side(x, found), side(y, found)
            if not len(a) or not len(b):
                out.append((0.0, 0.0, 0.0))
                continue
            of_a, of_b = _best(m, a, b)
            prec, rec = float(np.average(of_a, weights=na)), float(np.average(of_b, weights=nb))
            out.append((prec, rec, _f1(prec, rec)))
        return pd.DataFrame(out, columns=["precision", "recall", "f1"])

    return examples.withColumn("_s", scores("_p", "_r")).select(*keys, "_s.precision", "_s.recall", "_s.f1")


def _match_by_join(examples: DataFrame, keys: list[str], unit: DataFrame) -> DataFrame:
    rows = persisted(examples.withColumn("_x", F.monotonically_increasing_id()), "examples")

    def side(ids: str) -> DataFrame:
        n = rows.select("_x", F.explode(ids).alias("vec_id")).groupBy("_x", "vec_id").agg(F.count(F.lit(1)).alias("_n"))
        return n.join(unit, "vec_id")

    def mean_best(own: DataFrame, other: DataFrame, name: str) -> DataFrame:
        pairs = own.join(other.select("_x", F.col("v").alias("_w")), "_x")
        best = pairs.groupBy("_x", "vec_id", "_n").agg(F.max(K.dot("v", "_w")).alias("_b"))
        return best.groupBy("_x").agg((F.sum(F.col("_b") * F.col("_n")) / F.sum("_n")).alias(name))

    p, r = side("_p"), side("_r")
    out = rows.join(mean_best(p, r, "precision"), "_x", "left").join(mean_best(r, p, "recall"), "_x", "left")
    prec, rec = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    f1 = F.when(prec + rec > 0, F.try_divide(2 * prec * rec, prec + rec)).otherwise(F.lit(0.0))
    return out.select(*keys, prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def greedy_match(df: DataFrame, keys: Sequence[str], pred: str, ref: str, vectors: DataFrame,
                 buckets: int | None = None, tokenizer: Callable[[Column], Column] = TX.word_tokens,
                 matrix_bytes: int = MATRIX_BYTES) -> DataFrame:
    """Per example (one row of ``df``): keys + precision, recall, f1 (doubles).

    ``buckets`` fixes the token-to-id modulus (default: from the vector
    table).  An example without known tokens on a side scores 0.
    """
    keys = list(keys)
    ship_package(df.sparkSession)
    size = buckets or vocabulary_size(vectors)
    ids = lambda col: F.coalesce(F.transform(tokenizer(F.col(col)), lambda t: H.md5_bucket(t, size)),
                                 F.array().cast("array<bigint>"))
    examples = df.select(*keys, ids(pred).alias("_p"), ids(ref).alias("_r"))
    unit = token_vectors(vectors)
    known = _matrix(unit, matrix_bytes)
    return _match_by_join(examples, keys, unit) if known is None else _match_by_matrix(examples, keys, known)


def rescale(col, baseline) -> Column:
    """Baseline rescaling (x - b) / (1 - b)."""
    b = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
    c = F.col(col) if isinstance(col, str) else col
    return F.try_divide(c - b, F.lit(1.0) - b)


def rescale_by_encoder(scores: DataFrame, baselines: Sequence[tuple[str, float, float, float]]) -> DataFrame:
    """Each score row once for each encoder, P, R and F1 rescaled by that encoder's baselines.

    ``baselines`` is (encoder, precision, recall, f1): a short literal table, exploded in place.
    """
    rows = F.array(*[F.struct(F.lit(e).alias("encoder"), F.lit(p).alias("p"), F.lit(r).alias("r"), F.lit(f).alias("f"))
                     for e, p, r, f in baselines])
    out = scores.withColumn("_b", F.explode(rows)).withColumn("encoder", F.col("_b.encoder"))
    for name, b in (("precision", "p"), ("recall", "r"), ("f1", "f")):
        out = out.withColumn(name, rescale(name, F.col(f"_b.{b}")))
    return out.drop("_b")


# --- user-supplied encoder --------------------------------------------------

VEC_LIST = T.ArrayType(T.ArrayType(T.DoubleType()))


def encoder_udf(encode: Callable[[list[str]], list[list[list[float]]]]):
    """Wrap ``encode(texts) -> per-text token vectors`` as an Arrow-batched UDF.

    The encoder is built by the caller (once per Python worker) and sees a
    whole Arrow batch of texts, which is its batch size.
    """
    @F.pandas_udf(VEC_LIST)
    def _encode(texts: pd.Series) -> pd.Series:
        out = encode(texts.fillna("").tolist())
        return pd.Series([[[float(x) for x in v] for v in seq] for seq in out])
    return _encode


def greedy_match_encoded(df: DataFrame, keys: Sequence[str], pred: str, ref: str, encode_udf) -> DataFrame:
    """Greedy match with a contextual encoder producing token vectors per text."""
    ship_package(df.sparkSession)
    sc = greedy_scores_np(F.transform(encode_udf(F.col(pred)), K.unit_vector),
                          F.transform(encode_udf(F.col(ref)), K.unit_vector))
    return df.select(*keys, sc.alias("_s")).select(*keys, "_s.precision", "_s.recall", "_s.f1")


def score_samples(df: DataFrame, keys: Sequence[str], samples: str, ref: str, vectors: DataFrame,
                  mode: str = "first", **kw) -> DataFrame:
    """Score generated samples against the cleaned reference, per example.

    ``first`` scores sample 0 only (the original evaluation); ``best`` keeps
    the sample with the highest F1 and ``mean`` averages P/R/F1 over the
    samples.  An example holds at most n samples, so the per-example
    aggregate is bounded.  Examples without samples get no row.
    """
    keys = list(keys)
    if mode not in ("first", "best", "mean"):
        raise ValueError("mode must be first, best or mean")
    base = df.select(*keys, F.col(samples).alias("_s"), clean_reference(ref).alias("reference"))
    if mode == "first":
        one = base.filter(F.size("_s") > 0).select(*keys, first_prediction("_s").alias("prediction"), "reference")
        return greedy_match(one, keys, "prediction", "reference", vectors, **kw)
    many = base.select(*keys, F.posexplode("_s").alias("sample_no", "_p"), "reference")
    many = many.select(*keys, "sample_no", TX.strip_ws("_p").alias("prediction"), "reference")
    scored = greedy_match(many, keys + ["sample_no"], "prediction", "reference", vectors, **kw)
    if mode == "mean":
        return scored.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    best = F.max_by(F.struct("precision", "recall", "f1"), F.struct("f1", (-F.col("sample_no")).alias("_o")))
    return scored.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.precision", "_b.recall", "_b.f1")
