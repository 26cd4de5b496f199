"""Token-score arithmetic over array columns (per-row higher-order functions).

A sequence's scores live in one row (bounded by the generation length), so
these never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def array_sum(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0).cast("double"), lambda a, x: a + x)


def with_scalar(arr, scalar, fn) -> Column:
    """transform(arr, x -> fn(x, scalar)) with ``scalar`` evaluated once.

    An outer expression referenced inside a lambda is re-evaluated for every
    element (no hoisting), which turns an O(n) array pass into O(n^2) or
    worse.  Zipping the array with one evaluated copy per element keeps it
    linear.
    """
    a = _c(arr)
    z = F.arrays_zip(a.alias("x"), F.array_repeat(scalar, F.size(a)).alias("c"))
    return F.transform(z, lambda t: fn(t["x"], t["c"]))


def fold_with_scalar(arr, scalar, zero, fn) -> Column:
    """aggregate(arr, zero, (acc, x) -> fn(acc, x, scalar)), scalar evaluated once."""
    a = _c(arr)
    z = F.arrays_zip(a.alias("x"), F.array_repeat(scalar, F.size(a)).alias("c"))
    return F.aggregate(z, zero, lambda acc, t: fn(acc, t["x"], t["c"]))


def log_softmax(arr) -> Column:
    """x - max - ln(sum(exp(x - max))) element-wise, in double."""
    a = F.transform(_c(arr), lambda x: x.cast("double"))
    m = F.array_max(a)
    s = fold_with_scalar(a, m, F.lit(0.0).cast("double"), lambda acc, x, mx: acc + F.exp(x - mx))
    return with_scalar(a, m + F.log(s), lambda x, lse: x - lse)


def ranked(arr) -> Column:
    """All (score, idx) structs, score descending, ties by lower index."""
    tagged = F.transform(_c(arr), lambda x, i: F.struct((-x.cast("double")).alias("neg"),
                                                         i.alias("idx"),
                                                         x.cast("double").alias("score")))
    return F.transform(F.sort_array(tagged), lambda s: F.struct(s["score"].alias("score"), s["idx"].alias("idx")))


def top_k(arr, k: int) -> Column:
    """The first k of :func:`ranked`."""
    return F.slice(ranked(arr), 1, k)


def eos_trim(tokens, eos) -> Column:
    """Tokens up to and including the first end token (all when absent)."""
    t = _c(tokens)
    p = F.array_position(t, eos if isinstance(eos, Column) else F.lit(eos))
    return F.when(p == 0, t).otherwise(F.slice(t, 1, p.cast("int")))


def token_score(tok) -> Column:
    """Score of the chosen token: top_scores[token]."""
    return F.try_element_at(tok["top_scores"], tok["token"])


def sequence_logprob(tokens) -> Column:
    """Sum of chosen-token scores of a sequence (array<struct<token, top_scores>>)."""
    return array_sum(F.transform(_c(tokens), token_score))


def score_diff(a, b) -> Column:
    """Difference of two scores, each a token or a number."""
    left, right = (F.lit(float(x)) if isinstance(x, (int, float)) else token_score(_c(x)) for x in (a, b))
    return left - right


def sequence_text(tokens) -> Column:
    """Concatenated token strings of a sequence."""
    return F.array_join(F.transform(_c(tokens), lambda t: t["token"]), "")


def with_chosen(top_scores, token, score) -> Column:
    """Top-score map with the chosen token's own score set (last write wins)."""
    tok = _c(token)
    kept = F.map_filter(_c(top_scores), lambda k, v: k != tok)
    return F.map_concat(kept, F.create_map(tok, _c(score)))


def missing_prompt_score(top_scores, token) -> Column:
    """A missing first prompt score becomes {token: 0.0}."""
    return F.coalesce(_c(top_scores), F.create_map(_c(token), F.lit(0.0).cast("double")))


def split_texts(texts, n_examples) -> Column:
    """Split a flat example-major list into n_examples slices of len // n_examples."""
    t = _c(texts)
    b = n_examples if isinstance(n_examples, Column) else F.lit(n_examples)
    n = F.floor(F.size(t) / b).cast("int")
    return F.transform(F.sequence(F.lit(0), (b - 1).cast("int")), lambda i: F.slice(t, i * n + 1, n))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x)


def unit_vector(vec) -> Column:
    v = F.transform(_c(vec), lambda x: x.cast("double"))
    return with_scalar(v, F.sqrt(dot(v, v)), lambda x, norm: x / norm)
