"""First sentences by a splitter that learns abbreviations from the texts.

A full stop after a word ends a sentence, unless the word is an
abbreviation.  Which words are is learned from all texts, without labels, by
the log-likelihood of the word and a following full stop appearing together
(the statistic that the usual unsupervised splitter is built on): a word
that nearly always has a full stop after it, is short, and holds full stops
of its own (``e.g``) is one.  Counts are aggregates over all documents; the
learned words are those with a score above ``MIN_SCORE`` and at least
``MIN_SEEN`` appearances, joined back by word, so a large set of them needs
no driver.

Every white-space token that ends in a full stop, question or exclamation
mark (and closing marks) is a possible end; its *type* is the word in lower
case without marks.  A text is cut after its first possible end that is no
full stop after a learned abbreviation.

Defined results: a NULL text has a NULL sentence; a text without an end is
its own first sentence, tokens joined by one space; an empty text is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import persisted

MIN_SEEN = 5
MIN_SCORE = 0.3  # FIXED VALUE: score above which a type counts as an abbreviation
MAX_TYPE = 12    # longer words are never abbreviations


def tokens(text: Column) -> Column:
    """White-space tokens, from ASCII white space."""
    return F.filter(F.split(text, "[\\x09-\\x0D\\x20]+"), lambda w: w != "")


def word_type(token: Column) -> Column:
    """The token in lower case without marks around it and without its last full stop."""
    return F.regexp_replace(F.lower(token), "^[(\\[\"']+|[)\\]\"',;:!?]*\\.?$", "")


def abbreviations(docs: DataFrame, text: str = "text", min_seen: int = MIN_SEEN, min_score: float = MIN_SCORE) -> DataFrame:
    """(type, n_stop, n, score): the types learned as abbreviations from all texts.

    With N tokens, of which C end in a full stop, and a type seen n times,
    c times with a stop: the log-likelihood ratio of "c of n" under the
    type's own rate c / n against the common rate C / N, times a factor for
    the type's own full stops, times exp(-length), times a penalty
    n ** -(appearances without a stop).
    """
    # equal tokens are counted first: a type is made once for each distinct token of a task, and the
    # counts of the types are written, as the common rate and the scores both read them
    t = docs.select(F.explode(tokens(F.col(text))).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    t = t.select(word_type(F.col("tok")).alias("type"), F.when(F.col("tok").endswith("."), F.col("n")).otherwise(0).alias("c"), "n")
    seen = persisted(t.groupBy("type").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "types")
    total = seen.agg(F.sum("n").cast("double"), F.sum("c").cast("double")).first()
    common = F.lit(total[1] / total[0] if total[0] else 0.0)
    s = seen.filter((F.col("n") >= min_seen) & (F.col("c") > 0) & F.length("type").between(1, MAX_TYPE)
                    & F.col("type").rlike("^[\\p{L}.]+$"))
    n, c = F.col("n").cast("double"), F.col("c").cast("double")
    own = F.least(c / n, F.lit(0.99))

    def likelihood(p: Column) -> Column:
        return c * F.log(p) + (n - c) * F.log(1 - p)

    ratio = -2 * (likelihood(common) - likelihood(own))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - inner
    penalty = F.pow(n, -(n - c))
    score = ratio * (inner + 1) * F.exp(-letters.cast("double")) * penalty
    # a type without a stop more often than the common rate is no abbreviation
    score = F.when(c / n <= common, F.lit(0.0)).otherwise(score)
    return (s.withColumn("score", score).filter(F.col("score") >= min_score)
             .select("type", F.col("c").cast("long").alias("n_stop"), F.col("n").cast("long").alias("n"), "score"))


def first_sentences(docs: DataFrame, learned: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence): each text up to its first end, with its tokens joined by one space."""
    rows = docs.select(F.col(key).alias("_key"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_dg"), F.col(text).alias("_text"))
    ends = F.filter(F.transform(tokens(F.col("_text")), lambda w, i: F.struct(i.alias("i"), w.alias("w"))),
                    lambda x: x.w.rlike("[.!?][)\\]\"']*$"))
    # a text's possible ends leave its row one by one; only a full stop after a learned type is no end
    each = rows.select("_key", "_dg", F.explode(ends).alias("e")).select(
        "_key", "_dg", "e.i", word_type(F.col("e.w")).alias("_type"), F.col("e.w").endswith(".").alias("_stop"))
    known = learned.select(F.col("type").alias("_type"), F.lit(True).alias("_abbr"))
    real = each.join(known, "_type", "left").filter(~(F.col("_stop") & F.coalesce("_abbr", F.lit(False))))
    first = real.groupBy(F.col("_key").alias("_k"), F.col("_dg").alias("_d")).agg(F.min("i").alias("_end"))
    out = rows.join(first, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_dg") == F.col("_d")), "left")
    out = out.withColumn("_tok", tokens(F.col("_text")))  # split again: the join carries the text alone
    upto = F.coalesce(F.col("_end") + 1, F.size("_tok"))
    sentence = F.array_join(F.slice("_tok", F.lit(1), upto), " ")
    return out.select(F.col("_key").alias(key), F.when(F.col("_text").isNotNull(), sentence).alias("sentence"))
