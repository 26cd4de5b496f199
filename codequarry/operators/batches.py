"""Batching by key or by length: batch numbers, split/merge of flat example-major
outputs, positional alignment of completions to prompts.

Batch numbers are dense over the whole table and follow the key order; the
rows are numbered in ranges (:mod:`.ordinals`), not by one ``row_number`` in
a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import Ordered, numbered


def assign_batches(df: DataFrame, keys: Sequence[str], batch_size: int) -> DataFrame:
    """Add ``batch_no``: 0, 1, 2, ... with ``batch_size`` records each in key order, the last one smaller.

    NULL keys come first; which of several rows with one key comes first is open.
    """
    out = numbered(df, [F.col(f"`{k}`") for k in keys], ordinal="batch_no")
    return out.withColumn("batch_no", F.floor(F.col("batch_no") / batch_size).cast("bigint"))


def length_bound(length: Column) -> Column:
    """The upper end of a length's class: lengths with equal first three bits, rounded up.

    A class with bound b >= 8 holds lengths above 4/5 b only; up to 8 each length is its own class.
    """
    n = F.greatest(F.coalesce(length.cast("bigint"), F.lit(0).cast("bigint")), F.lit(1).cast("bigint"))
    step = F.greatest(F.pow(F.lit(2), F.length(F.bin(n)) - 3).cast("bigint"), F.lit(1).cast("bigint"))
    return n + F.pmod(-n, step)


def length_batches(df: DataFrame, length: str, keys: Sequence[str], budget: int) -> DataFrame:
    """Add ``batch_no``: batches of similar lengths that hold ``budget`` tokens at most when padded.

    Records are put in order of (length class, length, keys) and each class is
    cut into batches of ``budget // bound`` records, so a batch padded to its
    longest record stays within the budget and less than a fifth of it is
    padding.  A record longer than the budget is a batch of its own; a NULL
    length counts as 0.  Numbers are dense and ascend with the length.  Each
    record is in one batch; which of several records with one length and key
    comes first is open.  An empty table gives an empty table.

    A class is numbered in ranges, so a third of all records may have one
    length; the table of classes has four rows for each doubling of the length.
    """
    n = F.col(f"`{length}`")
    placed = Ordered(df, [F.coalesce(n, F.lit(0)), *[F.col(f"`{k}`") for k in keys]], [length_bound(n)])
    rows = placed.numbers("_ordinal")
    per = F.greatest(F.floor(F.lit(budget) / F.col("_bound")), F.lit(1)).cast("bigint")
    classes = placed.placed.groupBy(F.col(placed.groups[0]).alias("_bound")).agg(F.count(F.lit(1)).alias("_rows"))
    classes = classes.select("_bound", per.alias("_per"), F.ceil(F.col("_rows") / per).alias("_batches"))
    before = Window.orderBy("_bound").rowsBetween(Window.unboundedPreceding, -1)  # at most 4 * 63 rows
    classes = classes.select("_bound", "_per", F.coalesce(F.sum("_batches").over(before), F.lit(0)).alias("_start"))
    out = rows.withColumn("_bound", length_bound(n)).join(F.broadcast(classes), "_bound")
    number = F.col("_start") + F.floor(F.col("_ordinal") / F.col("_per"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], number.cast("bigint").alias("batch_no"))


def batch_waste(batched: DataFrame, length: str) -> DataFrame:
    """(batch_no, n_records, max_tokens, padded_tokens, waste_tokens) of batches padded to their longest record."""
    n = F.coalesce(F.col(f"`{length}`"), F.lit(0)).cast("bigint")
    each = batched.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_records"), F.max(n).alias("max_tokens"),
                                           F.sum(n).alias("_tokens"))
    padded = F.col("n_records") * F.col("max_tokens")
    return each.select("batch_no", "n_records", "max_tokens", padded.alias("padded_tokens"),
                       (padded - F.col("_tokens")).alias("waste_tokens"))


def split_flat(flat: DataFrame, n_examples: int) -> DataFrame:
    """Flat outputs (batch_id, pos, ...) -> example_no / sample_no.

    n = len // n_examples per batch (a partial count), slice i is positions
    [i*n, (i+1)*n); positions past n_examples*n are dropped, as list slicing
    does.
    """
    per = flat.groupBy("batch_id").agg(F.floor(F.count(F.lit(1)) / n_examples).cast("bigint").alias("per"))
    j = flat.join(per, "batch_id").filter((F.col("per") > 0) & (F.col("pos") < F.col("per") * n_examples))
    safe = F.when(F.col("per") > 0, F.col("per"))
    return (j.withColumn("example_no", F.floor(F.col("pos") / safe).cast("bigint"))
             .withColumn("sample_no", F.pmod(F.col("pos"), safe).cast("bigint"))
             .drop("per"))


def merge_outputs(parts: DataFrame, lists: Sequence[str] = ("texts",)) -> DataFrame:
    """(batch_id, example_no, lists) -> (batch_id, lists), each concatenated in example order:
    texts, and score lists beside them.

    One batch holds at most batch_size examples, so the gathered list is
    bounded by the batch size.
    """
    g = parts.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("example_no", *lists))).alias("_p"))
    return g.select("batch_id", *[F.flatten(F.col(f"_p.{c}")).alias(c) for c in lists])


def align_completions(flat: DataFrame, n_samples: int) -> DataFrame:
    """Flat completions (batch_id, pos, completion): prompt i owns positions [i*n, (i+1)*n)."""
    return flat.select("batch_id", F.floor(F.col("pos") / n_samples).cast("bigint").alias("prompt_no"),
                       F.pmod(F.col("pos"), F.lit(n_samples)).cast("bigint").alias("sample_no"), "completion")
