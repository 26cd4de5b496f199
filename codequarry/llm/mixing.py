"""Mixing sources to target weights (DataFrame functions only).

Every document gets a hash-random key.  Within a source the documents are
range-sorted by it: the key's first 32 bits choose one of the source's
ranges, whose number follows the source's rows (``RANGE_ROWS`` each, at
least ``MIN_RANGES``), so a range stays small where one source holds a third
of all rows.  Token counts are summed by (source, range), prefix sums of
those sums find the one range on which the source's budget ends, and a
window over that range's distinct keys finds the key.  So each source is cut
at its exact budget: whole epochs first, then the documents before the cut
key, then the first words of the one document on it.  Sizes and keys alone
are written and shuffled; texts are read twice and never moved.

Targets: sources in code-point order (NULL last) weigh 5, 2, 1, repeating,
and share the corpus size; no target exceeds ``MAX_EPOCHS`` times its
source, and the excess is shared again by weight.  With sources sorted by
size over weight the capped ones are a prefix, so prefix sums over the
source table (one row for each source) settle it without iteration.

Defined results: a NULL text has size 0; NULL is a source of its own; a
source of size 0 has target 0; rows that repeat are rows of their own, and
where they lie on the cut they are numbered across ranges of their own.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordinals import numbered
from .common import WS, staged

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
MIN_RANGES = 4096  # ranges in a source, at least
RANGE_ROWS = 4096  # rows in a range of a larger source, on average


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")


def mix_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """32 hex digits, random by hash; equal for rows that repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"),
                          F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def targets(by_source: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(no_source, src, source_size) -> with target and budget; one row for each source."""
    unit, big = lcm(*weights), "decimal(38,0)"
    ws = F.array(*[F.lit(w) for w in weights])
    everything = Window.partitionBy()
    ranked = by_source.withColumn("k", F.row_number().over(everything.orderBy("no_source", "src")) - 1)
    ranked = ranked.withColumn("w", F.get(ws, F.pmod("k", F.lit(len(weights)))))
    ranked = ranked.withColumn("per_weight", F.col("source_size") * F.lit(unit).cast(big) / F.col("w"))
    by_ratio = everything.orderBy("per_weight", "k")
    s = F.col("source_size").cast(big)
    ranked = (ranked.withColumn("total", F.sum(s).over(everything))
                    .withColumn("before", F.coalesce(F.sum(s).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)),
                                                     F.lit(0).cast(big)))
                    .withColumn("w_left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))))
    capped = max_epochs * s * F.col("w_left") <= F.col("w") * (F.col("total") - max_epochs * F.col("before"))
    ranked = ranked.withColumn("capped", capped)
    ranked = (ranked.withColumn("c", F.sum(F.when(F.col("capped"), max_epochs * s).otherwise(F.lit(0).cast(big)))
                                .over(everything))
                    .withColumn("w_free", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(everything)))
    share = (F.col("w") * (F.col("total") - F.col("c"))).cast("double") / F.col("w_free").cast("double")
    target = F.when(F.col("capped"), (max_epochs * F.col("source_size")).cast("double")).otherwise(share)
    return (ranked.withColumn("target", target).withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
                  .select("no_source", "src", "source_size", "target", "budget"))


def key_range(key: Column, n_ranges: Column) -> Column:
    """The range of a key, 0 to n_ranges - 1, in the order of the keys."""
    return F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * n_ranges, 32)


def cuts(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """One row for each source of ``sizes`` (no_source, src, size, key): its target and where its budget ends.

    Rows with a key below ``cut_key`` are taken once more than ``epochs`` times.  ``left`` words are for the
    ``copies`` rows that have the cut key, fewer than these hold.  A source of size 0 has no cut key.
    """
    source = ["no_source", "src"]
    n = F.greatest(F.lit(MIN_RANGES), F.ceil(F.count("*") / RANGE_ROWS)).cast("long")
    n_ranges = staged(spark, sizes.groupBy(*source).agg(n.alias("n_ranges")), "mix-sources")
    dealt = sizes.join(n_ranges, source).withColumn("range", key_range(F.col("key"), F.col("n_ranges")))
    ranges = staged(spark, dealt.groupBy(*source, "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    by_source = ranges.groupBy(*source).agg(F.sum("range_size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    goal = targets(by_source).withColumn("epochs", whole.cast("long"))
    goal = staged(spark, goal.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")),
                  "mix-targets")
    prior = Window.partitionBy(*source).rowsBetween(Window.unboundedPreceding, -1)

    def on_cut(parts: DataFrame, order: str, size: str, rest: str) -> DataFrame:
        """The part of each source on which its rest ends, with the words left for it."""
        before = F.coalesce(F.sum(size).over(prior.orderBy(order)), F.lit(0))
        found = parts.withColumn("left", F.col(rest) - before)
        return found.filter(f"`left` >= 0 AND `left` < `{size}`")

    cut_range = on_cut(ranges.join(goal.select(*source, "rest"), source), "range", "range_size", "rest")
    cut_range = staged(spark, cut_range.select(*source, "range", F.col("left").alias("range_left")), "mix-cut-ranges")
    keys = (dealt.join(cut_range, [*source, "range"]).groupBy(*source, "range_left", "key")
                 .agg(F.sum("size").alias("key_size"), F.count("*").alias("copies")))
    cut_key = on_cut(keys, "key", "key_size", "range_left")
    cut_key = cut_key.select(*source, F.col("key").alias("cut_key"), "copies", "left")
    return staged(spark, goal.join(cut_key, source, "left"), "mix-cuts")


def mixed(spark: SparkSession, docs: DataFrame, payload: dict[str, Column], seed: str = SEED) -> DataFrame:
    """Each row of ``docs`` as its ``payload`` columns with size, source_size, target, taken, epochs, extra.

    ``taken = epochs * size + extra``; 0 < extra < size only on the one
    document where its source's budget ends.
    """
    base = docs.select(*[c.alias(n) for n, c in payload.items()], F.col("source").isNull().alias("no_source"),
                       F.coalesce("source", F.lit("")).alias("src"), word_count(F.col("text")).alias("size"),
                       mix_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    cut = cuts(spark, staged(spark, base.select("no_source", "src", "size", "key"), "mix-sizes"))
    rows = base.join(cut, ["no_source", "src"])
    single = rows.withColumn("number", F.lit(0).cast("long"))
    if not cut.filter("copies > 1").isEmpty():
        repeated = F.coalesce((F.col("copies") > 1) & (F.col("key") == F.col("cut_key")), F.lit(False))
        again = numbered(rows.filter(repeated), [F.col("key")], [F.col("no_source"), F.col("src")], "number")
        single = single.filter(~repeated).unionByName(again)
    rows = single
    at = F.least("size", F.greatest(F.lit(0).cast("long"), F.col("left") - F.col("number") * F.col("size")))
    extra = (F.when(F.col("key") < F.col("cut_key"), F.col("size"))
              .when(F.col("key") == F.col("cut_key"), at).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("extra", extra)
    return rows.select(*payload, "size", "source_size", "target",
                       (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"), "epochs", "extra")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it was."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{WS}]*[^{WS}]+"), F.lit(0)), F.lit(1),
                                n.cast("int")), "")


def mix(spark: SparkSession, docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it
    is taken; the one on the cut has its text (and n_chars) shortened."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    m = mixed(spark, docs, {"_row": row}, seed)
    copies = (F.col("epochs") + F.when((F.col("extra") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0))
    copies = copies.cast("int")
    cut = (F.col("extra") > 0) & (F.col("extra") < F.col("size"))
    parts = F.concat(F.transform(F.sequence(F.lit(0), copies), lambda i: i),
                     F.when(cut, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))
    out = m.select("_row", "extra", F.explode(parts).alias("part")).filter("part <> 0")
    text = F.when(F.col("part") > 0, F.col("_row.text")).otherwise(first_words(F.col("_row.text"), F.col("extra")))
    out = out.select("_row", text.alias("_text"))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("_text").alias("text"))
        elif c == "n_chars":
            whole = F.col("_text").eqNullSafe(F.col("_row.text"))
            cols.append(F.when(whole, F.col("_row.n_chars"))
                         .otherwise(F.length("_text").cast(docs.schema[c].dataType)).alias(c))
        else:
            cols.append(F.col("_row").getField(c).alias(c))
    return out.select(*cols)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(spark, docs, {"doc_id": F.col("doc_id")}).select(
        "doc_id", "size", "source_size", "target", "taken")


def mix_sql(docs: str = "documents") -> str:
    """SQL of the mix over a table of documents: every row with size, target, epochs, extra."""
    return f"""
SELECT d.*, t.source_size, t.target,
       CASE WHEN t.source_size > 0 THEN t.budget // t.source_size ELSE 0 END AS epochs,
       least(d.size, greatest(0, CASE WHEN t.source_size > 0 THEN t.budget % t.source_size ELSE 0 END - d.start))
         AS extra
FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                   md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))) AS key
            FROM {docs}) d0) d
JOIN (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM (
        SELECT *, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE
                 (w * (total - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ()))::DOUBLE
                 / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::DOUBLE END AS target
        FROM (SELECT *, 3 * source_size * w_left <= w * (total - 3 * before) AS capped FROM (
                SELECT *, sum(source_size) OVER () AS total,
                       coalesce(sum(source_size) OVER (ORDER BY source_size * 10 // w, k
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                       sum(w) OVER (ORDER BY source_size * 10 // w, k
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
                FROM (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM (
                        SELECT source, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k,
                               sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')))::HUGEINT
                                 AS source_size
                        FROM {docs} GROUP BY source) s0) s1) s2) s3) s4) t
  ON d.source IS NOT DISTINCT FROM t.source"""


OP7_SQL = f"""
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (epochs * size + extra)::BIGINT AS taken
FROM ({mix_sql()}) m
"""
