"""Evaluation reports over per-example scores.

Every example is scored once; the per-cell means and the overall mean come
from one GROUPING SETS aggregate over the same frame (an Expand + partial
aggregate: map-side combine, so a hot cell never reaches one task whole).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX

LEVEL_COLS = ("primary_obfuscation", "secondary_obfuscation")


def _r6(c: Column) -> Column:
    return F.round(c, 6)


def grouped_report(scored: DataFrame, f1: str = "f1", error: str = "is_error",
                   levels: Sequence[str] = LEVEL_COLS) -> DataFrame:
    """Mean F1, totals and error counts per level cell plus the overall row.

    ``scope`` is 'cell' or 'overall' (from grouping_id), so a level value
    named 'overall' cannot collide with the grand total.  Errors (no
    generated sample) count in ``n_total`` but are not scored.
    """
    levels = list(levels)
    ok = ~F.col(error)
    g = scored.groupingSets([levels, []], *levels).agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).cast("bigint").alias("n_total"),
        F.count_if(F.col(error)).cast("bigint").alias("n_errors"),
        F.avg(F.when(ok, F.col(f1))).alias("_mean"))
    return g.select(F.when(F.col("_gid") == 0, "cell").otherwise("overall").alias("scope"),
                    *levels, "n_total", "n_errors", _r6(F.col("_mean")).alias("mean_f1"))


def _by_key(entries: Column) -> Column:
    """Sort (k, v) entries by key only (values may be maps, which do not order)."""
    return F.array_sort(entries, lambda a, b: F.when(a["k"] < b["k"], -1)
                        .when(a["k"] > b["k"], 1).otherwise(0))


def nested_report(report: DataFrame, levels: Sequence[str] = LEVEL_COLS) -> DataFrame:
    """One row: overall mean and map primary -> (map secondary -> mean).

    Cells are at most |primary| x |secondary| rows, so the collection is
    bounded by the level catalogue, not by the data.
    """
    p, s = levels
    cells = report.filter(F.col("scope") == "cell")
    inner = cells.groupBy(p).agg(F.map_from_entries(_by_key(F.collect_list(
        F.struct(F.col(s).alias("k"), F.col("mean_f1").alias("v"))))).alias("by_secondary"))
    outer = inner.agg(F.map_from_entries(_by_key(F.collect_list(
        F.struct(F.col(p).alias("k"), F.col("by_secondary").alias("v"))))).alias("by_primary"))
    overall = report.filter(F.col("scope") == "overall").select("mean_f1").scalar()
    return outer.select(overall.alias("overall"), "by_primary")


def nested_report_json(nested: DataFrame) -> DataFrame:
    return nested.select(F.to_json(F.struct("overall", "by_primary")).alias("report"))


def unnest_report(nested: DataFrame, levels: Sequence[str] = LEVEL_COLS) -> DataFrame:
    p, s = levels
    return (nested.select(F.explode("by_primary").alias(p, "m"))
                  .select(p, F.explode("m").alias(s, "mean_f1")))


def eval_counts(answered: DataFrame, generated: str = "generated_answer") -> DataFrame:
    """Total rows and rows without any generated sample."""
    return answered.agg(F.count(F.lit(1)).cast("bigint").alias("n_total"),
                        F.count_if(F.coalesce(F.size(generated) == 0, F.lit(False))).cast("bigint").alias("n_errors"))


def leaderboard(scored: DataFrame, modes: Sequence[str] = ("with_code", "question_only"),
                f1: str = "f1") -> DataFrame:
    """Model x prompt-mode mean F1, and the gain from showing the code."""
    a, b = modes
    piv = scored.groupBy("model").pivot("prompt_mode", list(modes)).agg(F.avg(f1))
    return piv.select("model", _r6(F.col(a)).alias(f"f1_{a}"), _r6(F.col(b)).alias(f"f1_{b}"),
                      _r6(F.col(a) - F.col(b)).alias("context_gain"))


def fallback_rate(grid: DataFrame, levels: Sequence[str] = LEVEL_COLS) -> DataFrame:
    """Share of rows whose rewrite fell back (``error``), per level cell."""
    return grid.groupBy(*levels).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                     F.count_if("error").cast("bigint").alias("n_errors"),
                                     _r6(F.avg(F.col("error").cast("double"))).alias("error_rate"))


def max_token_len(df: DataFrame, col: str) -> DataFrame:
    """Longest whitespace-token length over the data set."""
    return df.agg(F.max(TX.whitespace_token_count(col)).cast("bigint").alias("max_tokens"))
