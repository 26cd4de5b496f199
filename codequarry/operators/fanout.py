"""Fan-out of records over fixed catalogues (categories, rewrite levels).

A catalogue is a handful of literal rows, so fan-out is an ``explode`` of a
literal array of structs: a Generate node in the same stage, with no join
and no shuffle.  Fan-out emits keys only; code and text are joined in late,
once per distinct value, where a job needs them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import catalog


def literal_rows(rows: Sequence[Sequence], names: Sequence[str]) -> Column:
    """array<struct<names...>> of literal values."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])


def fan_out(df: DataFrame, rows: Sequence[Sequence], names: Sequence[str], alias: str = "_f") -> DataFrame:
    """Every input row once per catalogue row; catalogue fields become columns."""
    cols = [c for c in df.columns]
    return (df.select(*cols, F.explode(literal_rows(rows, names)).alias(alias))
              .select(*cols, *[F.col(f"{alias}.{n}").alias(n) for n in names]))


def over_categories(df: DataFrame) -> DataFrame:
    rows = [(i, c, p, q) for i, (c, p, q) in
            enumerate(zip(catalog.CATEGORIES, catalog.PRE_PROMPTS, catalog.QUESTION_PROMPTS))]
    return fan_out(df, rows, ["category_no", "category", "pre_prompt", "prompt"])


def over_primary(df: DataFrame, levels: Sequence[str] = catalog.PRIMARY_LEVELS) -> DataFrame:
    return fan_out(df, [(lv,) for lv in levels], ["primary_obfuscation"])


def over_secondary(df: DataFrame, levels: Sequence[str] = catalog.SECONDARY_LEVELS) -> DataFrame:
    return fan_out(df, [(lv,) for lv in levels], ["secondary_obfuscation"])


def over_grid(df: DataFrame) -> DataFrame:
    """Record x primary x secondary (16 variants per record)."""
    return over_secondary(over_primary(df))


def numbered(df: DataFrame, n: int, name: str = "q_no") -> DataFrame:
    """Every row n times with an index 0..n-1 (follow-up questions)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
