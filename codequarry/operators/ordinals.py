"""Row numbers, running sums and next rows in a global order, without a
window that holds a whole table or a whole group.

A window over one ordered group sorts it in a single task.  Here the rows
are dealt to ranges of (group, order key) and sorted inside them, once.
What a row needs from the ranges before or after its own is one small row
for each range and group, or each range's first row; a window over those
holds as many rows as there are ranges, whatever the table's size.

Rows with equal keys would all fall into one range, so the number of the
input partition is the last sort key: it depends on no row order, so a task
that runs again deals its rows alike, and a key repeated on a third of all
rows is still dealt to many ranges.

Keys ascend, NULLs first; NULL is a group of its own.  Rows that agree in
every key come in any order: put a digest of the row last where that
matters.  Results do not depend on the number of ranges.  An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import persisted

_PLACE = (1 << 33) - 1  # the low bits of monotonically_increasing_id: the row's place in its partition


class Ordered:
    """``df`` in ranges of an order within groups, written once.

    ``ranges`` defaults to ``spark.sql.shuffle.partitions``.
    """

    def __init__(self, df: DataFrame, order: Sequence[Column], within: Sequence[Column] = (),
                 ranges: int | None = None):
        ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.groups, keys = [f"_w{i}" for i in range(len(within))], [f"_k{i}" for i in range(len(order))]
        # the row is one struct, so no column of it can clash with a working column
        keyed = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"),
                          *[c.alias(n) for c, n in zip(within, self.groups)], *[c.alias(n) for c, n in zip(order, keys)],
                          F.spark_partition_id().alias("_tie"))
        by = [*self.groups, *keys, "_tie"]
        dealt = keyed.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))
        self.placed = persisted(dealt.select("_row", *self.groups, F.spark_partition_id().alias("_range"),
                                             place.alias("_at")), "ordered")

    def _same(self, suffix: str) -> Column:
        return reduce(and_, [F.col(g).eqNullSafe(F.col(g + suffix)) for g in self.groups], F.lit(True))

    def _starts(self, **sums: Column) -> DataFrame:
        """One row for each range and group: ``sums`` of the group's rows in the ranges before, and its totals."""
        each = self.placed.groupBy(*self.groups, "_range").agg(F.min("_at").alias("_first"),
                                                               *[c.alias(n) for n, c in sums.items()])
        group = Window.partitionBy(*self.groups)
        before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        return each.select(*[F.col(g).alias(f"{g}_s") for g in self.groups], F.col("_range").alias("_range_s"), "_first",
                           *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums],
                           *[F.sum(n).over(group).alias(f"{n}_total") for n in sums])

    def _with_starts(self, rows: DataFrame, starts: DataFrame) -> DataFrame:
        same = (F.col("_range") == F.col("_range_s")) & self._same("_s")
        # without groups there is one start for each range: a side of a known size
        return rows.join(starts if self.groups else F.broadcast(starts), same)

    def numbers(self, ordinal: str = "ordinal", total: str | None = None) -> DataFrame:
        """The rows with ``ordinal``: 0, 1, 2, ... in each group, and ``total``: the rows of the group."""
        joined = self._with_starts(self.placed, self._starts(_n=F.count(F.lit(1))))
        out = [(F.col("_at") - F.col("_first") + F.col("_n")).alias(ordinal)]
        return joined.select("_row.*", *out, *([F.col("_n_total").alias(total)] if total else []))

    def sums_before(self, **names: str) -> DataFrame:
        """The rows with the sum of column ``v`` over the group's rows before each, for ``name=v``."""
        at = {n: F.col(f"_row.`{v}`") for n, v in names.items()}
        inside = Window.partitionBy(*self.groups, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        rows = self.placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{n}")
                                         for n, c in at.items()])
        starts = self._starts(**{f"_s_{n}": F.coalesce(F.sum(c), F.lit(0)) for n, c in at.items()})
        return self._with_starts(rows, starts).select(
            "_row.*", *[(F.col(f"_in_{n}") + F.col(f"_s_{n}")).alias(n) for n in names])

    def next(self, **names: str) -> DataFrame:
        """The rows with column ``v`` of the group's next row, for ``name=v``; NULL after the last one.

        Each range's first row is handed to the range before it.
        """
        seen = F.struct(*[F.col(f"_row.`{v}`").alias(n) for n, v in names.items()])
        inside = Window.partitionBy(*self.groups, "_range").orderBy("_at")
        rows = self.placed.select("*", F.lead(seen).over(inside).alias("_next"))
        ranges = Window.orderBy("_range")  # one row for each range that is not empty
        heads = self.placed.filter("_at = 0").select(
            F.col("_range").alias("_range_h"), F.lead(seen).over(ranges).alias("_head"),
            *[F.lead(g).over(ranges).alias(f"{g}_h") for g in self.groups])
        joined = rows.join(heads, F.col("_range") == F.col("_range_h"))
        # a group that goes on in the next range is the last one of its own
        after = F.coalesce(F.col("_next"), F.when(self._same("_h"), F.col("_head")))
        return joined.select("_row", after.alias("_next")).select("_row.*", *[F.col(f"_next.{n}").alias(n) for n in names])


def numbered(df: DataFrame, order: Sequence[Column], within: Sequence[Column] = (), ordinal: str = "ordinal",
             total: str | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with ``ordinal``: 0, 1, 2, ... in the order of ``order``, in each group of ``within``.

    ``total`` names a column for the rows of the group.
    """
    return Ordered(df, order, within, ranges=ranges).numbers(ordinal, total)
