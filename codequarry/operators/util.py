"""Plan helpers shared by operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_by_key(df: DataFrame, key: str) -> DataFrame:
    """Rows unique by ``key``, clustered by it, after one exchange.

    The partial aggregate runs first: a key repeated on a third of the rows
    is one row per map task before the shuffle.
    """
    return df.dropDuplicates([key])


def join_on_key(left: DataFrame, right: DataFrame, left_key, right_key: str, how: str = "inner") -> DataFrame:
    """Equi-join on a key derived from an expression (e.g. md5 of a text).

    A plain ``=`` makes the optimizer infer ``isnotnull(<expression>)`` and
    push it below the projection, so the expression (often a rendered prompt
    or a synthesised code) is computed twice, in the scan task.  A null-safe
    ``<=>`` infers nothing; callers keep NULL keys out of ``right`` so NULL
    inputs stay unmatched, as with ``=``.  The key is a column of its own, so
    a text it is made from is shuffled only if the caller keeps that text.
    """
    lk = F.col(left_key) if isinstance(left_key, str) else left_key
    keyed = left.withColumn("_join_key", lk)
    return keyed.join(right, keyed["_join_key"].eqNullSafe(right[right_key]), how).drop("_join_key", right_key)


PIECE_BYTES = 1 << 20  # texts that a Python step works on at a time


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """UTF-8 bytes of each row's texts (string columns and lists of strings)."""
    out = np.zeros(batch.num_rows, dtype=np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            out += pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(col.type) and pa.types.is_string(col.type.value_type):
            each = pc.binary_length(col.flatten()).fill_null(0).to_numpy(zero_copy_only=False)
            upto = np.concatenate(([0], np.cumsum(each, dtype=np.int64)))
            n = pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(n, dtype=np.int64)
            out += upto[ends] - upto[ends - n]
    return out


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with ``most`` bytes of text at most, or of one row.

    Arrow batches are cut by rows, so what a batch holds follows the length of
    its texts; a step that makes several texts of each works on these pieces.
    """
    for batch in batches:
        for i, j in _runs(row_bytes(batch), most):
            yield batch.slice(i, j - i)


def frames(pdfs: Iterator[pd.DataFrame], text: str, most: int = PIECE_BYTES) -> Iterator[pd.DataFrame]:
    """:func:`pieces` for pandas frames, by the characters of one text column."""
    for pdf in pdfs:
        for i, j in _runs(np.array([len(t) if t is not None else 0 for t in pdf[text]], dtype=np.int64), most):
            yield pdf.iloc[i:j].reset_index(drop=True)


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) whose sizes add up to ``most`` at most, or of one."""
    upto, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j
