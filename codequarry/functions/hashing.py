"""Deterministic, partition-independent keys built from md5.

Every id, bucket and alias is a pure function of row content and a seed,
so results do not depend on partitioning, task retries or executor loss.
The same formulas are written in SQL for the DuckDB oracle and in Python
(``py_*``) for code that runs inside Arrow jobs.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_key(col) -> Column:
    """128-bit hex key of a text; narrow join key instead of the text."""
    return F.md5(_c(col))


def md5_bucket(col, n) -> Column:
    """Bucket in [0, n) from the first 32 bits of md5(text(col)); ``n`` a number or a column."""
    h = F.conv(F.substring(F.md5(_c(col).cast("string")), 1, 8), 16, 10).cast("bigint")
    return h % (n if isinstance(n, Column) else F.lit(n))


def seeded_order_key(seed, *cols) -> Column:
    """Sort key for a seeded shuffle: md5(seed | key...)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(c).cast("string") for c in cols]))


def alias_name(seed, code_key, name) -> Column:
    """Rename alias: '_' + 16 hex chars of md5(seed|code_key|name)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), _c(code_key), _c(name)))
    return F.concat(F.lit("_"), F.substring(digest, 1, 16))


def py_alias_name(seed, code_key: str, name: str) -> str:
    """Python twin of :func:`alias_name` (used inside rewrite jobs)."""
    return "_" + hashlib.md5(f"{seed}|{code_key}|{name}".encode("utf-8")).hexdigest()[:16]

