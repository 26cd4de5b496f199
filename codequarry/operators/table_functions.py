"""Table functions for SQL: the rows that a code text yields, by ``LATERAL``.

``register(spark)`` makes them known to a session; then

    SELECT c.code_id, i.* FROM codes c, LATERAL identifiers(c.code) i

gives what :func:`.rewrite.identifier_table` gives, one row for each
identifier, without a nested list in a result row.  A code is parsed for every
row that holds it: make the codes distinct first where they repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from ..plans import catalog
from ..session import ship_package
from .rewrite import rewrite_code


class Identifiers:
    """``identifiers(code)``: (name, alias, is_def, first_pos) of the names that a rename changes.

    A code that is NULL or does not parse has no rows.
    """

    def eval(self, code: str) -> Iterator[tuple[str, str, bool, int]]:
        if code is None:
            return
        key = hashlib.md5(code.encode()).hexdigest()
        for i in rewrite_code(code, key, catalog.DEFAULT_SEED, wanted=())["idents"]:
            yield i["name"], i["alias"], i["is_def"], i["first_pos"]


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.udtf.register("identifiers", udtf(Identifiers, returnType="name string, alias string, is_def boolean, first_pos bigint",
                                            useArrow=True))


def identifiers(codes: DataFrame, key: str, code: str = "code") -> DataFrame:
    """(key, name, alias, is_def, first_pos) of a table of codes."""
    spark = codes.sparkSession
    register(spark)
    return spark.sql(f"SELECT c.`{key}`, i.* FROM {{codes}} c, LATERAL identifiers(c.`{code}`) i", codes=codes)
