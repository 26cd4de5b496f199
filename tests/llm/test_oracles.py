"""Operators that SQL can express, against DuckDB on the same tables."""

import duckdb
import pytest

from codequarry.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = Q.QUERIES[name](spark, SF)
    res = con.sql(Q.ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    fix = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(repr, map(fix, df.select(*cols).collect()))) == sorted(map(repr, map(fix, res.fetchall())))


def test_names_follow_the_numbering():
    assert {int(n[2:].split("_")[0]) for n in Q.QUERIES} == set(range(1, 14)) and set(Q.ORACLE) <= set(Q.QUERIES)
