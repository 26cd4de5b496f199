"""Results do not depend on the number of shuffle partitions."""

import math

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["qa_pairs", "running_context", "batch_assign", "merge_batch", "eval_grouping_sets",
         "seeded_sample", "memo_rewrite", "secondary_grid", "ordinal_alias", "generate_qa"]


def canon(df):
    def norm(v):
        return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    cols = sorted(df.columns)
    return sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_same_result_with_1_and_8_partitions(spark, name):
    q = entry.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = canon(q(spark, SF))
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        eight = canon(q(spark, SF))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == eight and len(one) > 0
