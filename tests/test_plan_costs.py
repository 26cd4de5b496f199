"""Plans that make, shuffle or count a text once."""

import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.operators import sentences as SE
from codequarry.plans import q_inference, q_rewrite, q_text


@pytest.fixture()
def docs_dir(spark, tmp_dir):
    rows = [(1, "Alpha beta gamma. The rest.", "a"), (2, "Two words 3! more\nand more", "b"), (3, None, "a"), (3, "", None),
            (5, "e.g. one", "c"), (5, "e.g. one", "c")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_dir}/documents.parquet")
    return tmp_dir


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_first_words_are_the_head_of_all_words(spark):
    texts = ["", None, "a", "A b", " ?a--B..c d", "ÄB c9 9 x", "éé\n\n", "x" * 5000 + " y", "?" * 20000, "İ a", "aİb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    three = F.array(*[F.try_element_at(F.slice(T.ascii_words("t"), 1, 3), F.lit(i)) for i in (1, 2, 3)])
    for r in df.select("t", T.first_ascii_words("t", 3).alias("a"), three.alias("b")).collect():
        assert r["a"] == r["b"], r["t"]


def test_leak_report_makes_each_code_once(spark, docs_dir):
    df = q_text.leak_report(spark, docs_dir)
    once = q_text.leak_flag(spark, docs_dir)
    assert plan(df).count("regexp_extract_all") <= plan(once).count("regexp_extract_all")
    flags = q_text.leak_flag(spark, docs_dir).filter("leaked_after").select("code_id").collect()
    assert sorted(r["code_id"] for r in df.collect()) == sorted(r["code_id"] for r in flags)


def test_codes_are_synthesised_once_for_the_parser(spark, docs_dir):
    assert "regexp_extract" not in plan(q_rewrite.alias_map(spark, docs_dir))


def test_categories_fan_out_after_the_rewrites_are_joined(spark, tmp_dir):
    spark.createDataFrame([(1, "One two three. Four"), (2, None)], "doc_id bigint, text string").write.parquet(
        f"{tmp_dir}/documents.parquet")
    df = q_inference.primary_rewrite(spark, tmp_dir)
    lines = plan(df).splitlines()
    joins = [i for i, x in enumerate(lines) if "Join" in x]
    assert [i for i, x in enumerate(lines) if "Generate" in x and "code_md5" in lines[i - 1] + x][0] < joins[0]
    assert df.count() == 2 * len(q_inference.catalog.CATEGORIES) * len(q_inference.catalog.PRIMARY_LEVELS)


def test_memo_joins_digests_and_no_texts(spark, docs_dir):
    lines = plan(q_inference.memo_rewrite(spark, docs_dir)).splitlines()
    join = next(i for i, x in enumerate(lines) if "Join" in x)
    assert not any("md5(cast(obfuscated_code" in x for x in lines[:join]) and any("md5(cast(obfuscated_code" in x for x in lines[join:])


def test_types_are_counted_once_and_the_join_carries_no_tokens(spark):
    docs = spark.createDataFrame([(1, "Dr. A went. He"), (2, None), (3, "")], "doc_id bigint, text string")
    learned = SE.abbreviations(docs)
    assert "Generate" not in plan(learned)
    lines = plan(SE.first_sentences(docs, learned)).splitlines()
    join = next(i for i, x in enumerate(lines) if "Join LeftOuter" in x)
    assert any("split(" in x for x in lines[:join])
