"""The three jobs end to end on the smallest tables with stub completers."""

import os

from pyspark.sql import functions as F

from codequarry.operators import evaluate as E
from codequarry.operators import infer as I
from codequarry.plans import jobs
from codequarry.sources.tables import synth_code, table

SF = "/root/testdata/sf0.001"


def test_build_answer_score(spark, tmp_dir):
    corpus = synth_code(table(spark, SF, "documents")).select("code_id", "code")
    built = jobs.build_qa_dataset(spark, corpus, I.hash_completer, I.echo_code_completer,
                                  os.path.join(tmp_dir, "dataset"), n=5)
    assert built.count() == 5 * 9 * 16
    assert built.groupBy("primary_obfuscation", "secondary_obfuscation").count().count() == 16
    assert built.filter(~F.col("error") & (F.col("secondary_obfuscation") == "None")).count() == 5 * 9 * 4

    root = os.path.join(tmp_dir, "answers")
    part = built.filter(F.col("category") == "General")
    a1 = jobs.answer_records(spark, part, I.hash_completer, "stub", "with_code", root)
    a2 = jobs.answer_records(spark, built, I.hash_completer, "stub", "with_code", root)  # resumes
    assert a1.count() == 5 * 16 and a2.count() == built.count()
    assert a2.select("code_id", "category", "primary_obfuscation", "secondary_obfuscation").distinct().count() \
        == built.count()

    vectors = table(spark, SF, "embeddings")
    scored, report = jobs.score_answers(spark, a2, vectors, os.path.join(tmp_dir, "scores"))
    assert scored.count() == built.count()
    rows = report.collect()
    assert len([r for r in rows if r["scope"] == "cell"]) == 16
    overall = [r for r in rows if r["scope"] == "overall"][0]
    assert overall["n_total"] == built.count() and overall["n_errors"] == 0
    assert E.nested_report(report).count() == 1
