"""Primary rewrites: one call for each distinct code and level, and few texts on disk."""

import hashlib
import os
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codequarry import session
from codequarry.operators import generate as G
from codequarry.operators import infer as I
from codequarry.plans import catalog, q_inference

CODES = [(1, "def a():\n    return 1"), (2, "def b():\n    return 2"), (3, "def a():\n    return 1"), (4, None), (5, ""),
         (6, "def silent(): pass"), (7, "def one(): pass"), (8, "def two(): pass"), (None, "def c():\n    return 3")]


def answering():
    def answer(prompt, seed):
        """No answer for one code; one refactored text for two others; else a text that depends on the prompt and the seed."""
        if prompt.startswith("def silent"):
            return []
        if prompt.startswith(("def one", "def two")) and prompt.endswith(catalog.REFACTOR_PROMPT):
            return ["Sure!\ndef same():\n    pass\nDone."]
        return [f"Sure!\ndef x():\n\t{hashlib.md5(f'{prompt}|{seed}'.encode()).hexdigest()}\nDone."]
    return answer


def logging_factory(folder):
    answer = answering()

    def factory():
        def run(prompts, n, seeds, config):
            for p, s in zip(prompts, seeds):
                with open(os.path.join(folder, hashlib.md5(p.encode()).hexdigest()), "a") as f:
                    f.write("x")
            return [answer(p, s) for p, s in zip(prompts, seeds)]
        return run
    return factory


def expected():
    answer = answering()

    def call(code, instruction):
        prompt = f"{code}\n\n{instruction}"
        prompts.add(prompt)
        got = answer(prompt, I.prompt_seed(catalog.DEFAULT_SEED, hashlib.md5(prompt.encode()).hexdigest()))
        return "\n".join(x for x in got[0].split("\n") if x.startswith(("\t", " ", "def ", "class "))) if got else None
    prompts, rows = set(), []
    for key, code in CODES:
        first = None if code is None else call(code, catalog.REFACTOR_PROMPT)
        rows += [(key, "Refactor", first), (key, "Dead Code", None if code is None else call(code, catalog.DEAD_CODE_PROMPT))]
        if first is not None:
            rows.append((key, "Refactor and Dead Code", call(first, catalog.DEAD_CODE_PROMPT)))
    return rows, prompts


@pytest.mark.parametrize("digests", [False, True])
def test_each_code_and_level_is_asked_once(spark, tmp_dir, digests):
    codes = spark.createDataFrame(CODES, "code_id bigint, code string").repartition(3)
    out = G.primary_rewrites(codes, logging_factory(tmp_dir), out=F.md5 if digests else None)
    rows, prompts = expected()
    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    want = [(k, lv, md5(t) if digests else t) for k, lv, t in rows]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    asked = {f: len(Path(tmp_dir, f).read_text()) for f in os.listdir(tmp_dir)}
    assert asked == {hashlib.md5(p.encode()).hexdigest(): 1 for p in prompts}


def texts_shuffled(df):
    """How many exchanges of the plan carry a column of whole texts."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    return sum(bool(re.search(r"\b(code|first|prompt|_prompt|_out|generated_answer|completions|_code|_refactored)(\(.*\))?#", x))
               for x in inputs)


def test_two_texts_of_a_code_are_shuffled_and_one_is_written(spark, tmp_dir, monkeypatch):
    text = [" ".join(hashlib.md5(f"{i} {j}".encode()).hexdigest() for j in range(60)) + "." for i in range(200)]
    spark.createDataFrame(list(enumerate(text)), "doc_id bigint, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    written = []

    def recorded(df, name, **more):
        out = session.persisted(df, name, **more)
        written.append((df, sum(p.stat().st_size for f in out.inputFiles() for p in [Path(f.removeprefix("file:"))])))
        return out
    monkeypatch.setattr(G, "persisted", recorded)
    out = q_inference.primary_rewrite(spark, tmp_dir)
    assert sum(texts_shuffled(df) for df in [out, *(df for df, _ in written)]) == 2
    given = sum(p.stat().st_size for p in Path(tmp_dir, "documents.parquet").glob("*.parquet"))
    assert sum(n for _, n in written) < 1.5 * given  # three texts for each document before
    assert out.count() == 200 * len(catalog.CATEGORIES) * len(catalog.PRIMARY_LEVELS)


def shuffle_files(spark):
    dirs = spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {p.name for d in dirs for p in Path(d).rglob("shuffle_*.data")}


def test_a_table_stands_without_the_shuffle_files_of_its_write(spark):
    before = shuffle_files(spark)
    df = spark.range(1000).select((F.col("id") % 100).alias("k"), F.md5(F.col("id").cast("string")).alias("t"))
    kept = session.persisted(df.dropDuplicates(["k"]), "kept")
    assert shuffle_files(spark) - before
    before = shuffle_files(spark)
    freed = session.persisted(df.dropDuplicates(["k"]), "freed", free_shuffles=True)
    until = time.time() + 30  # they go in the background
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(session._FREE_SHUFFLES, None) is None
    assert kept.count() == freed.count() == 100
