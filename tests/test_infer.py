import os

import pytest

from pyspark.sql import functions as F

from codequarry.operators import infer as I


def counting_factory(log_dir):
    def factory():
        def run(prompts, n, seeds, config):
            with open(os.path.join(log_dir, f"calls-{os.getpid()}.txt"), "a") as f:
                for p in prompts:
                    f.write(p.replace("\n", " ") + "\n")
            return [[f"{p}#{i}" for i in range(n)] for p in prompts]
        return run
    return factory


def calls(log_dir):
    out = []
    for name in os.listdir(log_dir):
        if name.startswith("calls-"):
            out += open(os.path.join(log_dir, name)).read().splitlines()
    return out


def test_identical_prompts_called_once(spark, tmp_dir):
    df = spark.createDataFrame([(i, "same" if i % 2 else f"p{i}") for i in range(10)], "id bigint, prompt string")
    out = I.batch_infer(df, "prompt", counting_factory(tmp_dir), I.GenerationConfig(n=2), batch_size=3)
    rows = {r["id"]: r["generated_answer"] for r in out.collect()}
    assert rows[1] == ["same#0", "same#1"] and rows[2] == ["p2#0", "p2#1"]
    assert sorted(calls(tmp_dir)).count("same") == 1 and len(calls(tmp_dir)) == 6


def test_salt_gives_each_record_its_call(spark, tmp_dir):
    df = spark.createDataFrame([(1, "same"), (2, "same")], "id bigint, prompt string")
    I.complete_distinct(df, "prompt", counting_factory(tmp_dir), salt_col="id").count()
    assert len(calls(tmp_dir)) == 2


def test_resume_is_idempotent(spark, tmp_dir):
    recs = spark.createDataFrame([(i, f"q{i}") for i in range(20)], "id bigint, prompt string")
    out_path = os.path.join(tmp_dir, "answers")
    log = os.path.join(tmp_dir, "log")
    os.makedirs(log)
    first = I.run_resumable(spark, recs, ["id"], "prompt", counting_factory(log), out_path,
                            I.GenerationConfig(n=1), commits=3)
    assert first.count() == 20
    n_calls = len(calls(log))
    again = I.run_resumable(spark, recs, ["id"], "prompt", counting_factory(log), out_path, I.GenerationConfig(n=1))
    assert again.count() == 20 and len(calls(log)) == n_calls  # nothing pending, no call
    # lose some written results, run again: exactly those are redone
    kept = again.filter(F.col("id") >= 5).select("id", "prompt", "generated_answer")
    out2 = os.path.join(tmp_dir, "answers2")
    kept.write.parquet(out2)
    redone = I.run_resumable(spark, recs, ["id"], "prompt", counting_factory(log), out2, I.GenerationConfig(n=1))
    assert sorted(r["id"] for r in redone.collect()) == list(range(20))
    assert len(calls(log)) == n_calls + 5


def test_damaged_output_is_an_error_not_an_empty_start(spark, tmp_dir):
    recs = spark.createDataFrame([(i, f"q{i}") for i in range(4)], "id bigint, prompt string")
    out = os.path.join(tmp_dir, "damaged")
    os.makedirs(out)
    with open(os.path.join(out, "part-00000.parquet"), "wb") as f:
        f.write(b"PAR1 this is no footer")
    with pytest.raises(Exception):
        I.run_resumable(spark, recs, ["id"], "prompt", I.hash_completer, out, I.GenerationConfig(n=1)).collect()
    assert os.listdir(out) == ["part-00000.parquet"]


def test_records_with_equal_prompts_get_their_own_samples(spark):
    recs = spark.createDataFrame([(i, "same") for i in range(6)], "id bigint, prompt string")
    own = I.batch_infer(recs, "prompt", I.seeded_hash_completer, I.GenerationConfig(n=2), share=False, seed_cols=["id"])
    assert len({tuple(r["generated_answer"]) for r in own.collect()}) == 6
    shared = I.batch_infer(recs, "prompt", I.seeded_hash_completer, I.GenerationConfig(n=2))
    assert len({tuple(r["generated_answer"]) for r in shared.collect()}) == 1


def test_prompt_text_does_not_cross_the_join(spark):
    recs = spark.createDataFrame([(i, f"q{i}") for i in range(6)], "id bigint, prompt string")
    out = I.batch_infer(recs, "prompt", I.hash_completer, I.GenerationConfig(n=1)).select("id", "generated_answer")
    plan = out._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        if "Exchange hashpartitioning" in line:
            assert "prompt#" not in line


def test_replay_by_prompt_not_position(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "zzz")], "id bigint, prompt string")
    rec = spark.createDataFrame([("a", ["A"]), ("b", ["B"]), ("b", ["B2"])], "prompt string, texts array<string>")
    got = {r["id"]: r["generated_answer"] for r in I.replay(df, "prompt", rec).collect()}
    assert got == {1: ["B"], 2: ["A"], 3: None}


def test_pending(spark):
    recs = spark.range(5).withColumnRenamed("id", "k")
    done = spark.createDataFrame([(1,), (3,)], "k bigint")
    assert sorted(r["k"] for r in I.pending(recs, done, ["k"]).collect()) == [0, 2, 4]


def test_replay_completer_by_text(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c")], "id bigint, prompt string")
    rec = {"a": ["A"], "b": ["B"]}
    out = I.batch_infer(df, "prompt", lambda: I.replay_completer(rec), I.GenerationConfig(n=1))
    assert {r["id"]: r["generated_answer"] for r in out.collect()} == {1: ["B"], 2: ["A"], 3: []}


def flaky_factory(log_dir, bad, heals=False):
    """Raises on batches with a prompt of ``bad``; with ``heals`` only while the log folder has no file 'well'."""
    def factory():
        def run(prompts, n, seeds, config):
            with open(os.path.join(log_dir, f"calls-{os.getpid()}.txt"), "a") as f:
                f.write("".join(p + "\n" for p in prompts))
            if any(p in bad for p in prompts) and not (heals and os.path.exists(os.path.join(log_dir, "well"))):
                raise RuntimeError("boom")
            return [None if p == "q3" else [f"{p}#{i}" for i in range(n)] for p in prompts]
        return run
    return factory


def test_a_failing_prompt_leaves_the_others_answered(spark, tmp_dir):
    df = spark.createDataFrame([(i, f"q{i}" if i != 9 else None) for i in range(40)], "id bigint, prompt string").coalesce(1)
    bad = {"q5", "q17", "q18"}
    for share in (True, False):
        out = I.batch_infer(df, "prompt", flaky_factory(tmp_dir, bad), I.GenerationConfig(n=2), batch_size=8, share=share,
                            seed_cols=("id",), retries=2, error_col="why")
        rows = {r.id: r for r in out.collect()}
        for i, r in rows.items():
            if f"q{i}" in bad:
                assert r.generated_answer == [] and r.why == "RuntimeError: boom"
            elif i == 3:
                assert r.generated_answer == [] and r.why == I.NO_ANSWER
            elif i == 9:
                assert r.generated_answer is None and r.why is None
            else:
                assert r.generated_answer == [f"q{i}#0", f"q{i}#1"] and r.why is None


def test_without_retries_the_error_ends_the_job(spark, tmp_dir):
    df = spark.createDataFrame([(1, "q5")], "id bigint, prompt string")
    with pytest.raises(Exception, match="boom"):
        I.batch_infer(df, "prompt", flaky_factory(tmp_dir, {"q5"}), I.GenerationConfig(n=1), share=False).collect()


def test_bisection_retries_only_the_failing_prompt():
    asked = []

    def completer(prompts, n, seeds, config):
        asked.append(list(prompts))
        if "c" in prompts:
            raise ValueError("no")
        return [[p] for p in prompts]
    got = I.answer_batch(completer, list("abcdefgh"), list(range(8)), I.GenerationConfig(n=1), retries=3)
    assert got == [([p], None) if p != "c" else ([], "ValueError: no") for p in "abcdefgh"]
    assert asked.count(["c"]) == 4 and sum(len(a) for a in asked if "c" not in a) == 7


def test_resume_retries_only_the_failures(spark, tmp_dir):
    recs = spark.createDataFrame([(i, f"q{i}") for i in range(20)], "id bigint, prompt string")
    out_path, log = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "log")
    os.makedirs(log)
    args = (spark, recs, ["id"], "prompt", flaky_factory(log, {"q5", "q17"}, heals=True), out_path, I.GenerationConfig(n=1))
    first = {r.id: r for r in I.run_resumable(*args, retries=0, commits=2).collect()}
    assert len(first) == 20 and sorted(i for i, r in first.items() if not r.generated_answer) == [3, 5, 17]
    for name in os.listdir(log):
        os.truncate(os.path.join(log, name), 0)
    open(os.path.join(log, "well"), "w").close()
    second = {r.id: r for r in I.run_resumable(*args, retries=0).collect()}
    assert sorted(calls(log)) == ["q17", "q3", "q5"]
    assert [i for i, r in second.items() if not r.generated_answer] == [3] and second[5].attempt == 2 and len(second) == 20
    assert first[0].attempt == second[0].attempt == 1
    n = len(calls(log))
    third = I.run_resumable(*args, retries=0, attempts=2)
    assert len(calls(log)) == n and third.count() == 20  # tried in two runs: left as failed
