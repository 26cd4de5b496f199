"""Batches by length: against a plain packing, with ties, NULLs and a hot length."""

import random

import pytest

from codequarry.operators import batches as B
from codequarry.operators import infer as I


def class_end(n):
    """The smallest number of the form (4..8) * 2^k that holds n."""
    n = max(n or 0, 1)
    k = 0
    while n > 8 * 2 ** k:
        k += 1
    return -(-n // 2 ** k) * 2 ** k


def packed(lengths, budget):
    """Records in order of length, a new batch where the class ends or the batch is full."""
    out, batch, end, held = {}, -1, None, 0
    for key, n in sorted(lengths.items(), key=lambda x: (class_end(x[1]), x[1] or 0, x[0])):
        if class_end(n) != end or (held + 1) * end > budget:
            batch, end, held = batch + 1, class_end(n), 0
        held += 1
        out[key] = batch
    return out


@pytest.mark.parametrize("budget", [1, 40, 1000])
def test_equals_a_plain_packing(spark, budget):
    rng = random.Random(budget)
    lengths = {i: rng.choice([None, 0, 1, 7, 8, 9, 17, 30, 31, 33, 64, 65, 700, 5000]) for i in range(300)}
    df = spark.createDataFrame(list(lengths.items()), "id long, n long").repartition(5)
    got = {r["id"]: r["batch_no"] for r in B.length_batches(df, "n", ["id"], budget).collect()}
    assert got == packed(lengths, budget)


def test_padding_and_budget(spark):
    df = spark.range(5000).selectExpr("id", "cast(1 + (id * id * 31) % 3000 as int) AS n")
    batched = B.length_batches(df, "n", ["id"], 4096)
    assert batched.count() == 5000
    rows = B.batch_waste(batched, "n").collect()
    assert sum(r["n_records"] for r in rows) == 5000
    assert all(r["padded_tokens"] <= 4096 for r in rows)
    assert all(5 * r["waste_tokens"] < r["padded_tokens"] for r in rows)
    assert sorted(r["batch_no"] for r in rows) == list(range(len(rows)))


def test_hot_length_and_empty_table(spark):
    df = spark.range(9000).selectExpr("id", "if(id % 3 = 0, 50, 10 + id % 40) AS n")
    sizes = [r["n_records"] for r in B.batch_waste(B.length_batches(df, "n", ["id"], 560), "n").collect()]
    assert max(sizes) * 50 <= 560 * 5 and sum(sizes) == 9000
    assert B.length_batches(df.filter("false"), "n", ["id"], 560).count() == 0


def test_one_call_for_each_batch(spark):
    def counting():
        def run(prompts, n, seeds, config):
            if "bad" in prompts:
                raise RuntimeError("refused")
            return [[f"{len(prompts)}:{p}"] for p in prompts]
        return run

    rows = [(i, "p" * (1 + i % 3), 1 + i % 3) for i in range(30)] + [(30, None, None), (31, "bad", 3)]
    df = spark.createDataFrame(rows, "id long, prompt string, n int")
    out = I.complete_by_length(df, "prompt", "n", ["id"], counting, 30, I.GenerationConfig(n=1), retries=0, error_col="error")
    got = {r["id"]: (r["completions"], r["error"]) for r in out.collect()}
    assert len(got) == 32
    assert got[30] == (None, None)
    assert got[31] == ([], "RuntimeError: refused")
    assert all(got[i][0] == ["10:" + "p" * (1 + i % 3)] for i in range(30) if i % 3 < 2)  # ten prompts of 1 and of 2 tokens
    assert all(len(got[i][0]) == 1 and got[i][1] is None for i in range(30))
