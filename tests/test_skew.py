"""A key holding a third of all rows: results stay whole and exact."""

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.operators import conversation as C
from codequarry.operators import infer as I


def hot_messages(spark, n_hot=300, n_small=100):
    rows = [(0, t, "user" if t % 2 == 0 else "assistant", f"hot {t}") for t in range(n_hot)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"m{c} {t}")
             for c in range(1, n_small + 1) for t in range(6)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_hot_conversation_pairs_and_context(spark):
    m = hot_messages(spark)
    pairs = C.qa_pairs(m)
    assert pairs.filter("conv_id = 0").count() == 150 and pairs.count() == 150 + 100 * 3
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    brute = m.select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("p"))
    got = C.running_context(m, chunk_turns=16).select("conv_id", "turn", F.col("prev_chars").alias("p"))
    assert sorted(got.collect()) == sorted(brute.collect())


def test_no_task_holds_the_hot_conversation(spark):
    """A conversation with a third of all rows is dealt to ranges of like size."""
    from codequarry.operators.ordinals import Ordered
    m = hot_messages(spark, n_hot=3000, n_small=1000).repartition(8)
    placed = Ordered(m, [F.col("turn")], [F.col("conv_id")], ranges=20).placed
    sizes = sorted(r["count"] for r in placed.groupBy("_range").count().collect())
    assert len(sizes) == 20 and sizes[-1] <= 2 * sizes[10]
    windows = [r["count"] for r in placed.groupBy("_range", "_w0").count().collect()]  # rows of one window
    assert max(windows) <= 2 * sizes[10]
    pairs = C.qa_pairs(m)
    assert pairs.filter("conv_id = 0").count() == 1500 and pairs.count() == 1500 + 1000 * 3


def test_context_pieces_are_bounded(spark):
    m = hot_messages(spark, n_hot=900)
    out = C.context_window(m, budget=30).filter("conv_id = 0").collect()
    assert len(out) == 450 and max(r.n_tokens for r in out) <= 30 and max(r.n_turns for r in out) == 10


def test_hot_prompt_called_once(spark, tmp_dir):
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"p{i}") for i in range(300)], "id bigint, prompt string")

    def factory():
        def run(prompts, n, seeds, config):
            with open(os.path.join(tmp_dir, f"c-{os.getpid()}"), "a") as f:
                f.write("".join(p + "\n" for p in prompts))
            return [[p.upper()] for p in prompts]
        return run

    out = I.batch_infer(df, "prompt", factory, I.GenerationConfig(n=1))
    assert out.filter(F.col("generated_answer")[0] == "HOT").count() == 100
    calls = [line for f in os.listdir(tmp_dir) for line in open(os.path.join(tmp_dir, f)).read().split()]
    assert calls.count("hot") == 1 and len(calls) == 201
