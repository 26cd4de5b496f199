from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.operators import batches as B
from codequarry.operators import conversation as C
from codequarry.operators import fanout as FO

SF = "/root/testdata/sf0.001"


def test_qa_pairs_and_counts_cross_gaps_in_turns(spark):
    m = spark.read.parquet(f"{SF}/conversations.parquet")
    gaps = m.withColumn("turn", F.col("turn") * 3 + 5)
    by_conv = {}
    for r in sorted(m.collect(), key=lambda r: (r.conv_id, r.turn)):
        by_conv.setdefault(r.conv_id, []).append(r)
    want = sorted((c, a.turn * 3 + 5, a.text, b.text) for c, rows in by_conv.items()
                  for a, b in zip(rows, rows[1:]) if (a.role, b.role) == ("user", "assistant"))
    assert want and sorted(map(tuple, C.qa_pairs(gaps).collect())) == want
    seen = {(r.conv_id, r.turn): r.n_prev_turns for r in C.running_context(gaps, chunk_turns=4).collect()}
    assert seen == {(c, r.turn * 3 + 5): n for c, rows in by_conv.items() for n, r in enumerate(rows)}


def test_running_context_chunked_equals_window(spark):
    m = spark.read.parquet(f"{SF}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    brute = m.select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("prev"))
    got = C.running_context(m, chunk_turns=2).select("conv_id", "turn", F.col("prev_chars").alias("prev"))
    assert sorted(got.collect()) == sorted(brute.collect())


def test_running_context_keeps_rows_with_null_turn_or_conversation(spark):
    m = spark.createDataFrame([(1, 0, "user", "ab"), (1, 9, "user", "c"), (1, None, "user", "dd"), (1, None, "user", "ee"),
                               (None, 0, "user", "fgh"), (None, None, "user", "i"), (None, 5, "user", None)],
                              "conv_id bigint, turn bigint, role string, text string")
    got = [tuple(r) for r in C.running_context(m, chunk_turns=4).select("conv_id", "turn", "n_prev_turns", "prev_chars")
           .collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 0, 0), (1, 9, 1, 2), (1, None, 2, 3), (1, None, 3, 5), (None, 0, 0, 0),
                                           (None, 5, 1, 3), (None, None, 2, 3)], key=str)


def test_chat_segments_generation_prompt(spark):
    m = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "q")],
                              "conv_id bigint, turn bigint, role string, text string")
    segs = [r["segment"] for r in C.chat_segments(m).orderBy("turn").collect()]
    assert "".join(segs) == "<|user|>\nhi\n<|assistant|>\nyo\n<|user|>\nq\n<|assistant|>\n"


def test_batches_are_dense_over_the_table(spark):
    for parts in (1, 200):
        df = spark.range(101).select((F.col("id") % 34).alias("k")).repartition(parts)  # repeated keys
        rows = B.assign_batches(df, ["k"], 8).collect()
        by = {}
        for r in rows:
            by.setdefault(r.batch_no, []).append(r.k)
        assert sorted(by) == list(range(13)) and [len(by[i]) for i in range(13)] == [8] * 12 + [5]
        assert [k for i in range(13) for k in sorted(by[i])] == sorted(r.k for r in rows)


def context_brute(rows, budget):
    by, out = {}, {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role, text, f"<|{role or ''}|>\n{text or ''}\n", t))
    for c, turns in by.items():
        turns.sort(key=lambda x: x[:2])
        for j, call in enumerate(turns):
            if call[2] != "user":
                continue
            i, n = j, len(call[4].split())
            while i and n + len(turns[i - 1][4].split()) <= budget:
                i -= 1
                n += len(turns[i][4].split())
            out[(c, call[5])] = (turns[i][5], j - i + 1, n, "".join(x[4] for x in turns[i:j + 1]) + "<|assistant|>\n")
    return out


def test_context_window_equals_brute_force(spark):
    import random
    r = random.Random(1)
    rows = [(c, 3 * t + 1, r.choice(["user", "assistant", None]), r.choice(["", None, "w " * r.randrange(30), "x" * 50]))
            for c in [0] * 1 + [1, 2, None] for t in range(400 if c == 0 else 12)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    for budget in (1, 7, 40, 4096):
        got = {(x.conv_id, x.turn): (x.first_turn, x.n_turns, x.n_tokens, x.context)
               for x in C.context_window(df, budget).collect()}
        assert got == context_brute(rows, budget)
    assert C.context_window(df.limit(0)).count() == 0


def test_split_and_merge_roundtrip(spark):
    flat = spark.createDataFrame([(1, i, t) for i, t in enumerate("abcd")], "batch_id bigint, pos bigint, text string")
    split = B.split_flat(flat, 2).orderBy("pos").collect()
    assert [(r["example_no"], r["sample_no"]) for r in split] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    parts = (B.split_flat(flat, 2).groupBy("batch_id", "example_no")
              .agg(F.array_sort(F.collect_list(F.struct("sample_no", "text"))).alias("s"))
              .select("batch_id", "example_no", F.transform("s", lambda x: x["text"]).alias("texts")))
    assert B.merge_outputs(parts).first()["texts"] == ["a", "b", "c", "d"]


def test_fanout_cardinality(spark):
    df = spark.range(7).withColumnRenamed("id", "code_id")
    assert FO.over_categories(df).count() == 63
    assert FO.over_grid(FO.over_categories(df)).count() == 7 * 9 * 16
    assert FO.numbered(df, 3).count() == 21


def test_single_user_message_render(spark):
    from codequarry.functions import prompts as P
    df = spark.createDataFrame([("Explain x.",)], "p string")
    got = df.select(P.render_messages(P.user_message("p")).alias("r")).first()["r"]
    assert got == "<|user|>\nExplain x.\n<|assistant|>\n"
    assert df.select(P.qa_prompt("p", "p", "raw").alias("r")).first()["r"] == "Explain x."
