from collections import defaultdict

from codequarry.llm import mixing as M


def water_fill(sizes, weights=(5, 2, 1), most=3):
    """The contract's targets by plain repetition: share, cap, share the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, free, target = sum(sizes.values()), set(order), {}
    while free:
        left = total - sum(target.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) >= most * sizes[s]]
        if not over:
            target.update({s: left * w[s] / sum(w[x] for x in free) for s in free})
            break
        for s in over:
            target[s] = most * sizes[s]
            free.discard(s)
    return target


def test_targets_and_budgets(spark, odd):
    rows = M.mixed(spark, odd, {"doc_id": odd.doc_id, "source": odd.source}).collect()
    size = defaultdict(int)
    taken = defaultdict(int)
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = water_fill(size)
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in size)


def test_targets_match_repeated_sharing_on_many_shapes(spark):
    import random
    rng = random.Random(4)
    for n in (1, 2, 3, 7, 12):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 5, 40, 900]) for i in range(n)}
        df = spark.createDataFrame([(False, s, v) for s, v in sizes.items()],
                                   "no_source boolean, src string, source_size long")
        want = water_fill(sizes)
        for r in M.targets(df).collect():
            assert abs(r.target - want[r.src]) < 1e-6, (sizes, r)


def test_the_mix_itself_has_the_words_it_claims(spark, odd):
    out = M.mix(spark, odd)
    assert out.columns == odd.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    claimed = sum(r.taken for r in M.mixed(spark, odd, {"doc_id": odd.doc_id}).collect())
    assert words == claimed
    originals = {}
    for r in odd.collect():
        originals.setdefault(r.doc_id, set()).add(r.text or "")
    for r in out.collect():
        assert any(t.startswith(r.text or "") for t in originals[r.doc_id])


def test_reruns_and_partitions_agree(spark, odd):
    key = lambda rows: sorted(map(str, rows))
    a = M.mixed(spark, odd, {"doc_id": odd.doc_id}).collect()
    b = M.mixed(spark, odd.repartition(7), {"doc_id": odd.doc_id}).collect()
    assert key(a) == key(b)


def plain_cut(rows, goal):
    """{doc_id: words taken}, summed over repeats: whole epochs, then the keys in order up to the budget."""
    taken = defaultdict(int)
    for source, target in goal.items():
        mine = sorted((r for r in rows if r.source == source), key=lambda r: r.key)
        size = sum(r.size for r in mine)
        budget = int(target + 0.5)
        rest = budget % size if size else 0
        for r in mine:
            extra = min(r.size, rest)
            rest -= extra
            taken[r.doc_id] += (budget // size if size else 0) * r.size + extra
    return dict(taken)


def test_cut_in_small_ranges_with_rows_that_repeat(spark, odd, corpus, monkeypatch):
    """Every row of a source in few ranges; then a row that repeats many times and lies on the cut."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(M, "MIN_RANGES", 2)
    monkeypatch.setattr(M, "RANGE_ROWS", 3)
    part = corpus.filter("doc_id < 400").select("doc_id", "source", "text")
    hot = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a").alias("source"),
                                  F.lit("one two three four five").alias("text"))
    rare = spark.range(2).select((F.col("id") + 9000).alias("doc_id"), F.lit("b").alias("source"),
                                 F.lit("some other words").alias("text"))
    for docs in (part, odd.select("doc_id", "source", "text"), hot.unionByName(rare), hot.unionByName(part)):
        keyed = docs.select("doc_id", "source", M.word_count(F.col("text")).alias("size"),
                            M.mix_key(F.col("doc_id"), F.col("text")).alias("key")).collect()
        rows = M.mixed(spark, docs, {"doc_id": docs.doc_id, "source": docs.source}).collect()
        assert len(rows) == len(keyed)
        got = defaultdict(int)
        for r in rows:
            got[r.doc_id] += r.taken
            assert 0 <= r.taken <= 3 * r.size and r.taken == r.epochs * r.size + r.extra
        assert dict(got) == plain_cut(keyed, {r.source: r.target for r in rows})


def test_mix_of_rows_that_repeat_on_the_cut(spark):
    from pyspark.sql import functions as F
    docs = spark.range(40).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a").alias("source"),
                                  F.lit("one two three four five six seven").alias("text"))
    docs = docs.unionByName(spark.range(60).select(F.lit(2).cast("long"), F.lit("b"), F.lit("u v w")).toDF(*docs.columns))
    claimed = sum(r.taken for r in M.mixed(spark, docs, {"doc_id": docs.doc_id}).collect())
    assert sum(len(r.text.split()) for r in M.mix(spark, docs).collect()) == claimed


def test_no_text_is_shuffled(spark, corpus):
    from pyspark.sql import functions as F
    plan = M.mixed(spark, corpus, {"_row": F.struct("doc_id", "text")})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_empty_table(spark, none):
    assert M.mixed(spark, none, {"doc_id": none.doc_id}).count() == 0 and M.mix(spark, none).count() == 0
