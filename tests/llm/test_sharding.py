import itertools
import zlib
from collections import Counter

import pyspark.sql.functions as F

from codequarry.llm import sharding as S


def fewest_moved(supply, room):
    """Bytes that must move, by trying every way (tiny networks)."""
    best = None
    cells = [(i, j) for i in range(len(supply)) for j in range(len(room))]

    def go(k, left, free, moved):
        nonlocal best
        if best is not None and moved >= best:
            return
        if k == len(cells):
            if not any(left):
                best = moved
            return
        i, j = cells[k]
        for f in range(min(left[i], free[j]) + 1):
            go(k + 1, [x - f * (n == i) for n, x in enumerate(left)],
               [x - f * (n == j) for n, x in enumerate(free)], moved + f * (i != j))

    go(0, list(supply), list(room), 0)
    return best


def test_flow_moves_the_fewest_bytes():
    for supply in itertools.product(range(4), repeat=2):
        for room in itertools.product(range(4), repeat=3):
            if sum(room) < sum(supply):
                continue
            got = S.transfers(list(supply), list(room))
            assert sum(f for i, j, f in got if i != j) == fewest_moved(supply, room), (supply, room, got)
            for i, b in enumerate(supply):
                assert sum(f for x, _, f in got if x == i) == b
            for j, c in enumerate(room):
                assert sum(f for _, y, f in got if y == j) <= c


def test_network_solver_prefers_the_cheap_way_round():
    g = S.FlowNetwork(4)
    a, b = g.arc(0, 1, 3, 5), g.arc(0, 2, 2, 1)
    g.arc(1, 3, 4, 0), g.arc(2, 3, 4, 0)
    c = g.arc(2, 1, 1, 1)
    assert g.solve(0, 3) == 5 * 3 + 1 * 2 and (g.flow_on(a), g.flow_on(b), g.flow_on(c)) == (3, 2, 0)


def test_level_room_fills_the_lowest_first():
    assert S.level_room(10, [0, 4, 9]) == [7, 3, 0]
    assert sum(S.level_room(11, [0, 0, 50])) == 11
    assert S.level_room(0, [0, 0]) == [0, 0]


def test_large_rows_move_the_fewest_bytes():
    for counts in itertools.product(range(7), repeat=3):
        large = [(i, f"{'abc'[i]}{k}", 10) for i, c in enumerate(counts) for k in range(c)]
        if not large or len(large) % 3:
            continue
        placed = S.place_large(large, [10 * c for c in counts], 3)
        load = Counter(j for j, _ in placed.values())
        assert len(placed) == len(large) and set(load.values()) == {len(large) // 3}
        moved = sum(1 for (i, _, _), (j, _) in placed.items() if i != j)
        assert moved == sum(max(0, c - len(large) // 3) for c in counts), (counts, placed)


def test_a_row_beyond_a_share_keeps_its_shard_and_large_rows_level_the_others():
    large = [(1, "huge", 1000), (0, "a", 10), (0, "b", 10), (0, "c", 10), (2, "d", 10)]
    placed = S.place_large(large, [30, 1000, 10], 3)
    assert placed[(1, "huge", 1)] == (1, 1000) and placed[(2, "d", 1)] == (2, 10)
    assert Counter(j for j, _ in placed.values()) == {0: 2, 1: 1, 2: 2}
    assert {j for j, _ in S.place_large([(0, "x", 100), (0, "x", 100), (0, "y", 90)], [290], 3).values()} == {0, 1, 2}


def test_transfers_list_large_rows(spark):
    df = spark.createDataFrame([(i, "x" * 92, i % 2 if i < 6 else 0) for i in range(9)], "doc_id long, text string, o int")
    r = S.reshard(spark, df, "o", 3)
    rows = r.rows(F.col("_row.o").alias("o")).collect()
    assert sorted(r.transfers) == sorted((i, j, 100 * n) for (i, j), n in Counter((x.o, x.shard) for x in rows).items())
    assert sum(f for i, j, f in r.transfers if i != j) == 300 and r.untouched == [1]


def resharded(spark, odd, n):
    old = odd.withColumn("o", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)).cast("int"))
    r = S.reshard(spark, old, "o", n)
    return r, r.rows(F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"))


def test_every_row_once_slots_gapless(spark, odd):
    r, rows = resharded(spark, odd, 5)
    rows = rows.collect()
    assert Counter((x.doc_id, x.text) for x in rows) == Counter((x.doc_id, x.text) for x in odd.collect())
    for s in {x.shard for x in rows}:
        slots = sorted(x.slot for x in rows if x.shard == s)
        assert slots == list(range(len(slots))) and 0 <= s < 5
    assert spark.read.parquet(r.path).count() == len(rows)  # rewritten files hold them all


def test_sizes_are_near_equal(spark, corpus):
    old = corpus.withColumn("o", F.pmod("doc_id", F.lit(4)).cast("int"))
    rows = S.reshard(spark, old, "o", 8).rows(S.row_size(F.col("_row.text")).alias("b")).collect()
    load = Counter()
    for x in rows:
        load[x.shard] += x.b
    mean = sum(load.values()) / 8
    assert len(load) == 8 and max(abs(v - mean) for v in load.values()) <= mean / 20


def test_shards_without_a_transfer_stay_where_they_are(spark):
    df = spark.createDataFrame([(i, "x" * 92, i % 2) for i in range(40)], "doc_id long, text string, o int")
    r = S.reshard(spark, df, "o", 2)
    rows = r.rows(F.col("_row.o").alias("o")).collect()
    assert r.untouched == [0, 1] and all(x.o == x.shard for x in rows)


def test_query_digests_by_file(spark, corpus):
    got = {x.doc_id: x for x in S.op4(spark, "/root/testdata/sf0.001").collect()}
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        x = got.pop(d.doc_id)
        b = d.text.encode()
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(b) + 8, zlib.crc32(b), "bytes", None)
    assert not got


def test_files_of_one_name_in_different_folders_are_different_shards(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, "x")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"part={k}"))
        made = next((tmp_path / f"part={k}").glob("*.parquet"))
        (made.parent / "a.parquet").write_bytes(made.read_bytes())
        made.unlink()
    rows = S.by_file(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r[S.OLD]) for r in rows) == [(0, 0), (1, 1), (2, 2)]


def test_uneven_old_layout_makes_the_flow_move_as_little_as_it_can(spark, corpus):
    old = S.dealt(corpus).select(S.OLD, S.row_size(F.col("text")).alias("b"))
    sizes = {r[S.OLD]: r["b"] for r in old.groupBy(S.OLD).agg(F.sum("b").alias("b")).collect()}
    assert set(sizes) == set(range(S.N_OLD)) and sizes[0] > 3 * sizes[S.N_OLD - 1]
    r = S.reshard(spark, S.dealt(corpus), S.OLD, 24)
    mean = sum(sizes.values()) / 24
    least = sum(max(0, b - mean) for b in sizes.values())
    moved = sum(f for i, j, f in r.transfers if i != j)
    assert least * 0.99 <= moved <= least * 1.05
    assert sum(f for _, _, f in r.transfers) == sum(sizes.values())


def test_empty_table(spark, none):
    r = S.reshard(spark, none.withColumn("o", F.lit(0)), "o", 3)
    assert r.rows(F.col("_row.doc_id").alias("d")).count() == 0
