import re
from collections import Counter, defaultdict

from codequarry.llm import exact_dedup as X


def brute(rows):
    """doc rows -> multiset of (doc_id, keep_id, group_size, kept)."""
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, n, i))
    out = Counter()
    for g in groups.values():
        g.sort()
        for k, x in enumerate(g):
            out[(x[4], g[0][4], len(g), k == 0)] += 1
    return out


def by_group(rows):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows)


def test_odd_rows_match_brute_force(spark, odd):
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    got = by_group(X.exact_groups(spark, odd).collect())
    # of rows that repeat both id and text any one may be the kept one, but exactly one is
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items()}


def test_collisions_widen_the_identifier(spark, odd):
    assert X.verified_width(odd.select("doc_id", "text"), bits=1, min_chunk=4, max_chunk=8) > 1
    got = by_group(X.exact_groups(spark, odd, bits=1, min_chunk=4, max_chunk=8).collect())
    assert got == by_group(X.exact_groups(spark, odd).collect())


def test_chunks_rebuild_the_text_and_follow_content(spark):
    t = "".join(f"w{i}" + (". " if i % 7 == 0 else "") for i in range(900))
    df = spark.createDataFrame([(t,), ("xx" + t,), ("",)], "text string")
    a, b, c = [r[0] for r in df.select(X.chunks(X.normalised(df.text))).collect()]
    assert "".join(a) == t.replace(" ", "") and c == []
    assert all(len(x) <= X.MAX_CHUNK for x in a)
    assert len(set(a) & set(b)) >= len(a) - 2  # an edit at the start leaves later chunks alone


def test_stage_keeps_one_row_of_each_group_with_all_columns(spark, odd):
    out = X.deduplicate(spark, odd)
    assert out.columns == odd.columns
    rows = out.collect()
    keys = [re.sub(r"\s", "", r.text or "") for r in rows]
    want = {re.sub(r"\s", "", r.text or "") for r in odd.collect()}
    assert len(keys) == len(set(keys)) and set(keys) == want


def test_empty_table(spark, none):
    assert X.exact_groups(spark, none).count() == 0
    assert X.deduplicate(spark, none).count() == 0


def test_no_python_in_the_plan(spark, corpus):
    plan = X.exact_groups(spark, corpus)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
