"""Python steps work on bounded pieces of text, whatever an Arrow batch holds."""

import ast

import pyarrow as pa
from pyspark.sql import functions as F

from codequarry.operators import generate as G
from codequarry.operators import infer as I
from codequarry.operators import rewrite as RW
from codequarry.operators.util import pieces


def codes_batch(n, words):
    codes = [f"def f_{i}(a, b):\n" + "    assert 'word'\n" * words + "    return a\n" for i in range(n)]
    return pa.RecordBatch.from_pydict({"code_key": [f"k{i}" for i in range(n)], "code": codes})


def test_pieces_hold_every_row_once_and_few_bytes():
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4, 5], "a": ["x" * 10, None, "y" * 90, "", "z"],
                                        "b": pa.array([["u", None], [], None, ["v" * 20], ["w"]], pa.list_(pa.string()))})
    got = list(pieces(iter([batch, batch.slice(0, 0), batch.slice(3)]), 25))
    assert [p.column("id").to_pylist() for p in got] == [[1, 2], [3], [4, 5], [4, 5]]


def test_rewrites_leave_in_pieces():
    batch = codes_batch(40, 4000)  # 2.7 MB in one batch: three texts and more are made of it
    out = list(RW._job(1, True, RW.WANTED)(iter([batch])))
    assert len(out) > 2 and max(p.nbytes for p in out) < 5 << 20
    rows = [r for p in out for r in p.to_pylist()]
    assert [r["code_key"] for r in rows] == batch.column("code_key").to_pylist()
    assert rows[7] == {"code_key": "k7", **RW.rewrite_code(batch.column("code")[7].as_py(), "k7", 1)}


def test_ordinals_leave_in_pieces():
    batch = codes_batch(40, 4000)
    out = list(RW._ordinal_job(iter([batch])))
    assert len(out) > 2 and sum(p.num_rows for p in out) == 40
    assert out[0].to_pylist()[0]["renamed"] == RW.rename_ordinal(batch.column("code")[0].as_py())[0]


def test_a_code_is_compiled_only_where_a_rewrite_does_not(monkeypatch):
    seen = []
    monkeypatch.setattr(RW, "_runs", lambda code, run=RW._runs: seen.append(code) or run(code))
    code = "def f(a):\n    'doc'\n    return a  # x\n"
    assert RW.rewrite_code(code, "k", 1)["ok"] and code not in seen and len(seen) == 3
    broken = "def f(a):\n    'doc'\n    return a\nreturn f\n"  # parses, but is no program: its rewrites stand
    assert RW.rewrite_code(broken, "k", 1)["ok"] and broken in seen


def test_nodes_in_order_is_depth_first():
    tree = ast.parse("def f(a, *b, c=1, **d):\n    x = [a for a in b if not c]\n    return -x < 3 and d[x:]\n")
    def walk(node):
        yield node
        for child in ast.iter_child_nodes(node):
            yield from walk(child)
    parts = [n for n in RW.nodes_in_order(tree) if n._fields]
    assert parts == [n for n in walk(tree) if n._fields]


def python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("InArrow ") + \
        df._jdf.queryExecution().executedPlan().toString().count("InPandas ")


def test_all_turns_of_a_conversation_run_in_one_python_step(spark):
    codes = spark.createDataFrame([(1, "x = 1"), (2, None), (3, "")], "code_id bigint, code string")
    follow = G.generate_followups(codes, I.seeded_hash_completer)
    assert python_steps(follow) == 1
    rows = {(r["code_id"], r["category"], r["q_no"]): (r["question"], r["answer"]) for r in follow.collect()}
    assert all((q is None and a is None) == (k[0] == 2) for k, (q, a) in rows.items()) and len(rows) == len(set(rows))

    from codequarry.operators import fanout as FO
    qa = G.generate_qa(FO.over_categories(codes), I.seeded_hash_completer)
    assert python_steps(qa) == 1
    assert all((r["question"] is None) == (r["code_id"] == 2) for r in qa.collect())


def test_turns_see_the_transcript_and_stop_without_an_answer(spark):
    def factory():
        def run(prompts, n, seeds, config):
            return [[] if "stop" in p else [f"<{len(p)}>"] for p in prompts]
        return run
    df = spark.createDataFrame([(1, "", "ab"), (2, "abc", "ab"), (3, "stop", "ab"), (4, "abc", None)],
                               "id bigint, a string, b string")
    got = I.complete_turns(df, ["id"], [F.col("a"), F.col("b"), F.lit("!")], factory).orderBy("id").collect()
    assert [r["answers"] for r in got] == [[None, "<2>", "<7>"], ["<3>", "<9>", "<14>"], [None] * 3, ["<3>", None, None]]
