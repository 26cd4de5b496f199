from codequarry.functions.hashing import py_alias_name
from codequarry.operators import rewrite as RW


def test_alias_fixture():
    assert py_alias_name(11797, "1", "foo") == "_7ee7315e66613b89"


def test_undocument_function():
    r = RW.rewrite_code('def area(w, h):\n    """Area of a box."""\n    return w * h  # units\n', "k")
    assert r["ok"] and r["undocumented"] == "def area(w, h):\n    return w * h"


def test_undocument_docstring_only_body_gets_pass():
    r = RW.rewrite_code('class Box:\n    """A box."""\n    def m(self):\n        """only doc"""\n', "k")
    assert "def m(self):\n        pass" in r["undocumented"] and '"""' not in r["undocumented"]


def test_module_docstring_kept():
    r = RW.rewrite_code('"""mod"""\nasync def g():\n    """doc"""\n    return 1\n', "k")
    assert r["undocumented"].startswith('"""mod"""') and '"""doc"""' not in r["undocumented"]


def test_rename_keeps_builtins_and_globals():
    code = "LIMIT = 3\ndef outer(xs):\n    n = len(xs)\n    def inner(y):\n        return y + n + LIMIT\n    return inner(xs)\n"
    r = RW.rewrite_code(code, "k")
    out = r["renamed"]
    assert "len(" in out and "LIMIT" in out
    for name in ("outer", "xs", "inner", " n ", "(y)"):
        assert name not in out
    assert {i["name"] for i in r["idents"]} == {"outer", "xs", "n", "inner", "y"}


def test_rename_consistent_vs_compat():
    code = "def fact(n):\n    return 1 if n < 2 else n * fact(n - 1)\n"
    alias = py_alias_name(11797, "k", "fact")
    assert RW.rewrite_code(code, "k")["renamed"].count(alias) == 2
    compat = RW.rewrite_code(code, "k", consistent=False)["renamed"]
    assert compat.count(alias) == 1 and "fact(" in compat


def test_rename_skips_import_names():
    r = RW.rewrite_code("def f(a):\n    import os\n    return os.path.join(a)\n", "k")
    assert "os.path.join" in r["renamed"]


def test_unparsable():
    assert RW.rewrite_code("def a(:", "k")["ok"] is False


def test_substitute_by_hand(spark):
    m = {"foo": "_A1", "bar": "_B2"}
    cases = {"What does foo do with bar and foobar?": "What does _A1 do with _B2 and foobar?",
             "foo_bar foo-bar bar.foo": "foo_bar _A1-_B2 _B2._A1", "": "", "ünïcode foo bar": "ünïcode _A1 _B2",
             "foo": "_A1", " foo\nfoo ": " _A1\n_A1 ", "FOO Bar": "FOO Bar", "éfoo fooé foo2": "éfoo fooé foo2"}
    df = spark.createDataFrame([(t, m) for t in cases], "t string, m map<string,string>")
    got = {r["t"]: r["r"] for r in df.select("t", RW.substitute("t", "m").alias("r")).collect()}
    assert got == cases


ODD_CODES = [
    "def count():\n    total = 0\n    def add(k):\n        nonlocal total\n        total += k\n        return total\n    return add\n",
    "def f(x):\n    try:\n        return 1 / x\n    except ZeroDivisionError as e:\n        print(e)\n        raise\n",
    "def area(width, height=2):\n    return width * height\ndef g():\n    return area(width=3, height=4)\n",
    "def f(x):\n    match x:\n        case [first, *rest]:\n            return first, rest\n        case {'a': b, **more}:\n            return b, more\n        case other:\n            return other\n",
    "SEEN = 0\ndef f():\n    global SEEN\n    SEEN += 1\n    return [y for y in range(SEEN) if (z := y)]\n",
    "class A[T]:\n    def m[U](self, u: U) -> T:\n        return u\n",
    "async def f(xs):\n    import os.path as p\n    async for x in xs:\n        yield p.join(x)\n",
]


def test_renamed_codes_compile_and_behave():
    for code in ODD_CODES:
        r = RW.rewrite_code(code, "k")
        assert r["ok"], code
        for w in RW.WANTED:
            compile(r[w], "<t>", "exec")
    r = RW.rewrite_code(ODD_CODES[0], "k")
    names = {i["name"]: i["alias"] for i in r["idents"]}
    space = {}
    exec(r["renamed"], space)
    add = space[names["count"]]()
    assert (add(2), add(3)) == (2, 5)
    r = RW.rewrite_code(ODD_CODES[2], "k")
    space = {}
    exec(r["renamed"], space)
    assert space[{i["name"]: i["alias"] for i in r["idents"]}["g"]]() == 12


def test_one_odd_code_does_not_end_the_job():
    deep = "x = " + "+".join(["1"] * 6000) + "\n"
    for code in (deep, "x = " + "(" * 400 + ")" * 400, "a\x00b", "def f(a, a): pass\n", "return\n", ""):
        r = RW.rewrite_code(code, "k")
        assert r["ok"] in (True, False) and set(r) == set(RW.FAILED)
        RW.rename_ordinal(code)


def test_only_the_wanted_rewrites_are_made():
    r = RW.rewrite_code("def f(a):\n    'd'\n    return a\n", "k", wanted=("undocumented",))
    assert r["ok"] and r["undocumented"] == "def f(a):\n    return a" and r["renamed"] is None and r["both"] is None


def _variants(spark, rows):
    return spark.createDataFrame(
        rows, "qa_id bigint, original_code string, obfuscated_code string, primary_obfuscation string, "
              "category string, question string, answer string")


def test_fallback_rules(spark):
    good = "def f(a):\n    return a\n"
    rows = [(1, good, "def a(:", "Refactor", "General", "What is a?", "a"),
            (2, "def b(:", "def a(:", "Refactor", "General", "q", "x")]
    g = RW.secondary_grid(_variants(spark, rows), ["qa_id"])
    out = {(r["qa_id"], r["secondary_obfuscation"]): r for r in g.collect()}
    # rewritten code broken, original fine: original's rewrite, error
    assert out[(1, "Undocument")]["error"] and out[(1, "Undocument")]["secondary_obfuscated_code"] == "def f(a):\n    return a"
    assert out[(1, "Rename")]["question"] != "What is a?"
    # both broken: unchanged code, error
    assert out[(2, "Rename")]["error"] and out[(2, "Rename")]["secondary_obfuscated_code"] == "def a(:"
    # level None never errors
    assert not out[(2, "None")]["error"] and out[(2, "None")]["secondary_obfuscated_code"] == "def a(:"
    assert len(out) == 8


def test_a_variant_without_a_completion_falls_back_on_its_original(spark):
    good = "def f(a):\n    'd'\n    return a\n"
    rows = [(1, good, None, "Refactor", "General", "What is a?", "a"),
            (2, "def b(:", None, "Refactor", "General", "q", "x"), (3, None, None, "Refactor", "General", "q", "x"),
            (4, good, good, "None", "General", "q", "x")]
    g = RW.secondary_grid(_variants(spark, rows), ["qa_id"]).collect()
    out = {(r["qa_id"], r["secondary_obfuscation"]): r for r in g}
    assert len(g) == len(out) == 16
    assert all(r["error"] == (r["qa_id"] != 4) for r in g)
    assert out[(1, "None")]["secondary_obfuscated_code"] == good
    assert out[(1, "Undocument")]["secondary_obfuscated_code"] == "def f(a):\n    return a"
    assert out[(1, "Rename")]["question"] != "What is a?"
    assert {out[(2, x)]["secondary_obfuscated_code"] for x in ("None", "Rename")} == {"def b(:"}


def test_ordinal_scheme_renames_everything():
    out, idents = RW.rename_ordinal("def f(a, b):\n    c = len(a) + b\n    return c\n")
    assert out == "def _0(_1, _2):\n    _3 = _4(_1) + _2\n    return _3"
    assert [i["name"] for i in idents] == ["f", "a", "b", "c", "len"]
    assert RW.rename_ordinal("def (:") is None


def test_older_grid(spark):
    recs = spark.createDataFrame(
        [(1, 1, "def f(a):\n    return len(a)\n", "What does f do with a?", "It counts a."),
         (2, 2, "def g(:\n", "q", "a")],
        "qa_id bigint, code_id bigint, code string, question string, answer string")
    rewrites = spark.createDataFrame([(1, "Refactor", "R1"), (1, "Dead Code", "D1")],
                                     "code_id bigint, level string, obfuscated_code string")
    out = {(r["qa_id"], r["obfuscation"]): r for r in RW.older_grid(recs, ["qa_id"], rewrites).collect()}
    assert len(out) == 10
    assert out[(1, "Rename")]["obfuscated_code"] == "def _0(_1):\n    return _2(_1)"
    assert out[(1, "Rename")]["question"] == "What does _0 do with _1?"
    assert out[(1, "Undocument")]["obfuscated_code"] == "def f(a):\n    return len(a)"
    assert out[(1, "Refactor")]["obfuscated_code"] == "R1" and out[(1, "None")]["question"] == "What does f do with a?"
    assert out[(2, "Rename")]["error"] and out[(2, "Rename")]["obfuscated_code"] == "def g(:\n"
    assert not out[(2, "None")]["error"]
