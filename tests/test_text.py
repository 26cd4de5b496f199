import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as TX
from codequarry.operators import scoring as S


def one(spark, col, *values, schema=None):
    schema = schema or ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([tuple(values)], schema).select(col.alias("r")).first()["r"]


def test_keep_code_lines(spark):
    text = "Here:\ndef f():\n    x\n\n@dec\nclass A:\n\ty"
    assert one(spark, TX.keep_code_lines("c0"), text) == "def f():\n    x\nclass A:\n\ty"


def test_fix_punctuation(spark):
    assert one(spark, TX.fix_punctuation("c0"), "Hello world . Next one ?") == "Hello world. Next one?"
    assert one(spark, TX.fix_punctuation("c0"), "a - b") == "a-b"


@pytest.mark.parametrize("raw,expected", [('r"""  Doc', "Doc"), ('u"""y', "y"), ("u'''x", "u'''x")])
def test_strip_comment_prefix(spark, raw, expected):
    assert one(spark, TX.strip_comment_prefix("c0"), raw) == expected


def test_strip_token_prefix(spark):
    assert one(spark, TX.strip_token_prefix("c0"), "r  Returns x") == "Returns x"
    assert one(spark, TX.strip_token_prefix("c0"), "read x") == "read x"


def test_strip_docstring(spark):
    code = 'def f():\n    """Doc. x"""\n    return 1'
    assert one(spark, TX.strip_docstring("c0", "c1"), code, "Doc. x") == "def f():\n    return 1"


def test_escape_regex(spark):
    assert one(spark, TX.escape_regex("c0"), "a.b(c)|d\\e") == "a\\.b\\(c\\)\\|d\\\\e"


def test_leak_flag_empty_docstring_counts(spark):
    assert one(spark, TX.leak_flag("c0", "c1"), "abc", "") is True
    assert one(spark, TX.leak_flag("c0", "c1"), "abc", "x") is False


@pytest.mark.parametrize("intent,name", [
    ("sort a list of strings", "sort_a_list"),
    ("count 3 items in list", "f_count"),
    ("print `x` now please", "f_print"),
    ("get the of value", "get_the"),
    ('Convert: "foo" and-bar to int', "convert_foo_andbar"),
    ("¿como ordenar lista", "como_ordenar_lista"),
    ("a 1_0 b c", "f_a"),
    ("5 things", "f"),
    ("", "f"),
    ("   leading   spaces  here now more", "leading_spaces_here_now"),
])
def test_entry_point_name(spark, intent, name):
    assert one(spark, TX.entry_point_name("c0"), intent) == name


def test_rename_head(spark):
    assert one(spark, TX.rename_head("c0", "c1"), "def f_3844801(myList):", "check_items") == \
        "def check_items(myList):"
    assert one(spark, TX.rename_head("c0", "c1"), "no paren", "x") is None


def test_assemble_solution(spark):
    assert one(spark, TX.assemble_solution("c0", "c1", "c2"), "def f(a):\n", "\treturn a", "\n") == \
        "def f(a):\n    return a"


def test_first_sentence(spark):
    assert one(spark, TX.first_sentence("c0"), "  One two. Three.") == "One two."
    assert one(spark, TX.first_sentence("c0"), "no end mark") == "no end mark"


def test_clean_reference(spark):
    assert one(spark, S.clean_reference("c0"), '  say "hi" \n') == "say hi"


def test_whitespace_tokens(spark):
    assert one(spark, F.array_join(TX.whitespace_tokens("c0"), "|"), " a  b\tc\n") == "a|b|c"


def reference_strip(code, doc):
    """The pattern as one regular expression."""
    import re
    return re.sub("\\s*\\w*r?u?(\"\"\"|\"|'|\'\'\')\\s*" + re.escape(doc) + "\\s*(\"\"\"|\"|'|\'\'\')\\s*\n", "\n", code, flags=re.DOTALL)


def test_strip_docstring_equals_one_expression(spark):
    import random
    r = random.Random(1)
    parts = ['"""', '"', "'", "'''", "\n", " ", "    ", "r", "u", "é", "Doc. x", "Doc. x", "Doc. x", "(", "aDoc. x", "\x00", "a a"]
    rows = [("".join(r.choice(parts) for _ in range(r.randrange(24))), r.choice(["Doc. x", "a a", "é", " ", "", "'"]))
            for _ in range(4000)]
    rows += [(q + "Doc. x" + e + "\n\n  y", "Doc. x") for q in ('""', '""""', "''", "  ur'", 'ab """ ') for e in ('"', '"""', "'''", "' ")]
    df = spark.createDataFrame(rows, "c string, d string")
    got = df.select("c", "d", TX.strip_docstring("c", "d").alias("out")).collect()
    assert [x.out for x in got] == [reference_strip(x.c, x.d) for x in got]
    assert sum(x.out != x.c for x in got) > 100


def test_white_space_of_python(spark):
    texts = ["", "  ", "a", " a\u3000b\x85", "\x1c\x1da \u2009b’c–d", "a\u1680\u200ab", "\u200b x", " \ta\nb "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", TX.whitespace_tokens("t").alias("w"), TX.whitespace_token_count("t").alias("n"),
                    TX.strip_ws("t").alias("s")).collect()
    for x in got:
        assert x.w == x.t.split() and x.n == len(x.w) and x.s == x.t.strip(), repr(x.t)
