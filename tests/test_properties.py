"""Text rules by hand-worked tables, and by properties on random strings (hypothesis)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from codequarry.functions import text as TX
from codequarry.operators import rewrite as RW

ALPHABET = st.sampled_from(list("ab xyz.?!\"-`'\t\n_1é¿") + ["in", "of", "to", " - ", "def ", "class "])
TEXTS = st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=5, max_size=5)


def run(spark, col, values):
    df = spark.createDataFrame([(v,) for v in values], "c0 string")
    return [r[0] for r in df.select(col).collect()]


def test_keep_code_lines_by_hand(spark):
    cases = {"def f():\n    return 1\nprint(2)\n": "def f():\n    return 1", "x\n y\n\tz": " y\n\tz",
             "class A:\nclassy\ndefine\ndef g": "class A:\ndef g", "": "", "\n\n": "", "import os": ""}
    assert run(spark, TX.keep_code_lines("c0"), list(cases)) == list(cases.values())


def test_fix_punctuation_by_hand(spark):
    cases = {"Is it ?": "Is it?", "so ! yes": "so! yes", "a . b": "a. b", 'he said " ok': 'he said" ok',
             "well - known": "well-known", "no ?x": "no ?x", "tab\t.": "tab.", "": "", "a  .": "a ."}
    assert run(spark, TX.fix_punctuation("c0"), list(cases)) == list(cases.values())


def test_entry_point_name_by_hand(spark):
    cases = {"sort a list in place": "sort_a_list", "Convert string to int": "convert_string", "hello": "f_hello",
             "": "f", "split `x` by comma": "f_split", "get 3 items": "f_get", "¿cómo abrir archivos grandes?":
             "cómo_abrir_archivos_grandes", "read-only file, please now": "readonly_file_please_now",
             "of to in and": "of_to"}
    assert run(spark, TX.entry_point_name("c0"), list(cases)) == list(cases.values())


@settings(max_examples=25, deadline=None)
@given(TEXTS)
def test_text_rules_hold_their_properties(spark, texts):
    for t, kept in zip(texts, run(spark, TX.keep_code_lines("c0"), texts)):
        lines = kept.split("\n") if kept else []
        assert all(x[:1] in (" ", "\t") or x.startswith(("def ", "class ")) for x in lines)
        rest = iter(t.split("\n"))
        assert all(x in rest for x in lines)  # a subsequence of the text's lines
    fixed = run(spark, TX.fix_punctuation("c0"), texts)
    assert all(" - " not in x and len(x) <= len(t) for t, x in zip(texts, fixed))
    assert not any(x.endswith((" ?", " .", " !")) and not x[:-2].endswith((" ", "\t", "\n")) for x in fixed)
    for name in run(spark, TX.entry_point_name("c0"), texts):
        assert name == name.lower() and not set(name) & set("`'.?!\"- \t\n")


WORDS = st.lists(st.sampled_from(["foo", "bar", "foobar", "x", "_y", "é", " ", ".", "-", "foo_bar"]), max_size=12)


@settings(max_examples=25, deadline=None)
@given(st.lists(WORDS, min_size=5, max_size=5))
def test_substitute_changes_mapped_words_only(spark, lists):
    m = {"foo": "_A1", "bar": "_B2", "x": "_C3"}
    texts = ["|".join(w) for w in lists]  # bars stand between the words
    df = spark.createDataFrame([(t, m) for t in texts], "t string, m map<string,string>")
    got = [r[0] for r in df.select(RW.substitute("t", "m")).collect()]
    assert got == ["|".join(m.get(w, w) for w in words) for words in lists]
