"""Text cleaning as Column expressions (JVM-side, no Python per row).

Regex notes: Python's ``\\s``/``\\w`` are Unicode; Java's need ``(?U)``.
``strip_ws`` spells Python's white space out so that the same pattern means
the same thing in Spark (Java) and in the DuckDB oracle (RE2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import catalog

# FIXED VALUE: the white space of Python strings, spelled so that Java and RE2 read it alike.
WS = ("[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}"
      "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # FIXED VALUE: ASCII punctuation set


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                            0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_COMMON = "[\\x09-\\x0D\\x1C-\\x20]"           # white space in ASCII: one bit table
_MAY_BE_RARE = "[\\x85\\xA0\\x{1680}-\\x{3000}]"  # holds all other white space


def strip_ws(col) -> Column:
    """Python ``str.strip()``."""
    return F.btrim(_c(col), F.lit(_SPACES))


def _by_space(col: Column, fn) -> Column:
    """``fn(class of white space)``; a text without rare white space gets the short class, which is tested faster."""
    return F.when(col.rlike(_MAY_BE_RARE), fn(WS)).otherwise(fn(_COMMON))


# --- docstring cleaning ------------------------------------------------------

def escape_regex(col) -> Column:
    """Backslash-escape the 14 regex metacharacters ``\\ . + * ? ^ $ ( ) [ ] { } |``."""
    return F.regexp_replace(_c(col), r"([\\.+*?^$()\[\]{}|])", r"\\$1")


# FIXED VALUE: the quote forms around a docstring, in the order in which they are tried.
_QUOTES = "(?:\"\"\"|\"|'|\'\'\')"
_MARK = "\x00"


def docstring_literal(doc) -> Column:
    """Row-specific pattern: a quote form, the docstring, a quote form and the line end; DOTALL."""
    return F.concat(F.lit(f"(?sU){_QUOTES}\\s*"), escape_regex(doc), F.lit(f"\\s*{_QUOTES}\\s*\\n"))


def strip_docstring(code, doc) -> Column:
    """Remove the docstring literal from the code (every match -> newline).

    A match is ``\\s*\\w*`` (indentation and prefix letters), a quote form,
    the docstring, a quote form, space and a newline.  Only the quotes can
    begin it by search: a code without the docstring is left as it is, a
    match is marked from its quotes on, and the word and the space before
    each mark are then cut off backwards, from the mark.
    """
    c, d = _c(code), _c(doc)
    parts = F.split(F.regexp_replace(c, docstring_literal(d), F.lit(_MARK)), _MARK, -1)
    before = lambda x: F.reverse(F.regexp_replace(F.reverse(x), "(?U)\\A\\w*\\s*", ""))
    # in an array of one, the parts are bound once and not made again for each use
    joined = F.get(F.transform(F.array(parts), lambda ps: F.array_join(F.concat(
        F.transform(F.slice(ps, F.lit(1), F.size(ps) - 1), before), F.slice(ps, F.lit(-1), F.lit(1))), "\n")), 0)
    # a code that holds the mark itself is searched for the whole pattern
    whole = F.regexp_replace(c, F.concat(F.lit("(?sU)\\s*\\w*"), F.substring(docstring_literal(d), 6, 1 << 30)), F.lit("\n"))
    return (F.when(~F.contains(c, d), c).when(F.contains(c, F.lit(_MARK)), whole)
             .otherwise(joined))


def strip_comment_prefix(doc) -> Column:
    """Drop a leading r\"\"\" / r''' / u\"\"\" (first match only) and left-trim."""
    return F.regexp_replace(_c(doc), "^(?:r\"\"\"|r'''|u\"\"\")(?U)\\s*", "")


def strip_token_prefix(doc) -> Column:
    """Drop a tokenised 'r ' / 'u ' start and left-trim."""
    return F.regexp_replace(_c(doc), "^[ru] (?U)\\s*", "")


def join_tokens(tokens) -> Column:
    return F.array_join(_c(tokens), " ")


def fix_punctuation(text) -> Column:
    """Remove the space before ? . ! \" when followed by space/end; ' - ' -> '-'."""
    t = F.regexp_replace(_c(text), "(?U)\\s([?.!\"](?:\\s|$))", "$1")
    return F.replace(t, F.lit(" - "), F.lit("-"))


def leak_flag(code, doc) -> Column:
    """True when the docstring is still a substring of the code ('' counts)."""
    return F.contains(_c(code), _c(doc))


# --- entry-point naming ------------------------------------------------------

# Python float() accepts digits with '_' separators, exponents, nan/inf.
_NUMERIC = ("^[+-]?(?:(?:\\d(?:_?\\d)*(?:\\.(?:\\d(?:_?\\d)*)?)?|\\.\\d(?:_?\\d)*)"
            "(?:e[+-]?\\d(?:_?\\d)*)?|nan|inf|infinity)$")


def entry_point_name(intent, first_nwords: int = catalog.ENTRY_FIRST_NWORDS,
                     stop_words=None, delimiters=None) -> Column:
    """Function name from the first words of an intent, as array expressions.

    lower-case first n words; cut at the first numeric word; cut at a stop
    word with index > 1; cut at a word starting with a delimiter; drop ASCII
    punctuation and empty words; prefix 'f' when fewer than two words;
    drop a leading inverted question mark; join with '_'.
    """
    stop = stop_words if stop_words is not None else catalog.ENTRY_STOP_WORDS
    delims = delimiters if delimiters is not None else catalog.ENTRY_DELIMITERS
    # one anchored match takes the first words; the rest of the text is never split
    lead = F.regexp_extract(_c(intent), f"(?U)\\A\\s*(\\S+(?:\\s+\\S+){{0,{first_nwords - 1}}})", 1)
    first = F.split(lead, "(?U)\\s+")
    words = F.transform(F.filter(first, lambda w: w != ""), lambda w: F.lower(w))

    # The three cuts are prefix cuts on the same indices, so they compose to
    # one cut at the first word meeting any of them (one pass, no nesting).
    stop_arr = F.array(*[F.lit(s) for s in stop])

    def cuts_here(w: Column, i: Column) -> Column:
        delim = F.lit(False)
        for d in delims:
            delim = delim | w.startswith(d)
        return w.rlike(_NUMERIC) | ((i > 1) & F.array_contains(stop_arr, w)) | delim

    pos = F.array_position(F.transform(words, cuts_here), True)
    kept = F.slice(words, 1, F.when(pos == 0, F.size(words)).otherwise(pos - 1).cast("int"))
    w4 = F.filter(F.transform(kept, lambda w: F.translate(w, _PUNCT, "")), lambda w: w != "")
    w5 = F.concat(F.when(F.size(w4) < 2, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>")), w4)
    w6 = F.transform(w5, lambda w, i: F.when((i == 0) & w.startswith("¿"), F.substring(w, 2, 1 << 30))
                     .otherwise(w))
    return F.array_join(w6, "_")


def head_from_paren(head) -> Column:
    """Text of ``head`` from its first '(' (NULL when absent)."""
    h = _c(head)
    pos = F.locate("(", h)
    return F.when(pos > 0, h.substr(pos, F.length(h) - pos + 1))


def rename_head(head, name) -> Column:
    """'def <name>(args...' from a function head (NULL when it has no '(')."""
    return F.concat(F.lit("def "), _c(name), head_from_paren(head))


def assemble_solution(head, solution, suffix) -> Column:
    """head + solution + suffix, tabs -> 4 spaces, stripped."""
    return strip_ws(F.replace(F.concat(_c(head), _c(solution), _c(suffix)), F.lit("\t"), F.lit("    ")))


# --- sentences and code lines ------------------------------------------------

def first_sentence(text) -> Column:
    """Shortest leading span ending in . ! or ? before whitespace/end; else all."""
    s = F.regexp_extract(_c(text), f"(?s)^{WS}*(.*?[.!?])(?:{WS}|$)", 1)
    return F.when(s == "", strip_ws(text)).otherwise(s)


def keep_code_lines(text) -> Column:
    """Keep lines that start with a tab, a space, 'def ' or 'class '."""
    lines = F.split(_c(text), "\n", -1)
    kept = F.filter(lines, lambda l: l.startswith("\t") | l.startswith(" ")
                    | l.startswith("def ") | l.startswith("class "))
    return F.array_join(kept, "\n")


WORD = "[\\p{L}\\p{N}]+"  # letters and digits of every script; Java and RE2 read it alike


def word_tokens(text) -> Column:
    """Lower-case word tokens, runs of letters and digits of any script (same in Spark and DuckDB)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD), 0)


def ascii_words(text) -> Column:
    """Lower-case ASCII words: usable in identifiers."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+"), 0)


def whitespace_tokens(text) -> Column:
    """Python ``str.split()`` tokens."""
    t = strip_ws(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(_by_space(t, lambda ws: F.split(t, f"{ws}+")))


def whitespace_token_count(text) -> Column:
    """Length of Python's ``str.split()``."""
    t = _c(text)
    return _by_space(t, lambda ws: F.regexp_count(t, F.lit(f"[^{ws[1:]}+")))


def first_ascii_words(text, n: int) -> Column:
    """The first ``n`` of :func:`ascii_words` (NULL where there are fewer), read from the head of the text alone."""
    low = F.lower(_c(text))
    gap, word = "[^a-z0-9]", "([a-z0-9]++)"
    head = f"\\A{gap}*+{word}" + f"(?:{gap}++{word})?+" * (n - 1)
    return F.array(*[F.nullif(F.regexp_extract(low, head, i + 1), F.lit("")) for i in range(n)])
