"""SQL fragments for the DuckDB oracle, twins of the Column helpers."""

from __future__ import annotations

from ..functions.text import WORD, WS


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def bucket(expr: str, n) -> str:
    return f"(('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8))::BIGINT % {n})"


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{WORD}')"


def str_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def qa_pairs() -> str:
    return """
    SELECT conv_id, turn, question, answer FROM (
        SELECT conv_id, turn, role, text AS question,
               lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
               lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) n
    WHERE role = 'user' AND next_role = 'assistant'"""


def vocab() -> str:
    return """
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / nrm) AS v
    FROM (SELECT vec_id, embedding,
                 sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS nrm
          FROM embeddings) e"""


VOCABULARY = "(SELECT max(vec_id) + 1 FROM embeddings)"


def greedy(src: str, keys: list[str], pred: str, ref: str, buckets: str = VOCABULARY) -> str:
    """SQL greedy match over CTE/table ``src``; returns keys + precision, recall, f1."""
    k = ", ".join(keys)
    kt = ", ".join(f"t.{c}" for c in keys)
    on = " AND ".join(f"p.{c} IS NOT DISTINCT FROM r.{c}" for c in keys)
    using = " AND ".join(f"s.{c} IS NOT DISTINCT FROM x.{c}" for c in keys)

    def side(col: str) -> str:
        return f"""
        SELECT {kt}, t.pos, v.v FROM (
            SELECT {k}, unnest(toks) AS tok, unnest(range(len(toks))) AS pos
            FROM (SELECT {k}, {tokens(col)} AS toks FROM {src})) t
        JOIN ({vocab()}) v ON v.vec_id = {bucket('t.tok', buckets)}"""

    def best(a: str, b: str, name: str) -> str:
        return f"""
        SELECT {', '.join('p.' + c for c in keys)}, avg(best) AS {name} FROM (
            SELECT {', '.join('p.' + c for c in keys)}, p.pos, max(list_inner_product(p.v, r.v)) AS best
            FROM ({a}) p JOIN ({b}) r ON {on}
            GROUP BY ALL) p GROUP BY ALL"""

    pside, rside = side(pred), side(ref)
    return f"""
    SELECT {', '.join('s.' + c for c in keys)},
           coalesce(x.precision, 0.0) AS precision, coalesce(y.recall, 0.0) AS recall
    FROM (SELECT DISTINCT {k} FROM {src}) s
    LEFT JOIN ({best(pside, rside, 'precision')}) x ON {using}
    LEFT JOIN ({best(rside, pside, 'recall')}) y ON {using.replace('x.', 'y.')}"""


def f1(p: str = "precision", r: str = "recall") -> str:
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"


def keep_lines(expr: str) -> str:
    """SQL twin of ``keep_code_lines``."""
    return (f"array_to_string(list_filter(string_split({expr}, chr(10)), lambda l: starts_with(l, chr(9))"
            f" OR starts_with(l, ' ') OR starts_with(l, 'def ') OR starts_with(l, 'class ')), chr(10))")
