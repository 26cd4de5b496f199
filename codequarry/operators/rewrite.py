"""Secondary (parser-based) rewrites: undocument, rename, both; with the
syntax fallback and question/answer renaming.

Spark plan: variant rows are reduced to distinct code texts (md5 key), one
``mapInArrow`` job parses each distinct code once and returns all three
rewrites plus its identifier table, and the rest is native: the fallback
decision (rewritten code -> original -> unchanged) is a CASE over two joins
against the per-code results, the alias map is built from the identifier
rows, and question/answer renaming is a per-row run mapping.

The Python helper is small and per code: bindings are read once from the
symbol tables, a table name -> alias is settled from them, and one pass over
the tree applies it; any failure of one code is that code's fallback.
"""

from __future__ import annotations

import ast
import symtable
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing as H
from ..plans import catalog
from ..session import persisted, ship_package
from . import fanout as FO
from .util import distinct_by_key, join_on_key, pieces

DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


# --- per-code helpers (run inside the Arrow job) ----------------------------------

def undocument_tree(tree: ast.AST | list) -> list[tuple[ast.AST, list]]:
    """Drop the leading string statement of every function/class body (of a tree or its nodes).

    A body left empty gets ``pass`` (an empty body would print invalid
    code).  Returns the changed nodes with the bodies they had.
    """
    changed = []
    for node in nodes_in_order(tree):
        if not isinstance(node, DEFS) or not node.body:
            continue
        first = node.body[0]
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) \
                and isinstance(first.value.value, str):
            changed.append((node, node.body))
            node.body = node.body[1:] or [ast.Pass()]
    return changed


# The fields of each node type that hold an identifier of some scope.
IDENTIFIERS = {"arg": "arg", "Name": "id", "FunctionDef": "name", "AsyncFunctionDef": "name", "ClassDef": "name",
               "ExceptHandler": "name", "MatchAs": "name", "MatchStar": "name", "MatchMapping": "rest",
               "Global": "names", "Nonlocal": "names", "TypeVar": "name", "ParamSpec": "name", "TypeVarTuple": "name"}


@dataclass(frozen=True)
class Bindings:
    """How a code binds each name, read once from its symbol tables."""

    imported: frozenset[str]
    defined: frozenset[str]      # functions and classes
    outer: frozenset[str]        # resolved in the module or beyond it by some scope
    keywords: frozenset[str]     # parameter names that calls to the code's own functions may spell out


def nodes_in_order(tree: ast.AST | list) -> Iterator[ast.AST]:
    """Depth-first, parents before children, without recursion; a list of nodes made so before is taken as it is."""
    if isinstance(tree, list):
        yield from tree
        return
    todo = [tree]
    while todo:
        node = todo.pop()
        yield node
        for name in reversed(node._fields):
            value = getattr(node, name, None)
            if isinstance(value, list):
                todo.extend(x for x in reversed(value) if isinstance(x, ast.AST))
            elif isinstance(value, ast.AST) and value._fields:  # no contexts or operators: they have no parts
                todo.append(value)


def bindings(code: str, tree: ast.AST | list) -> Bindings:
    imported, defined, stored, used, keywords = set(), set(), set(), set(), set()
    for node in nodes_in_order(tree):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            imported.update((a.asname or a.name).partition(".")[0] for a in node.names)
        elif isinstance(node, DEFS):
            defined.add(node.name)
            if not isinstance(node, ast.ClassDef):
                keywords.update(a.arg for a in (*node.args.args, *node.args.kwonlyargs))
        elif isinstance(node, ast.Name):
            (used if isinstance(node.ctx, ast.Load) else stored).add(node.id)
        elif isinstance(node, ast.arg):
            stored.add(node.arg)
    try:
        scopes = [symtable.symtable(code, "<code>", "exec")]
        outer = set(scopes[0].get_identifiers())
        for scope in scopes:  # grows while it is read: every nested scope
            scopes.extend(scope.get_children())
            outer.update(x.get_name() for x in scope.get_symbols() if x.is_global())
    except (SyntaxError, ValueError):
        # parseable, but no program (a repeated argument name): what nothing binds lies outside
        outer = used - stored - defined
    return Bindings(frozenset(imported), frozenset(defined), frozenset(outer), frozenset(keywords))


def renames(tree: ast.AST | list, known: Bindings, alias, consistent: bool) -> dict[str, tuple[str, bool, int]]:
    """name -> (alias, first met as a definition, place), in order of first meeting.

    Kept: imported names, and outer names that the code does not define itself.  With
    ``consistent`` off, uses of a function or class that lies in the module keep its name.
    """
    table: dict[str, tuple[str, bool, int]] = {}
    for node in nodes_in_order(tree):
        kind = type(node).__name__
        if kind not in IDENTIFIERS:
            continue
        found = getattr(node, IDENTIFIERS[kind])
        for name in found if isinstance(found, list) else [found]:
            if name is None or name in known.imported or name in table:
                continue
            is_def = isinstance(node, DEFS)
            if is_def or name not in known.outer or (consistent and name in known.defined):
                table[name] = (alias(name), is_def, len(table))
    return table


def apply_renames(tree: ast.AST | list, table: dict, known: Bindings, consistent: bool) -> None:
    """Every identifier in ``table`` becomes its alias, in place."""
    def new(name, is_def=False):
        if name not in table or not (consistent or is_def or name not in known.outer):
            return name
        return table[name][0]

    for node in nodes_in_order(tree):
        kind = type(node).__name__
        if kind in IDENTIFIERS:
            field = IDENTIFIERS[kind]
            found = getattr(node, field)
            value = [new(x) for x in found] if isinstance(found, list) else new(found, isinstance(node, DEFS))
            setattr(node, field, value)
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in known.defined:
            for k in node.keywords:
                if k.arg in known.keywords:
                    k.arg = new(k.arg)


def _idents(table: dict) -> list[dict]:
    return [{"name": n, "alias": a, "is_def": d, "first_pos": p} for n, (a, d, p) in table.items()]


def _runs(code: str) -> bool:
    try:
        compile(code, "<code>", "exec", dont_inherit=True)
        return True
    except (SyntaxError, ValueError):
        return False


def rename_ordinal(code: str) -> tuple[str, list] | None:
    """Older scheme: every name (arguments, names, definitions, builtins
    included) becomes ``_<n>`` in first-visit order; None when that fails."""
    try:
        tree = ast.parse(code)
        everything = Bindings(*[frozenset()] * 4)
        seen: dict[str, int] = {}
        nodes = list(nodes_in_order(tree))
        table = renames(nodes, everything, lambda name: f"_{seen.setdefault(name, len(seen))}", True)
        known = bindings(code, nodes)
        apply_renames(nodes, table, known, True)
        return ast.unparse(tree), _idents(table)
    except Exception:  # noqa: BLE001 - one odd code must not end the job
        return None


WANTED = ("undocumented", "renamed", "both")
FAILED = {"ok": False, "undocumented": None, "renamed": None, "both": None, "idents": []}


def rewrite_code(code: str, code_key: str, seed: int = catalog.DEFAULT_SEED, consistent: bool = True,
                 wanted: Sequence[str] = WANTED) -> dict:
    """The ``wanted`` secondary rewrites of one code, parsed once.

    ok=False when the code does not parse, is too deep to print, or a rewrite
    of a code that compiles would not compile itself.
    """
    try:
        tree = ast.parse(code)
        nodes = list(nodes_in_order(tree))
        known = bindings(code, nodes)
        out = dict(FAILED, ok=True)
        if "undocumented" in wanted:
            dropped = undocument_tree(nodes)
            out["undocumented"] = ast.unparse(tree)
            for node, body in dropped:
                node.body = body
        table = renames(nodes, known, lambda name: H.py_alias_name(seed, code_key, name), consistent)
        out["idents"] = _idents(table)
        if "renamed" in wanted or "both" in wanted:
            apply_renames(nodes, table, known, consistent)
            out["renamed"] = ast.unparse(tree) if "renamed" in wanted else None
        if "both" in wanted:
            undocument_tree(nodes)
            out["both"] = ast.unparse(tree)
        if not all(_runs(out[w]) for w in wanted) and _runs(code):
            return dict(FAILED)
        return out
    except Exception:  # noqa: BLE001 - syntax, null bytes, recursion: the fallback applies
        return dict(FAILED)


# --- the Spark job ----------------------------------------------------------------

IDENT = T.StructType([T.StructField("name", T.StringType()), T.StructField("alias", T.StringType()),
                      T.StructField("is_def", T.BooleanType()), T.StructField("first_pos", T.LongType())])
JOB_SCHEMA = T.StructType([
    T.StructField("code_key", T.StringType()), T.StructField("ok", T.BooleanType()),
    T.StructField("undocumented", T.StringType()), T.StructField("renamed", T.StringType()),
    T.StructField("both", T.StringType()), T.StructField("idents", T.ArrayType(IDENT))])


ARROW_IDENTS = pa.list_(pa.struct([("name", pa.string()), ("alias", pa.string()), ("is_def", pa.bool_()),
                                   ("first_pos", pa.int64())]))
ARROW_JOB = pa.schema([("code_key", pa.string()), ("ok", pa.bool_()), ("undocumented", pa.string()),
                       ("renamed", pa.string()), ("both", pa.string()), ("idents", ARROW_IDENTS)])


def _keyed(piece: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    for k, c in zip(piece.column("code_key"), piece.column("code")):
        yield k.as_py(), c.as_py() or ""


def _job(seed: int, consistent: bool, wanted: Sequence[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(it):
            rows = [dict(code_key=k, **rewrite_code(c, k, seed, consistent, wanted)) for k, c in _keyed(piece)]
            yield pa.RecordBatch.from_pylist(rows, ARROW_JOB)
    return run


ORDINAL_SCHEMA = T.StructType([T.StructField("code_key", T.StringType()), T.StructField("renamed", T.StringType()),
                               T.StructField("idents", T.ArrayType(IDENT))])
ARROW_ORDINAL = pa.schema([("code_key", pa.string()), ("renamed", pa.string()), ("idents", ARROW_IDENTS)])


def _ordinal_job(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(it):
        outs = [(k, *(rename_ordinal(c) or (None, []))) for k, c in _keyed(piece)]
        yield pa.RecordBatch.from_pylist([dict(zip(ARROW_ORDINAL.names, o)) for o in outs], ARROW_ORDINAL)


def rename_ordinal_distinct(codes: DataFrame, code_col: str = "code") -> DataFrame:
    """(code_key, renamed) with the ordinal scheme, one parse per distinct code."""
    ship_package(codes.sparkSession)
    distinct = distinct_by_key(
        codes.select(H.content_key(F.col(code_col)).alias("code_key"), F.col(code_col).alias("code")), "code_key")
    return distinct.mapInArrow(_ordinal_job, ORDINAL_SCHEMA)


def rewrite_distinct(codes: DataFrame, code_col: str = "code", seed: int = catalog.DEFAULT_SEED,
                     consistent: bool = True, wanted: Sequence[str] = WANTED) -> DataFrame:
    """Parse every distinct code once: (code_key, ok, undocumented, renamed, both, idents);
    rewrites that are not ``wanted`` are NULL."""
    ship_package(codes.sparkSession)
    distinct = distinct_by_key(
        codes.select(H.content_key(F.col(code_col)).alias("code_key"), F.col(code_col).alias("code")), "code_key")
    return distinct.mapInArrow(_job(seed, consistent, tuple(wanted)), JOB_SCHEMA)


def identifier_table(results: DataFrame) -> DataFrame:
    """Long table (code_key, name, alias, is_def, first_pos)."""
    return results.select("code_key", F.explode("idents").alias("i")).select("code_key", "i.*")


def alias_map(idents: Column) -> Column:
    return F.map_from_entries(F.transform(idents, lambda i: F.struct(i["name"], i["alias"])))


# Word runs: Python's \w is letters, digits (all numeric classes) and '_'.
RUNS = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+"


def substitute(text, mapping) -> Column:
    """Rename whole words of ``text`` through ``mapping`` (map<string,string>).

    Splitting into word / non-word runs and mapping each word run is the
    same as replacing each mapped word with a word-boundary regex, in one
    linear pass.
    """
    t = F.col(text) if isinstance(text, str) else text
    m = F.col(mapping) if isinstance(mapping, str) else mapping
    runs = F.regexp_extract_all(t, F.lit(f"({RUNS})"), 1)
    mapped = F.transform(runs, lambda r: F.coalesce(F.try_element_at(m, r), r))
    return F.when(m.isNull() | (F.size(m) == 0), t).otherwise(F.array_join(mapped, ""))


def secondary_grid(variants: DataFrame, keys: Sequence[str], seed: int = catalog.DEFAULT_SEED,
                   consistent: bool = True, extra: Sequence[str] = ("category",)) -> DataFrame:
    """variants (keys, original_code, obfuscated_code, primary_obfuscation,
    category, question, answer) x secondary levels -> secondary records with
    ``error`` (fallback taken) and renamed question/answer.

    A NULL ``obfuscated_code`` (no completion) falls back on the original's rewrite, or the
    original itself, with ``error`` at every level."""
    keys = list(keys)
    # the variants feed three branches (distinct codes, distinct key pairs,
    # the join back): written once so their upstream runs once
    v = persisted(variants.withColumn("p_key", H.content_key(F.col("obfuscated_code")))
                          .withColumn("o_key", H.content_key(F.col("original_code"))), "variants")
    codes = (v.select(F.col("obfuscated_code").alias("code"))
              .unionByName(v.select(F.col("original_code").alias("code"))))
    res = rewrite_distinct(codes.filter(F.col("code").isNotNull()), "code", seed, consistent)
    # both join sides read the per-code results: parse each code once
    res = persisted(res, "rewrites")
    pairs = v.select("p_key", "o_key").dropDuplicates()
    pr = res.select(*[F.col(c).alias(f"p_{c}") for c in res.columns])
    orr = res.select(*[F.col(c).alias(f"o_{c}") for c in res.columns])
    decided = join_on_key(join_on_key(pairs, pr, "p_key", "p_code_key", "left"), orr, "o_key", "o_code_key", "left")
    decided = FO.over_secondary(decided)
    lvl = F.col("secondary_obfuscation")

    def pick(prefix: str) -> Column:
        return (F.when(lvl == "Undocument", F.col(f"{prefix}_undocumented"))
                 .when(lvl == "Rename", F.col(f"{prefix}_renamed"))
                 .when(lvl == "Undocument and Rename", F.col(f"{prefix}_both")))

    p_ok = F.coalesce(F.col("p_ok"), F.lit(False))
    o_ok = F.coalesce(F.col("o_ok"), F.lit(False))
    renames = lvl.isin("Rename", "Undocument and Rename")
    decided = decided.select(
        "p_key", "o_key", "secondary_obfuscation",
        F.when(lvl == "None", None).when(p_ok, pick("p")).when(o_ok, pick("o")).alias("_code"),
        (((lvl != "None") & ~p_ok) | F.col("p_key").isNull()).alias("error"),
        F.when(renames & p_ok, alias_map(F.col("p_idents")))
         .when(renames & o_ok, alias_map(F.col("o_idents"))).alias("_map"))
    decided = decided.withColumnsRenamed({"p_key": "_p", "o_key": "_o"})
    out = v.join(decided, F.col("p_key").eqNullSafe(F.col("_p")) & F.col("o_key").eqNullSafe(F.col("_o")))
    return out.select(
        *keys, "original_code", F.col("obfuscated_code").alias("primary_obfuscated_code"),
        F.coalesce(F.col("_code"), F.col("obfuscated_code"), F.col("original_code")).alias("secondary_obfuscated_code"),
        "primary_obfuscation", "secondary_obfuscation", *extra,
        substitute("question", "_map").alias("question"), substitute("answer", "_map").alias("answer"),
        "error")


def older_grid(records: DataFrame, keys: Sequence[str], rewrites: DataFrame) -> DataFrame:
    """Older five-level variant: records x (None, Undocument, Rename, Refactor, Dead Code).

    Rename gives every name an ordinal alias and renames question and answer
    with the same map; Refactor and Dead Code take the model rewrites
    (``rewrites``: code_id, level, obfuscated_code).  A code that does not
    parse keeps its text at the parser levels and is flagged ``error``.
    """
    keys = list(keys)
    res = rewrite_distinct(records, "code", wanted=("undocumented",))
    ords = rename_ordinal_distinct(records, "code")
    per_code = join_on_key(res.select("code_key", "ok", "undocumented"), ords.select(
        F.col("code_key").alias("k2"), F.col("renamed").alias("ordinal"), alias_map(F.col("idents")).alias("m")),
        "code_key", "k2", "left")
    fan = FO.over_primary(records.select(*keys, "code_id", "code", "question", "answer"), catalog.PRIMARY_LEVELS_V1)
    j = join_on_key(fan, per_code, H.content_key(F.col("code")), "code_key", "left")
    j = j.join(rewrites.withColumnRenamed("level", "primary_obfuscation"), ["code_id", "primary_obfuscation"], "left")
    lvl = F.col("primary_obfuscation")
    ok = F.coalesce(F.col("ok"), F.lit(False))
    code = (F.when(lvl == "None", F.col("code"))
             .when(lvl == "Undocument", F.when(ok, F.col("undocumented")).otherwise(F.col("code")))
             .when(lvl == "Rename", F.when(ok, F.col("ordinal")).otherwise(F.col("code")))
             .otherwise(F.col("obfuscated_code")))
    renames = (lvl == "Rename") & ok
    return j.select(*keys, F.col("primary_obfuscation").alias("obfuscation"),
                    code.alias("obfuscated_code"),
                    (lvl.isin("Undocument", "Rename") & ~ok).alias("error"),
                    F.when(renames, substitute("question", "m")).otherwise(F.col("question")).alias("question"),
                    F.when(renames, substitute("answer", "m")).otherwise(F.col("answer")).alias("answer"))
