"""Record readers: JSON arrays, JSON lines with bad-line accounting, and the
``load_data`` router by data-set name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing as H
from ..functions import text as TX
from ..operators.ordinals import numbered
from ..plans import catalog
from . import json_arrays

CORRUPT = "_corrupt_record"


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file (or a folder of parts) holding one JSON array of records, read by many tasks (:mod:`.json_arrays`)."""
    return json_arrays.read_array(spark, path, schema)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON lines: (good rows, rejected lines).

    Bad lines are kept aside in ``_corrupt_record`` instead of stopping the
    job; callers count or log them.  Lines are read as text and parsed by a
    column function, so neither side needs the corpus cached.
    """
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
                          .alias("r")).select("r.*")
    return parsed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), parsed.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def parse_json_column(df: DataFrame, column: str, schema: T.StructType | str, out: str = "parsed") -> DataFrame:
    """Per-row JSON parse of a string column; malformed text gives NULL."""
    return df.withColumn(out, F.from_json(F.col(column), schema))


# --- normalised examples -------------------------------------------------------

def clean_docstring_examples(df: DataFrame) -> DataFrame:
    """Docstring-corpus cleaning, column-wise.

    docstring: strip a raw/unicode quote prefix; code: remove the docstring
    literal; ``leaked``: docstring still inside the code; then the docstring
    is rebuilt from its tokens, punctuation spacing fixed, ' - ' -> '-', and
    a tokenised 'r '/'u ' start dropped.  ``code``/``docstring`` become
    ``input``/``output``; other columns pass through.
    """
    doc0 = TX.strip_comment_prefix("docstring")
    out = (df.withColumn("_doc0", doc0)
             .withColumn("code", TX.strip_docstring("code", "_doc0"))
             .withColumn("leaked", TX.leak_flag("code", "_doc0"))
             .withColumn("docstring", TX.strip_token_prefix(
                 TX.fix_punctuation(TX.join_tokens("docstring_tokens"))))
             .drop("_doc0"))
    return normalise_examples(out, "code", "docstring")


def normalise_examples(df: DataFrame, input_col: str, output_col: str) -> DataFrame:
    """Rename to (input, output) keeping every other column."""
    return df.withColumnsRenamed({input_col: "input", output_col: "output"})


def intent_examples(df: DataFrame) -> DataFrame:
    """Intent corpus: input = renamed head + solution + suffix, output = intent."""
    head = TX.rename_head("prompt", TX.entry_point_name("intent"))
    return df.select(TX.assemble_solution(head, F.col("canonical_solution"), F.col("suffix")).alias("input"),
                     F.col("intent").alias("output"), "*")


TOP_ROWS = 10_000  # a slice that ends here at the latest is sorted as a top-k


def seeded_slice(df: DataFrame, key: str, seed: int, start: int = 0, end: int = -1,
                 order_col: str | None = None) -> DataFrame:
    """Shuffle deterministically by md5(seed|key) (seed <= 0 keeps ``order_col``
    order), then take rows [start, end); end = -1 means to the end.

    A slice that ends within the first ``TOP_ROWS`` rows is a top-k; any other
    is cut by row numbers taken in ranges, so neither its rows nor the
    skipped ones pass through one task.  Rows are counted, so repeated and
    NULL keys (first) are cut like others; which copies of one key fall
    before a cut is open, how many is not."""
    if end != -1 and end < start:
        raise ValueError("end must be -1 or >= start")
    keys = [key] if order_col is None or seed > 0 else [order_col, key]
    order = [H.seeded_order_key(seed, key)] * (seed > 0) + [F.col(k) for k in keys]
    if end != -1 and end <= TOP_ROWS:
        ordered = df.orderBy(*order).limit(end)
        return ordered.offset(start) if start else ordered
    if end == -1 and not start:
        return df.orderBy(*order)
    row = F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row")
    rows = numbered(df.select(row, *[c.alias(f"k{i}") for i, c in enumerate(order)]),
                    [F.col(f"k{i}") for i in range(len(order))], ordinal="n")
    rows = rows.filter(F.col("n") >= start) if end == -1 else rows.filter((F.col("n") >= start) & (F.col("n") < end))
    return rows.orderBy("n").select("row.*")


def seeded_sample(df: DataFrame, key: str, seed: int, n: int | None) -> DataFrame:
    """First n rows of the seeded shuffle (n=None keeps every row)."""
    if n is None:
        return df
    return df.orderBy(H.seeded_order_key(seed, key), F.col(key)).limit(n)


def check_size(df: DataFrame, n: int) -> DataFrame:
    """Fail the job when ``df`` does not hold exactly n rows (one count)."""
    got = df.count()
    if got != n:
        raise ValueError(f"expected {n} rows, got {got}")
    return df


Loader = Callable[..., DataFrame]
_LOADERS: dict[str, Loader] = {}


def register_loader(name: str):
    def deco(fn: Loader) -> Loader:
        _LOADERS[name] = fn
        return fn
    return deco


def load_data(spark: SparkSession, name: str, **opts) -> DataFrame:
    """Route a data-set name to its reader; unknown names raise."""
    if name == "codecontests":
        raise NotImplementedError("codecontests has no reader")
    if name not in _LOADERS:
        raise ValueError(f"Unknown dataset: {name}")
    return _LOADERS[name](spark, **opts)


DOCSTRING_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("code", T.StringType()),
    T.StructField("docstring", T.StringType()),
    T.StructField("docstring_tokens", T.ArrayType(T.StringType())),
    T.StructField("path", T.StringType())])


@register_loader("csn")
def _load_csn(spark: SparkSession, path: str, seed: int = catalog.DEFAULT_LOAD_SEED,
              start: int = 0, end: int = -1, schema: T.StructType = DOCSTRING_SCHEMA) -> DataFrame:
    good, _ = read_jsonl(spark, path, schema)
    return clean_docstring_examples(seeded_slice(good, "row_id", seed, start, end))


@register_loader("odex")
def _load_intents(spark: SparkSession, path: str) -> DataFrame:
    return intent_examples(spark.read.parquet(path))


@register_loader("codeqa")
def _load_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
