"""Periodic runs in the words of a text: online sparse diagonal dynamic programming.

A diagonal is a lag q; its match length at word i counts the words up to i
that equal the word q places earlier.  The words are passed once: every
earlier occurrence of what begins at word i lengthens its diagonal, and a
diagonal that is not lengthened ends and emits its run at once, if the run
is long enough.

Kept sparse, and exact: of a run with smallest period q and at least
max(24, 3q) words the match is at least 2q and at least 16 words long.  Let
L be the least power of two that is 16 or more and q or more.  Each stretch
of L words that begins within the match lies in the run, and its nearest
earlier occurrence begins exactly q words before: a nearer one, d words
before, would give the union of both the periods d and q, hence (Fine and
Wilf) a common divisor of them, and the run a smaller period.  So at each
level L = 16, 32, 64, ... only the nearest earlier occurrence counts, and
only at lags in (L/2, L]; multiples of a period never become active, a
diagonal that ends is a whole run with its smallest period, and a common
word costs no more than a rare one.  Stretches are compared exactly: the
identifiers of level 2L are the distinct pairs of identifiers of level L,
and only stretches that occur twice live on.  A text of n words takes
O(n log n) steps and a few arrays of n numbers; in prose without repeats
nothing lives beyond a few words.

Defined results: words are runs of characters other than white space; a
NULL or empty text has no words, no runs and collapses to the empty text;
runs ascend by start, then period; rows that repeat give equal results.
Texts are handled whole and one by one, whatever their neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, runs, spans

LEAST = 24     # FIXED VALUES: a run has LEAST words or more, and its period three times or more
TIMES = 3
FIRST = 16     # the first level: no match of a run is shorter
BATCH_CHARS = 1 << 20
PIECE = 1 << 20  # characters of a long text that are cut into words at once
RUN = "struct<start:long,length:long,period:long>"

_WORD = re.compile(f"[^{WS}]+")
_GAP = re.compile(f"[{WS}]")


def word_ids(text: str) -> tuple[np.ndarray, list[str]]:
    """The words of a text as numbers, and the distinct words."""
    known: dict[str, int] = {}
    parts, at = [], 0
    while at < len(text):
        cut = _GAP.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        words = _WORD.findall(text, at, end)
        new = dict.fromkeys(words).keys() - known.keys()
        known.update(zip(new, range(len(known), len(known) + len(new))))
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        at = end
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)), list(known)


def occurrences(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(L, places, lags) level by level: where the nearest earlier occurrence of the
    stretch of L words that begins at a place lies lag words before, L/2 < lag <= L."""
    n, width = len(ids), 1
    at, key = np.arange(n), ids
    while len(at):
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if width >= FIRST:
            i, lag = at[order[1:][same]], at[order[1:][same]] - at[order[:-1][same]]
            own = (lag <= width) & ((lag > width // 2) | (width == FIRST))
            yield width, i[own], lag[own]
        twice = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(np.concatenate(([0], ~same)))
        whole = np.full(n, -1, np.int64)
        alive = np.zeros(len(at), bool)
        alive[order[twice]] = True
        whole[at[alive]] = number[alive]
        # the next level: two stretches side by side, both of which occur twice
        at = at[alive]
        at = at[at + 2 * width <= n]
        at = at[whole[at + width] >= 0]
        key = whole[at] * np.int64(n + 1) + whole[at + width]
        width *= 2


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    out = []
    for width, places, lags in occurrences(ids):
        active: dict[int, list[int]] = {}  # lag -> first and last place of its match
        order = np.argsort(places, kind="stable")

        def emit(lag: int, first: int, last: int) -> None:
            length = last + width - first + lag
            if length >= max(LEAST, TIMES * lag):
                out.append((first - lag, length, lag))

        for i, lag in zip(places[order].tolist(), lags[order].tolist()):
            match = active.get(lag)
            if match is not None and match[1] == i - 1:
                match[1] = i
                continue
            for q in [q for q, m in active.items() if m[1] < i - 1]:
                emit(q, *active.pop(q))
            active[lag] = [i, i]
        for q, m in active.items():
            emit(q, *m)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """The words that no run contains after its first ``period`` words."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def _collapsed(ids: np.ndarray, words: list[str], found) -> str:
    """The kept words, joined by one space."""
    parts = [" ".join(map(words.__getitem__, ids[a:b].tolist())) for a, b in zip(*spans(kept_words(len(ids), found)))]
    return " ".join(parts)


def _batch_runs(texts: list[str]) -> Iterator[tuple[int, list, str]]:
    """(number of words, runs, collapsed text) of each text.

    The words of all texts lie in one array.  Words of different texts have
    different numbers, so no stretch occurs in two texts.
    """
    cut = [word_ids(t) for t in texts]
    base = np.cumsum([0] + [len(w) for _, w in cut])
    ends = np.cumsum([0] + [len(i) for i, _ in cut])
    found = find_runs(np.concatenate([i + b for (i, _), b in zip(cut, base)])) if cut else []
    owner = np.searchsorted(ends, [r[0] for r in found], side="right") - 1
    mine: dict[int, list] = {}
    for k, (start, length, period) in zip(owner.tolist(), found):
        mine.setdefault(k, []).append((start - int(ends[k]), length, period))
    for k, (ids, words) in enumerate(cut):
        yield len(ids), mine.get(k, []), _collapsed(ids, words, mine.get(k, []))


def periodic_runs(spark: SparkSession, docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns with n_words, ``runs`` (array of start, length, period) and ``collapsed``."""
    src = docs.select(*[docs[f"`{c}`"].alias(f"_k{i}") for i, c in enumerate(keep)], docs[f"`{text}`"].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        names = [*[f"_k{i}" for i in range(len(keep))], "n_words", "runs", "collapsed"]
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for i, j in runs([len(t) for t in texts], BATCH_CHARS):
                rows = list(_batch_runs(texts[i:j]))
                found = [[{"start": s, "length": n, "period": q} for s, n, q in r[1]] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, j - i).columns[:-1], pa.array([r[0] for r in rows], pa.int64()),
                     pa.array(found, kind), pa.array([r[2] for r in rows], pa.string())], names=names)

    schema = [f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    schema += ["n_words long", f"runs array<{RUN}>", "collapsed string"]
    return src.mapInArrow(run, ", ".join(schema)).withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})


def strongest(found: Column) -> Column:
    """The run with the greatest length / period, compared exactly (ties: smallest start, then period); NULL: none."""
    def better(x: Column, y: Column) -> Column:
        a, b = x.length * y.period, y.length * x.period
        return (F.when(a != b, F.when(a > b, -1).otherwise(1))
                 .when(x.start != y.start, F.when(x.start < y.start, -1).otherwise(1))
                 .when(x.period != y.period, F.when(x.period < y.period, -1).otherwise(1)).otherwise(0))
    return F.get(F.array_sort(found, better), 0)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the input of the query.

    With h = crc32(doc_id as text) divisible by 10, the words from a = (h div
    10) mod n on repeat the p words from there on.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col("text"), F.lit(f"[^{WS}]+"), F.lit(0))
    hit = docs.select("doc_id", "text", F.coalesce(h % 10 == 0, F.lit(False)).alias("hit"), g.alias("g"))
    hit = hit.select("doc_id", "text", "hit", "g", F.when(F.col("hit"), words).alias("w"))
    hit = hit.select("*", F.size("w").alias("n"), F.when(F.size("w") > 0, F.pmod("g", F.size("w"))).alias("a"))
    hit = hit.select("*", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod("g", F.lit(8))))).alias("p"))
    n, a, p = F.col("n"), F.col("a"), F.col("p")
    place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("w", place(i).cast("int"))), " ")
    return hit.select("doc_id", F.when(F.col("hit") & (n > 0), made).otherwise(F.col("text")).alias("text"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = periodic_runs(spark, docs).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"),
                                                                F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
