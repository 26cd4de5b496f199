"""Shared pieces: white space, staged tables, row packing, hashed words."""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import persisted

# FIXED VALUE: the white space of every contract of this subpackage.
WS = "\\x20\\x09-\\x0D"


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Cuts the lineage with files that survive the loss of any executor.
    """
    return persisted(df, name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame, *cols: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``_row`` beside ``cols``.

    Operators that return whole rows work on the struct, so no column of the
    input can clash with a working column.
    """
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"), *cols)


def training_row(doc_id: Column) -> Column:
    """Rows whose labels may be learned: crc32(doc_id as text) mod 3 is not 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1, F.lit(False))


def held_out(doc_id: Column) -> Column:
    """The rows kept out of training (a NULL id is neither learned nor held out)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int,
                    max_bytes: int, seed: str) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts for the driver: [(text, 0 or 1)].

    The bound is ``per_class`` rows of each class and ``max_bytes`` of UTF-8
    a text (longer ones are not learned from, all are scored).  Rows are
    taken in the order of a hash of their id, so reruns draw the same ones.
    Ids are chosen from the label table alone; at most ``2 * per_class`` of
    them are then broadcast to pick up their texts.
    """
    lab = (labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
                 .filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & training_row(F.col("_id")))
                 .groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_y").alias("_y0"))
                 .filter("_y = _y0"))
    key = F.md5(F.concat(F.lit(seed), F.col("_id").cast("string")))
    picked = [lab.filter(F.col("_y") == y).orderBy(key).limit(per_class) for y in (0, 1)]
    ids = picked[0].union(picked[1]).select("_id", "_y")
    text = docs.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t"))
    text = text.filter(F.col("_t").isNotNull() & (F.octet_length("_t") <= max_bytes))
    rows = text.join(F.broadcast(ids), F.col("_d") == F.col("_id")).select("_id", "_t", "_y").collect()
    seen: dict = {}
    for r in sorted(rows, key=lambda r: (r["_id"], r["_t"])):
        seen.setdefault(r["_id"], (r["_t"], r["_y"]))
    return list(seen.values())


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` named by ``keys`` (_id, _dg), one row for each key.

    ``_dg`` is :func:`row_digest` of the text.  Rows that repeat both are
    one document and come back once; only those go through a second shuffle.
    """
    k = keys.select(F.col("_id").alias("_kid"), F.col("_dg").alias("_kdg"), F.col("_reps").alias("_reps"))
    p = packed(docs, F.col("doc_id").alias("_id"), row_digest(F.col("text")).alias("_dg"))
    j = p.join(k, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_dg") == F.col("_kdg")))
    out = j.select("_row.*")
    if k.filter("_reps > 1").isEmpty():
        return out
    once = j.filter("_reps > 1").select("_row", "_id", "_dg").dropDuplicates(["_id", "_dg"])
    return j.filter("_reps = 1").select("_row").union(once.select("_row")).select("_row.*")


HOT_SHARE = 1000  # a key is hot above this part of all rows, so at most this many keys are
HOT_LEAST = 1000  # ... and above this many rows


def join_hot(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, rows: int,
             least: int = HOT_LEAST, share: int = HOT_SHARE) -> DataFrame:
    """``left.join(right, key)`` for a ``right`` with one row a key, whatever part of ``left`` one key holds.

    ``sizes`` is (key, n): the rows of ``left`` by key, of ``rows`` in all.
    Keys with more than ``rows / share`` of them are at most ``share``, so
    their rows of ``right`` are broadcast; all others are shuffled.
    """
    named = F.broadcast(sizes.filter(F.col("n") > max(least, rows // share)).select(key))
    hot = F.broadcast(right.join(named, key, "left_semi"))
    return left.join(hot, key).unionByName(left.join(named, key, "left_anti").join(right, key))


def row_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("\x00")).cast("binary"))


_KNOWN: set[str] = set()


def known_chars(text: str) -> bool:
    """Whether Python's Unicode tables know all characters of a text; others may class newer ones otherwise."""
    unseen = set(text) - _KNOWN
    if unseen:
        if any(unicodedata.category(c) == "Cn" for c in unseen):
            return False
        _KNOWN.update(unseen)
    return True


# --- words as 64-bit hashes, for whole Arrow batches ------------------------

_P = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POW = np.multiply.accumulate(np.array([1] + [_P] * 63, dtype=np.uint64))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each byte span [start, end) of ``data`` (spans ascending).

    A polynomial over the bytes, summed by span.  Spans are worked off in
    blocks of about ``block`` bytes, so memory does not follow the text.
    """
    out = np.empty(len(start), dtype=np.uint64)
    upto = np.cumsum(end - start)
    i = 0
    while i < len(start):
        done = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, done + block, side="right")))
        n = end[i:j] - start[i:j]
        off = np.cumsum(n) - n
        pos = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(off, n)
        b = data[np.repeat(start[i:j], n) + pos].astype(np.uint64) + np.uint64(1)
        far = np.flatnonzero(pos >= 64)
        if len(far):  # the powers repeat; the place in a long span still counts
            b[far] = mix64(b[far] + (pos[far] >> 6).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        h = np.add.reduceat(b * _POW[pos & 63], off)
        out[i:j] = mix64(h + n.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        i = j
    return out


def joined_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts in one array, a newline after each; and each one's end."""
    enc = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(enc) + b"\n", dtype=np.uint8) if enc else np.empty(0, dtype=np.uint8)
    ends = np.cumsum([len(e) + 1 for e in enc]) if enc else np.empty(0, dtype=np.int64)
    return data, np.asarray(ends, dtype=np.int64)


def spans(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True."""
    edge = np.diff(np.concatenate(([0], member.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def runs(sizes: list[int], most: int):
    """Consecutive runs [i, j) whose sizes add up to ``most`` at most, or of one."""
    i = 0
    while i < len(sizes):
        j, n = i, 0
        while j < len(sizes) and (j == i or n + sizes[j] <= most):
            n += sizes[j]
            j += 1
        yield i, j
        i = j


def slices(texts: list[str], max_chars: int):
    """Runs of ``texts`` of about ``max_chars`` characters in all: bounds memory."""
    return runs([len(t) for t in texts], max_chars)
