"""Near-duplicate documents by BagMinHash signatures over five-word shingles.

A document is the multiset of its five-word shingles; two documents are
near copies when the weighted Jaccard similarity of their multisets (sum of
smaller counts over sum of larger ones) is at least ``SIMILARITY``.

1. *Sign.*  Counts are discretised into unit levels, grouped in dyadic
   blocks (0,1], (1,2], (2,4], ...  On each block of each shingle runs a
   Poisson process of the block's width, derived from a hash of (shingle,
   block): its points carry an arrival time, a register and a level.  A
   document sees the points whose level its count reaches, and a register
   keeps the earliest time.  Two documents agree in a register with
   probability equal to their weighted Jaccard similarity.  Points are made
   in order of time and only while they can still beat some register, so the
   work is about one point a shingle plus a few for each register.
2. *Band.*  ``BANDS`` bands of ``ROWS`` registers; documents that share a
   band are candidates.  At similarity 0.8 a pair is missed with
   probability (1 - 0.8**5)**32 = 3e-6; above it, less.
3. *Verify.*  Candidates are compared by exact multiset overlap.

Equal texts (up to white space) are one node from the start.  A band shared
by many documents is not expanded into pairs: its members are compared with
one leader, components are formed, and a second leader is compared with the
members outside its component.  Where a band still holds several components,
all members outside its largest one are compared with all others, in blocks
of bounded size that return links of components only, so no link between
components is lost and no pair rows are made.  Texts of candidates alone are
moved, picked out by a bitmap of fixed size.

Defined results: NULL counts as empty; texts without words are equal to each
other and near nothing else; a text of under five words is one shingle; the
document with the smallest ``doc_id`` of a class stays (NULL sorts last);
rows that repeat are rows of one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (WS, join_hot, joined_bytes, keep_rows, mix64, row_digest, runs, shuffle_partitions, slices, spans, staged,
                     word_hashes)
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 5
REGISTERS = BANDS * ROWS
BATCH_CHARS = 1 << 20
BITMAP_WORDS = 1 << 20  # 64 bits each: 8 MB, whatever the corpus

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def words_digest(text: Column) -> Column:
    """Equal for texts whose words are equal."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS}]+", " ")
    return F.md5(F.trim(t).cast("binary"))


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every shingle, texts in order."""
    data, ends = joined_bytes(texts)
    start, end = spans(~_BLANK[data])
    h = word_hashes(data, start, end)
    doc = np.searchsorted(ends, start, side="right")
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    left = n[doc] - (np.arange(len(h)) - first[doc])  # words from here to the text's end
    s = h.copy()
    for k in range(1, SHINGLE):
        more = left > k
        at = np.flatnonzero(more)
        s[at] = mix64(s[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + k])
    whole = (left >= SHINGLE) | ((n[doc] < SHINGLE) & (left == n[doc]))
    return doc[whole], s[whole]


def multisets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), for signing: at most 65,536 texts, shingles cut to 48 bits."""
    doc, s = shingle_hashes(texts)
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16)))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.concatenate((at, [len(key)])))
    return (key[at] >> np.uint64(48)).astype(np.int64), mix64(key[at] & np.uint64((1 << 48) - 1)), count


def _arrivals(key: np.ndarray, rate: np.ndarray, made: int, more: int, last: np.ndarray):
    """Points ``made`` .. ``made + more`` of each process: (times, registers, level in (0, 1])."""
    i = np.arange(made, made + more, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    a = mix64(key[:, None] + i[None, :])
    u = ((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
    step = -np.log(u) / rate[:, None]
    step[:, 0] += last
    b = mix64(a ^ np.uint64(0xA0761D6478BD642F))
    register = ((b >> np.uint64(32)) % np.uint64(REGISTERS)).astype(np.int64)
    level = ((b & np.uint64(0xFFFFFFFF)).astype(np.float64) + 1.0) * 2.0 ** -32
    return np.cumsum(step, axis=1), register, level


def signatures(doc: np.ndarray, s: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """n x REGISTERS earliest arrival times; infinity throughout for a text without shingles."""
    reg = np.full((n, REGISTERS), np.inf)
    # one process for each (shingle, dyadic block of levels) that the count reaches into
    p_doc, p_key, p_low, p_rate, p_count = [], [], [], [], []
    low, block = 0, 0
    while True:
        at = np.flatnonzero(count > low)
        if not len(at):
            break
        p_doc.append(doc[at])
        p_key.append(mix64(s[at] + np.uint64((block + 1) * 0x8CB92BA72F3D8DD7 % (1 << 64))))
        p_low.append(np.full(len(at), low))
        p_rate.append(np.full(len(at), max(low, 1), dtype=np.float64))
        p_count.append(count[at])
        low, block = max(1, 2 * low), block + 1
    if not p_doc:
        return reg
    d, key, low_, rate, cnt = map(np.concatenate, (p_doc, p_key, p_low, p_rate, p_count))
    flat = reg.ravel()
    total = np.bincount(d, rate, minlength=n)
    # about as many points as fill the registers, shared out by rate, in powers of two
    want = REGISTERS * (np.log(REGISTERS) + 2) / np.maximum(total, 1)
    size = np.exp2(np.ceil(np.log2(np.maximum(want, 1)))).astype(np.int64)[d]
    made = np.zeros(len(d), dtype=np.int64)
    last = np.zeros(len(d))
    active = np.arange(len(d))
    while len(active):
        group = size[active] * (1 << 32) + made[active]
        for g in np.unique(group):
            of = active[group == g]
            more, done = int(g >> 32), int(g & 0xFFFFFFFF)
            for at in range(0, len(of), max(1, (1 << 19) // more)):
                e = of[at:at + max(1, (1 << 19) // more)]
                x, r, level = _arrivals(key[e], rate[e], done, more, last[e])
                # a point belongs to the unit step of the count that its level falls in
                reached = low_[e][:, None] + level * rate[e][:, None] <= cnt[e][:, None]
                place = (d[e][:, None] * REGISTERS + r)[reached]
                np.minimum.at(flat, place, x[reached])
                last[e] = x[:, -1]
                made[e] = done + more
        worst = reg.max(axis=1)
        active = active[last[active] < worst[d[active]]]
        size[active] = np.minimum(size[active], 256)
    return reg


def band_keys(reg: np.ndarray) -> list[np.ndarray]:
    """A 64-bit key for each band of each text; none for a text without shingles."""
    bits = reg.view(np.uint64).reshape(len(reg), BANDS, ROWS)
    key = np.zeros((len(reg), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
    some = np.isfinite(reg[:, 0])
    return [k if ok else k[:0] for k, ok in zip(key.view(np.int64), some)]


@F.pandas_udf(T.ArrayType(T.LongType()))
def bands(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Band keys of whole texts."""
    for batch in batches:
        texts = [t if isinstance(t, str) else "" for t in batch]
        out: list = []
        for i, j in slices(texts, BATCH_CHARS):
            for k in range(i, j, 1 << 16):
                n = min(j, k + (1 << 16)) - k
                out += band_keys(signatures(*multisets(texts[k:k + n]), n))
        yield pd.Series(out)


def overlaps(left: list[str], right: list[str]) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts, exactly."""
    n = len(left)
    doc, s = shingle_hashes([*left, *right])
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    at = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1]))))[:len(s)]
    pair, s, count = doc[at] % n, s[at], np.diff(np.concatenate((at, [len(s)])))
    size = np.bincount(pair, count, minlength=n)
    order = np.lexsort((s, pair))
    pair, s, count = pair[order], s[order], count[order]
    twin = np.flatnonzero((pair[1:] == pair[:-1]) & (s[1:] == s[:-1]))
    shared = np.bincount(pair[twin], np.minimum(count[twin], count[twin + 1]), minlength=n)
    return shared / np.maximum(size - shared, 1)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    left, right = a.tolist(), b.tolist()
    out = np.empty(len(left))
    for i, j in runs([len(x) + len(y) for x, y in zip(left, right)], BATCH_CHARS):
        out[i:j] = overlaps(left[i:j], right[i:j])
    return pd.Series(out)


# --- what is left of a band, in blocks ----------------------------------------

QUERY_BLOCK, TARGET_BLOCK = 256, 1024


def _blocks(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """(band, qb, tb, query, node, label, text): the members of ``rest`` (band, node, label)
    outside their band's largest component as queries, all as targets, dealt into blocks."""
    sizes = rest.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("band").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("k"))
    sizes = sizes.select("band", F.col("main.label").alias("main"),
                         F.ceil((F.col("k") - F.col("main.n")) / QUERY_BLOCK).cast("int").alias("nq"),
                         F.ceil(F.col("k") / TARGET_BLOCK).cast("int").alias("nt"))
    r = rest.join(sizes, "band")
    q = F.pmod(F.xxhash64("node", F.lit(1)), F.col("nq")).cast("int")
    t = F.pmod(F.xxhash64("node"), F.col("nt")).cast("int")
    place = lambda qb, tb, query: F.struct(qb.alias("qb"), tb.alias("tb"), F.lit(query).alias("query"))
    targets = F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda x: place(x, t, False))
    queries = F.transform(F.sequence(F.lit(0), F.col("nt") - 1), lambda x: place(q, x, True))
    at = F.when(F.col("label") == F.col("main"), targets).otherwise(F.concat(targets, queries))
    return (r.join(texts, "node").select("band", F.explode(at).alias("p"), "node", "label", "text")
             .select("band", "p.*", "node", "label", "text"))


def _links_in_blocks(pdf: pd.DataFrame) -> set:
    """(label, label) of the queries and targets of each block that are near copies."""
    node, back = np.unique(pdf["node"].to_numpy(), return_inverse=True)
    first = np.zeros(len(node), dtype=np.int64)
    first[back] = np.arange(len(pdf))
    doc, s = shingle_hashes(pdf["text"].to_numpy()[first].tolist())
    value, ids = np.unique(s, return_inverse=True)
    key, count = np.unique(doc.astype(np.int64) * len(value) + ids, return_counts=True)
    doc, ids = key // max(len(value), 1), key % max(len(value), 1)
    begin = np.searchsorted(doc, np.arange(len(node) + 1))
    size = np.bincount(doc, count, minlength=len(node))
    label, query = pdf["label"].to_numpy(), pdf["query"].to_numpy()
    block = pdf[["band", "qb", "tb"]].to_numpy()
    cuts = np.flatnonzero((block[1:] != block[:-1]).any(axis=1)) + 1
    have = np.zeros(len(value), dtype=np.int64)
    links: set = set()
    for rows in np.split(np.arange(len(pdf)), cuts):
        t = rows[~query[rows]]
        spans_ = [np.arange(begin[d], begin[d + 1]) for d in back[t]]
        off = np.cumsum([0] + [len(x) for x in spans_[:-1]])
        flat = np.concatenate(spans_)
        t_ids, t_count, t_size, t_label = ids[flat], count[flat], size[back[t]], label[t]
        for q in rows[query[rows]]:
            d = back[q]
            own = slice(begin[d], begin[d + 1])
            have[ids[own]] = count[own]
            shared = np.add.reduceat(np.minimum(have[t_ids], t_count), off)
            have[ids[own]] = 0
            near = (shared / np.maximum(t_size + size[d] - shared, 1) >= SIMILARITY) & (t_label != label[q])
            links.update((int(label[q]), int(x)) for x in np.unique(t_label[near]))
    return links


def _compare_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted block rows -> links of components (a, b), as a forest for each batch.

    A block that a batch cuts off is held back for the next one.
    """
    held = None
    place = ["band", "qb", "tb"]

    def out(pdf):
        up: dict[int, int] = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        pairs = []
        for a, b in sorted(_links_in_blocks(pdf)):
            ra, rb = root(a), root(b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
                pairs.append((a, b))
        return pd.DataFrame(pairs, columns=["a", "b"])

    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = (pdf[place] == pdf[place].iloc[-1]).all(axis=1).to_numpy()
        held = pdf[last]
        if not last.all():
            yield out(pdf[~last])
    if held is not None and len(held):
        yield out(held)


# --- the job --------------------------------------------------------------------

def _bitmap(nodes: DataFrame) -> np.ndarray:
    """Bits of the nodes' digests: BITMAP_WORDS words at most come to the driver."""
    at = F.pmod(F.xxhash64("digest"), F.lit(BITMAP_WORDS * 64))
    bits = nodes.select(F.shiftright(at, 6).cast("int").alias("w"),
                        F.expr("shiftleft(1L, cast(pmod(xxhash64(digest), 64L) as int))").alias("b"))
    rows = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(BITMAP_WORDS, dtype=np.int64)
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64)
    return out


def candidate_texts(spark: SparkSession, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the given nodes (node, digest, first): one text each, read again from ``docs``."""
    bitmap = spark.sparkContext.broadcast(_bitmap(nodes))

    @F.pandas_udf("boolean")
    def maybe(at: pd.Series) -> pd.Series:
        a = at.to_numpy(dtype=np.int64)
        return pd.Series(((bitmap.value[a >> 6] >> (a & 63)) & 1).astype(bool))

    rows = docs.select(words_digest(F.col("text")).alias("dg"), F.col("doc_id").alias("id"), F.col("text").alias("text"))
    rows = rows.filter(maybe(F.pmod(F.xxhash64("dg"), F.lit(BITMAP_WORDS * 64))))
    first = nodes.select("node", "digest", F.col("first.doc_id").alias("first_id"))
    hit = rows.join(first, (F.col("dg") == F.col("digest")) & F.col("id").eqNullSafe(F.col("first_id")))
    return hit.groupBy("dg", "id").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text")


def near_classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, component_id, kept (and the raw text's digest)."""
    docs = docs.select("doc_id", "text")
    rows = docs.select("doc_id", row_digest(F.col("text")).alias("raw"), words_digest(F.col("text")).alias("digest"),
                       bands(F.col("text")).alias("bands"), F.monotonically_increasing_id().alias("rid"))
    rows = staged(spark, rows, "signed")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    nodes = rows.groupBy("digest").agg(F.min(first).alias("first"), F.first("bands").alias("bands"))
    nodes = staged(spark, nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # bands that several nodes share, with their members
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("low"),
                                        F.max("node").alias("high")).filter("k > 1").drop("k")
    members = staged(spark, banded.join(shared, "band"), "members")
    in_play = members.select("node").distinct()
    texts = staged(spark, candidate_texts(spark, docs, nodes.join(in_play, "node").select("node", "digest", "first")),
                   "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are near copies."""
        t = texts.select(F.col("node"), F.col("text"))
        j = (pairs.join(t.withColumnsRenamed({"node": "a", "text": "ta"}), "a")
                  .join(t.withColumnsRenamed({"node": "b", "text": "tb"}), "b"))
        return j.filter(similarity(F.col("ta"), F.col("tb")) >= SIMILARITY).select("a", "b")

    # first leader: each shared band's smallest node
    pairs = members.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    labels = staged(spark, components(spark, verified(pairs)), "labels")
    named = _relabel(members, labels)
    # second leader: the largest, for members outside its component
    high = named.select(F.col("node").alias("high"), F.col("label").alias("high_label")).distinct()
    sizes = members.groupBy("high").agg(F.count(F.lit(1)).alias("n"))
    other = (join_hot(named, high, "high", sizes, members.count()).filter("label <> high_label")
                  .select(F.col("node").alias("a"), F.col("high").alias("b")).distinct())
    labels = staged(spark, _joined(spark, labels, _between(verified(other), labels)), "labels")
    named = _relabel(members, labels)
    # the rest: bands whose members are still in different components
    mixed = named.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
    rest = staged(spark, named.join(mixed.select("band"), "band", "left_semi").select("band", "node", "label"), "rest")
    blocks = _blocks(rest, texts).repartition(shuffle_partitions(spark), "band", "qb", "tb")
    links = blocks.sortWithinPartitions("band", "qb", "tb").mapInPandas(_compare_blocks, "a long, b long")
    labels = staged(spark, _joined(spark, labels, links), "labels")

    # classes: each component's first row, then every row's class
    node_label = nodes.join(labels, "node", "left").select("digest", "first", F.coalesce("label", "node").alias("label"))
    best = node_label.groupBy("label").agg(F.min("first").alias("best"))
    named_nodes = node_label.join(best, "label").select("digest", "best")
    return rows.join(named_nodes, "digest").select(
        "doc_id", F.col("best.doc_id").alias("component_id"), (F.col("rid") == F.col("best.rid")).alias("kept"), "raw")


def _relabel(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) of nodes as links of their components."""
    la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return (links.join(la, "a", "left").join(lb, "b", "left")
                 .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))


def _joined(spark: SparkSession, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the components that ``links`` connects are merged."""
    links = staged(spark, links, "merges")
    if links.isEmpty():
        return labels
    up = components(spark, links).select(F.col("node").alias("label"), F.col("label").alias("up"))
    old = labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    new = up.select(F.col("label").alias("node"), F.col("up").alias("label"))  # nodes alone until now
    return old.unionByName(new.join(labels.select("node"), "node", "left_anti"))


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns."""
    g = near_classes(spark, docs)
    reps = g.groupBy(F.col("doc_id").alias("_id"), F.col("raw").alias("_dg")).agg(
        F.count(F.lit(1)).alias("_reps"), F.max("kept").alias("_kept"))
    return keep_rows(docs, staged(spark, reps.filter("_kept").drop("_kept"), "near-keys"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_classes(spark, docs).select("doc_id", "component_id", "kept")
