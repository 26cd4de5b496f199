"""Near-duplicate vectors by randomised-rotation binary codes.

Vectors with equal, non-null labels are linked when their cosine is at least
``COSINE``.  Each distinct unit vector o is rotated by a fixed random
rotation and stored as its signs, the code c (D bits), with the correction
factor f = <c/sqrt(D), o>.  For a rotated query q

    est = <c/sqrt(D), q> / f

is an unbiased estimate of <o, q>: its error is the part of q across o times
sqrt(1 - f*f) / f times one coordinate of a random direction in D - 1
dimensions.  A pair of cosine COSINE or more has a part across of at most
sqrt(1 - COSINE**2), and a coordinate beyond ``Z`` / sqrt(D - 1) has a
probability under 1e-9, so a pair whose estimate falls short of COSINE by
more than that bound is no link; all other pairs, and only they, are
recomputed in double precision.

Equal vectors are one node first.  The nodes of a label are dealt into blocks
of about ``BLOCK``; each pair of blocks that is compared is one bounded group
of work, which returns a link count for each node and the links of a spanning
forest, never all pairs.

Which pairs of blocks are compared is exact by default, at every size: a
label of more than ``BLOCK`` nodes gets pivots, nodes of its own drawn by hash
(``PIVOTS`` at most in all labels, shared by size), and a block holds nodes of
one nearest pivot whose angles to it lie in one shell.  A node goes to the
blocks of another shell only if its own angle to that pivot is within the
threshold's angle of the shell; by the triangle inequality on the sphere no
other block holds a link of it.  Where a label's vectors lie in few clusters
most pairs of blocks fall away; where they are spread evenly in many
dimensions none does, and the work is quadratic in the label's nodes.

For such labels ``miss`` above 0 trades that for a small loss: a label of
more than ``CELL`` nodes is compared within cells only, the signs of k
independent directions, in as many tables as leave a link at the threshold
unmet with that probability at most (closer pairs less); a pair counts in the
first table where it meets.

Defined results: a vector that is NULL, empty, zero, or holds a NULL or
non-finite component, or whose label or id is NULL, links with nothing;
vectors of different length do not link; rows that repeat are rows of their
own and count as links of each other.
"""

from __future__ import annotations

from functools import lru_cache
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged
from .components import components

COSINE = 0.93
Z = 6.0
CELL = 16384
BLOCK = 4096
PIVOTS = 4096  # vectors broadcast at most, whatever the table's size
SHELLS = 36
SHELL = pi / SHELLS
ANGLE = acos(COSINE) + 1e-6  # rounding of an angle is far below the last term
AGREE = 1 - acos(COSINE) / pi  # chance that a sign agrees at the threshold


@lru_cache(maxsize=256)
def rotation(dim: int, number: int = 0) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=256)
def directions(dim: int, table: int, bits: int) -> np.ndarray:
    """Independent random directions, one a row: signs of a rotation's rows agree together less often."""
    return np.random.default_rng([dim, table, bits]).normal(size=(bits, dim))


def tables_for(n: int, miss: float) -> tuple[int, int]:
    """(sign bits, tables) for a label of ``n`` nodes; no signs where ``miss`` is 0."""
    bits = max(0, ceil(log(n / CELL, 2))) if n and miss > 0 else 0
    return (0, 1) if bits == 0 else (bits, ceil(log(miss) / log(1 - AGREE ** bits)))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def codes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs as packed bits, correction factor) of unit vectors."""
    r = u @ rotation(u.shape[1]).T
    return np.packbits(r > 0, axis=1), np.abs(r).sum(axis=1) / sqrt(u.shape[1])


def _signs(packed: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1


def links_between(ua, ub, code_b, factor_b, upper: bool, chunk: int = 512):
    """Yields (a, b) index arrays of the pairs with cosine >= COSINE, found by codes and checked exactly."""
    dim = ua.shape[1]
    ra = (ua @ rotation(dim).T).astype(np.float32)
    cb = _signs(code_b, dim)
    across = sqrt(1 - COSINE ** 2) * min(1.0, Z / sqrt(max(dim - 1, 1)))
    # float32 rounding is far below the last term
    least = (COSINE - across * np.sqrt(np.maximum(0, 1 - factor_b ** 2)) / factor_b - 1e-4) * factor_b * sqrt(dim)
    for at in range(0, len(ua), chunk):
        maybe = ra[at:at + chunk] @ cb.T >= least[None, :].astype(np.float32)
        a, b = np.nonzero(maybe)
        a = a + at
        if upper:
            a, b = a[b > a], b[b > a]
        for i in range(0, len(a), 1 << 16):
            x, y = a[i:i + (1 << 16)], b[i:i + (1 << 16)]
            ok = np.einsum("ij,ij->i", ua[x], ub[y]) >= COSINE
            yield x[ok], y[ok]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the links."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        differ = root[a] != root[b]
        a, b = a[differ], b[differ]
    while (root[root] != root).any():
        root = root[root]
    return root


def _compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair of blocks: (node, links, root) of the nodes that link."""
    table, i, j = key[2], key[4], key[5]
    pdf = pdf.sort_values("node", kind="stable")
    u = unit(np.stack(pdf["v"].to_numpy()).astype(np.float64))
    code = np.stack([np.frombuffer(c, dtype=np.uint8) for c in pdf["code"]])
    factor, mult, node = pdf["factor"].to_numpy(), pdf["mult"].to_numpy(), pdf["node"].to_numpy()
    cells = np.stack(pdf["cells"].to_numpy())
    block = pdf["block"].to_numpy()
    ia = np.flatnonzero(block == i)
    ib = ia if i == j else np.flatnonzero(block == j)
    links = np.zeros(len(pdf), dtype=np.int64)
    tree = np.arange(len(pdf))
    if len(ia) and len(ib):
        for a, b in links_between(u[ia], u[ib], code[ib], factor[ib], i == j):
            a, b = ia[a], ib[b]
            if cells.shape[1] > 1:  # counted in the first table where the pair meets
                mine = (cells[a] == cells[b]).argmax(axis=1) == table
                a, b = a[mine], b[mine]
            np.add.at(links, a, mult[b])
            np.add.at(links, b, mult[a])
            tree = forest(len(pdf), np.concatenate([np.arange(len(pdf)), a]), np.concatenate([tree, b]))
    out = pd.DataFrame({"node": node, "links": links, "root": node[tree]})
    return out[links > 0]


def _encoder(miss: float, pivots=None):
    """``pivots`` is the broadcast of :func:`pivots_of`, or None."""
    def encode(batches):
        """Adds code, factor, the cell of each table and the shell around the nearest pivot."""
        for pdf in batches:
            code, of, cell = [b""] * len(pdf), np.zeros(len(pdf)), [None] * len(pdf)
            shell = np.zeros(len(pdf), dtype=np.int64)
            for key, at in _pieces(pdf, pivots.value) if pivots else ():
                angle = _angles(pdf["v"], at, pivots.value[key])
                home = angle.argmin(axis=1)
                shell[at] = home * (SHELLS + 1) + (angle[np.arange(len(at)), home] / SHELL).astype(np.int64)
            for (dim, n_label), at in pdf.groupby(["dim", "n_label"]).indices.items():
                u = unit(np.stack(pdf["v"].to_numpy()[at]).astype(np.float64))
                packed, factor = codes(u)
                bits, tables = tables_for(int(n_label), miss)
                cells = np.zeros((len(at), tables), dtype=np.int64)
                for t in range(tables if bits else 0):
                    cells[:, t] = (u @ directions(int(dim), t, bits).T > 0) @ (1 << np.arange(bits))
                of[at] = factor
                for row, c, p in zip(at, cells, packed):
                    code[row], cell[row] = p.tobytes(), c
            yield pdf.assign(code=code, factor=of, cells=cell, shell=shell)
    return encode


# --- exact choice of block pairs ------------------------------------------------

PLACE = ["label", "dim", "tab", "cell"]


def pivots_of(nodes: DataFrame, sizes: DataFrame) -> dict[tuple, np.ndarray]:
    """(label, dim) -> unit vectors, for labels of more than a block: PIVOTS vectors at most in all."""
    total = sizes.agg(F.sum("n_label")).first()[0] or 0
    large = nodes.join(sizes.filter(F.col("n_label") > BLOCK), ["label", "dim"])
    share = F.least(F.ceil(F.col("n_label") / BLOCK), F.floor(F.lit(PIVOTS // 2) * F.col("n_label") / max(total, 1)))
    # drawn by hash with twice the share's chance, about PIVOTS rows in all; the first of them are taken
    draw = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 40))
    chance = 2 * F.col("share") / F.col("n_label")
    rows = (large.withColumn("share", share).filter(draw < chance * (1 << 40))
                 .select("label", "dim", "share", "v", draw.alias("draw"), "node").collect())
    found: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: (r["draw"], r["node"])):
        mine = found.setdefault((r["label"], r["dim"]), [])
        if len(mine) < r["share"]:
            mine.append(r["v"])
    return {k: unit(np.array(v, dtype=np.float64)) for k, v in found.items() if len(v) > 1}


def _angles(v, at: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    u = unit(np.stack(v.to_numpy()[at]).astype(np.float64))
    return np.arccos(np.clip(u @ pivots.T, -1, 1))


def _pieces(pdf: pd.DataFrame, known: dict):
    """(key, rows) of the rows whose (label, dim) is in ``known``."""
    for key, at in pdf.groupby(["label", "dim"], sort=False).indices.items():
        if key in known:
            yield key, at


def exact_pairs(spark: SparkSession, stored: DataFrame, pivots) -> DataFrame:
    """``stored`` with its block, once for each block it must be compared with (``other``)."""
    counts = (stored.groupBy("label", "dim", "shell").agg(F.count(F.lit(1)).alias("n"))
                   .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    whole = Window.partitionBy("label", "dim")  # a label has at most 37 shells for each of its pivots
    before = whole.orderBy("shell").rowsBetween(Window.unboundedPreceding, -1)
    counts = staged(spark, counts.select("label", "dim", "shell", "blocks",
                                         F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int").alias("start"),
                                         F.sum("blocks").over(whole).cast("int").alias("all_blocks")), "vec-blocks")
    shelled = sorted(pivots.value)
    known: dict[tuple, list] = {k: [] for k in shelled}
    if known:  # at most 37 * PIVOTS rows
        named = spark.createDataFrame(shelled, counts.select("label", "dim").schema)
        for r in counts.join(F.broadcast(named), ["label", "dim"], "left_semi").collect():
            known[r["label"], r["dim"]].append((r["shell"], r["start"], r["blocks"]))
    table = spark.sparkContext.broadcast({k: np.array(sorted(v), dtype=np.int64) for k, v in known.items()})

    def visits(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 256):  # a row may visit many blocks
                part = pdf.iloc[i:i + 256].reset_index(drop=True)
                others = [np.empty(0, dtype=np.int32)] * len(part)
                for key, at in _pieces(part, table.value):
                    shell, start, blocks = table.value[key].T
                    angle = _angles(part["v"], at, pivots.value[key])[:, shell // (SHELLS + 1)]
                    low = shell % (SHELLS + 1) * SHELL
                    meet = (angle >= low - ANGLE) & (angle <= low + SHELL + ANGLE)
                    for row, m in zip(at, meet):
                        others[row] = np.concatenate([np.arange(s, s + n, dtype=np.int32)
                                                      for s, n in zip(start[m], blocks[m])])
                yield part.assign(others=others)

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema)
    placed = stored.join(counts, ["label", "dim", "shell"])
    block = F.col("start") + F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = placed.select(*stored.columns, "all_blocks", block.alias("block"))
    placed = placed.mapInPandas(visits, f"{kind}, all_blocks int, block int, others array<int>")
    every = F.sequence(F.lit(0), F.col("all_blocks") - 1)  # a label without pivots is compared completely
    others = F.when(F.size("others") > 0, F.col("others")).otherwise(every)
    return placed.select(*stored.columns, "block", F.lit(0).alias("tab"), F.lit(0).cast("long").alias("cell"),
                         F.explode(others).alias("other"))


def sign_pairs(stored: DataFrame) -> DataFrame:
    """The same within the cells of each table."""
    placed = stored.select("*", F.posexplode("cells").alias("tab", "cell"))
    n_blocks = (placed.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n"))
                      .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"))
    placed = placed.join(n_blocks, PLACE)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))


def embedding_classes(spark: SparkSession, vectors: DataFrame, miss: float = 0.0) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    ``miss`` 0 finds every link; above 0 it bounds the chance that a link in a
    label of more than ``CELL`` distinct vectors is lost.
    """
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(ok, F.lit(False)).alias("ok"))
    good = rows.filter("ok")
    nodes = (good.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("first"))
                 .withColumn("dim", F.size("embedding")).withColumnRenamed("embedding", "v"))
    nodes = staged(spark, nodes.withColumn("node", F.monotonically_increasing_id()), "vec-nodes")
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n_label"))
    kind = nodes.schema["v"].dataType.simpleString()
    label = nodes.schema["label"].dataType.simpleString()
    stored = nodes.join(sizes, ["label", "dim"]).select("node", "label", "dim", "n_label", "mult", "v")
    pivots = spark.sparkContext.broadcast({} if miss > 0 else pivots_of(nodes, sizes))
    stored = stored.mapInPandas(_encoder(miss, pivots), f"node long, label {label}, dim int, n_label long, mult long, v {kind}, "
                                                "code binary, factor double, cells array<bigint>, shell long")
    stored = staged(spark, stored, "vec-codes")

    # (label, dim, table, cell) -> blocks -> pairs of blocks
    placed = sign_pairs(stored) if miss > 0 else exact_pairs(spark, stored, pivots)
    placed = (placed.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
                    .select(*PLACE, "bi", "bj", "block", "node", "mult", "v", "code", "factor", "cells"))
    found = placed.groupBy(*PLACE, "bi", "bj").applyInPandas(_compare, "node long, links long, root long")
    found = staged(spark, found, "vec-links")

    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    label_of = components(spark, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = (nodes.select("node", "label", F.col("v").alias("embedding"), "mult", "first")
                  .join(label_of.withColumnRenamed("label", "comp"), "node", "left")
                  .join(degree, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = named.join(least, "comp").select(
        "label", "embedding", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = good.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                             F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_classes(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
