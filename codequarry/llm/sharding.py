"""Resharding by minimum-cost flow.

The old shards have sizes, the new ones capacities.  A flow network with one
arc old_i -> new_i at no cost (the bytes stay) and a hub through which every
other transfer passes at cost 1 a byte is solved on the driver; its size is
the number of shards, not of rows.  The flows are carried out on blocks: the
rows of an old shard, in the order of a hash key, are dealt into blocks of
about ``BLOCK_BYTES``; prefix sums over blocks and then inside each block
give every row an offset in its old shard, and the flows out of that shard
are intervals of those offsets.  Only shards with a flow in or out are
rewritten.

No interval may end inside a large row, one above a 64th of a shard (at most
64 for each new shard).  The flow is solved on all bytes, then rounded for
these rows one by one: they stay as far as the flow lets bytes of their shard
stay, the others fill the shards with most room left beside what stays, and a
second flow carries the small rows around them.  The rounding is greedy: an
overfull shard may send one large row's bytes more than the flow, and sizes
differ by about two such rows.  A single row beyond a whole shard's share gets a
shard to itself, its own if free, and the rest is levelled over the others.

Law: ``bytes``.  Size of a row: UTF-8 bytes of its text (NULL: none) plus 8.
Defined results: rows that repeat are rows of their own; a NULL ``doc_id``
is an id like any other; an empty table gives an empty layout.  Equal texts
may go to different shards: the method moves bytes, not groups, and a group
may hold more than a shard.
"""

from __future__ import annotations

import heapq
import uuid
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import shuffle_partitions, staged

N_SHARDS = 24
N_OLD = 17
BLOCK_BYTES = 8 << 20
PART_BYTES = 128 << 20
LARGE = 64  # a row above 1/64 of a shard is placed by itself
ROW_BYTES = 8
OLD, OLD_FILE = "__old_shard", "__old_file"


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


# --- the network, of shards only --------------------------------------------

class FlowNetwork:
    """Minimum-cost maximum flow: shortest-path distances, then blocking flow on tight arcs."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def flow_on(self, e: int) -> int:
        return self.cap[e ^ 1]

    def _distances(self, s: int) -> list[float]:
        dist, queue, queued = [float("inf")] * len(self.out), deque([s]), {s}
        dist[s] = 0
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in self.out[a]:
                b = self.to[e]
                if self.cap[e] and dist[a] + self.cost[e] < dist[b]:
                    dist[b] = dist[a] + self.cost[e]
                    if b not in queued:
                        queued.add(b)
                        queue.append(b)
        return dist

    def solve(self, s: int, t: int) -> int:
        """Push all the flow there is; its cost."""
        total = 0
        while True:
            dist = self._distances(s)
            if dist[t] == float("inf"):
                return total
            at = [0] * len(self.out)
            while path := self._tight_path(s, t, dist, at):
                f = min(self.cap[e] for e in path)
                for e in path:
                    self.cap[e] -= f
                    self.cap[e ^ 1] += f
                    total += f * self.cost[e]

    def _tight_path(self, s: int, t: int, dist: list[float], at: list[int]) -> list[int]:
        path, here, seen = [], s, {s}
        while here != t:
            while at[here] < len(self.out[here]):
                e = self.out[here][at[here]]
                b = self.to[e]
                if self.cap[e] and b not in seen and dist[here] + self.cost[e] == dist[b]:
                    path.append(e)
                    seen.add(b)
                    here = b
                    break
                at[here] += 1
            else:
                if not path:
                    return []
                e = path.pop()
                seen.discard(here)
                here = self.to[e ^ 1]
                at[here] += 1
        return path


def transfers(supply: list[int], room: list[int]) -> list[tuple[int, int, int]]:
    """(old, new, bytes) of a flow that moves the fewest bytes; what stays has old == new.

    ``room`` must hold all of ``supply``.
    """
    n, m = len(supply), len(room)
    hub, s, t = n + m, n + m + 1, n + m + 2
    g = FlowNetwork(n + m + 3)
    stay, leave, enter = {}, {}, {}
    for i, b in enumerate(supply):
        g.arc(s, i, b, 0)
        if i < m:
            stay[i] = g.arc(i, n + i, b, 0)
        leave[i] = g.arc(i, hub, b, 1)
    for j, c in enumerate(room):
        enter[j] = g.arc(hub, n + j, c, 0)
        g.arc(n + j, t, c, 0)
    g.solve(s, t)
    out = [(i, i, g.flow_on(e)) for i, e in stay.items() if g.flow_on(e)]
    # the hub's inflow and outflow, paired in shard order
    need = deque((j, g.flow_on(e)) for j, e in enter.items() if g.flow_on(e))
    for i, e in leave.items():
        left = g.flow_on(e)
        while left:
            j, r = need.popleft()
            f = min(left, r)
            out.append((i, j, f))
            left -= f
            if r > f:
                need.appendleft((j, r - f))
    return out


def level_room(total: int, taken: list[int]) -> list[int]:
    """Room that levels the shards: fills the lowest first until ``total`` more bytes fit."""
    order, level, rest = sorted(taken), 0, total
    for k in range(len(order)):
        level = (sum(order[: k + 1]) + rest) // (k + 1)
        if k + 1 == len(order) or level <= order[k + 1]:
            break
    room = [max(0, level - x) for x in taken]
    short = total - sum(room)
    for j in sorted(range(len(taken)), key=lambda j: (taken[j] + room[j], j))[:max(0, short)]:
        room[j] += 1
    return room


def place_large(large: list[tuple[int, str, int]], sizes: list[int], n_new: int) -> dict[tuple[str, int], int]:
    """Shard and size of each large row (old, key, size), repeats numbered.

    The flow on all bytes says how much of each old shard stays.  Its large rows stay, largest
    first, as far as they fit that; the others go where most room is left beside what stays.
    """
    rows, seen = [], {}
    for old, key, size in sorted(large, key=lambda r: (-r[2], r[1])):
        no = seen[(old, key)] = seen.get((old, key), 0) + 1
        rows.append((old, key, no, size))
    supply, rest, n_alone = list(sizes), sum(sizes), 0
    while n_alone < len(rows) and rows[n_alone][3] * (n_new - n_alone) > rest:  # beyond an even share of what is left
        supply[rows[n_alone][0]] -= rows[n_alone][3]
        rest -= rows[n_alone][3]
        n_alone += 1
    out, taken, leaving = {}, [0] * n_new, []
    for old, key, no, size in rows[:n_alone]:
        if old < n_new and not taken[old]:
            taken[old] = size
            out[(old, key, no)] = (old, size)
        else:
            leaving.append((old, key, no, size))
    for old, key, no, size in leaving:
        j = min((j for j in range(n_new) if not taken[j]), key=lambda j: (supply[j] if j < len(supply) else 0, j))
        taken[j] = size
        out[(old, key, no)] = (j, size)

    room = level_room(rest, taken)
    stay = {i: f for i, j, f in transfers(supply, room) if i == j}
    kept, leaving, small = [0] * len(sizes), [], list(supply)
    for old, key, no, size in rows[n_alone:]:
        small[old] -= size
        if kept[old] + size <= stay.get(old, 0):
            kept[old] += size
            out[(old, key, no)] = (old, size)
        else:
            leaving.append((old, key, no, size))
    for i, f in stay.items():
        room[i] -= min(f, kept[i] + small[i])
    heap = [(-r, j) for j, r in enumerate(room)]
    heapq.heapify(heap)
    for old, key, no, size in leaving:
        left, j = heapq.heappop(heap)
        heapq.heappush(heap, (left + size, j))
        out[(old, key, no)] = (j, size)
    return out


# --- the rows ---------------------------------------------------------------

class Resharding:
    """A solved resharding: ``transfers`` (old, new, bytes) of all rows, ``path`` of the rewritten shards
    (``shard=k`` folders), ``untouched`` shards, and ``layout``, all rows as struct ``_row`` with
    shard, old, block and rn."""

    def __init__(self, moves, path, layout, untouched):
        self.transfers, self.path, self.layout, self.untouched = moves, path, layout, untouched

    def rows(self, *cols: Column) -> DataFrame:
        """``cols`` (of ``_row``) with shard and slot; slots run from 0 without gaps in each shard.

        A shard holds its blocks in order, so a row's slot is its block's start plus its place in
        the block.  Only ``cols`` are shuffled, not the texts.
        """
        group = ["shard", "old", "block"]
        counts = self.layout.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first"))
        earlier = Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, -1)
        base = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
        slim = self.layout.select(F.struct(*cols).alias("_out"), "rn", *group)
        slot = (F.col("base") + F.col("rn") - F.col("first")).cast("long")
        return slim.join(base, group).select("_out.*", "shard", slot.alias("slot"))


def reshard(spark: SparkSession, docs: DataFrame, old: str, n_new: int = N_SHARDS) -> Resharding:
    """Move ``docs`` from the shards numbered in column ``old`` (0, 1, ...) into ``n_new`` shards.

    The rows cross one shuffle, by (old shard, block), and are written once.
    """
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("string")
    key = F.md5(F.concat_ws(":", F.lit("shard-1"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), crc)
                .cast("binary"))
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    full = docs.select(row.alias("_row"), F.col(old).cast("int").alias("old"), row_size(F.col("text")).alias("size"),
                       key.alias("key"))
    slim = staged(spark, full.select("old", "size", "key"), "shard-sizes")

    sums = {r["old"]: r["b"] for r in slim.groupBy("old").agg(F.sum("size").alias("b")).collect()}
    n_old = max(sums, default=-1) + 1
    sizes = [sums.get(i, 0) for i in range(n_old)]
    large_from = max(1, sum(sizes) // (n_new * LARGE))
    # at most n_new * LARGE rows can be this large
    large = [(r["old"], r["key"], r["size"]) for r in slim.filter(F.col("size") > large_from).collect()]
    placed = place_large(large, sizes, n_new)
    taken = [0] * n_new
    for j, size in placed.values():
        taken[j] += size
    supply = list(sizes)
    for i, _, size in large:
        supply[i] -= size
    moves = transfers(supply, level_room(sum(supply), taken))

    olds = spark.createDataFrame([(i, max(1, -(-b // BLOCK_BYTES))) for i, b in enumerate(supply)] or [(0, 1)],
                                 "old int, n_blocks long")
    pieces, at = [], {}
    for i, j, f in moves:
        pieces.append((i, at.get(i, 0), at.get(i, 0) + f, j))
        at[i] = at.get(i, 0) + f
    pieces_df = spark.createDataFrame(pieces or [(-1, 0, 0, 0)], "old int, lo long, hi long, shard int")
    placed_df = spark.createDataFrame([(i, k, no, j) for (i, k, no), (j, _) in placed.items()] or [(-1, "", 0, 0)],
                                      "old int, key string, rn int, big_shard int")

    def blocked(df: DataFrame) -> DataFrame:
        """With ``block``: a range of the hash key, or a large row's own key."""
        at = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("n_blocks") / F.lit(2.0 ** 32)
        small = F.concat(F.lit("s"), F.lpad(F.floor(at).cast("string"), 12, "0"))
        return (df.join(F.broadcast(olds), "old")
                  .withColumn("block", F.when(F.col("size") > large_from, F.concat(F.lit("x"), "key")).otherwise(small))
                  .drop("n_blocks"))

    prior = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (blocked(slim.filter(F.col("size") <= large_from)).groupBy("old", "block")
              .agg(F.sum("size").alias("b"))
              .withColumn("start", F.coalesce(F.sum("b").over(prior), F.lit(0))).drop("b"))
    inside = Window.partitionBy("old", "block").orderBy("key")
    # the texts' one shuffle: as many parts as keep each near PART_BYTES
    parts = max(shuffle_partitions(spark), sum(sizes) // PART_BYTES + 1)
    rows = (blocked(full).repartition(parts, "old", "block")
            .withColumn("rn", F.row_number().over(inside))
            .withColumn("within", F.coalesce(F.sum("size").over(
                inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .join(starts, ["old", "block"], "left"))
    mid = F.col("start") + F.col("within") + F.col("size") / 2
    rows = (rows.withColumn("mid", mid)
                .join(F.broadcast(pieces_df.withColumnRenamed("old", "p_old")),
                      (F.col("old") == F.col("p_old")) & (F.col("mid") >= F.col("lo")) & (F.col("mid") < F.col("hi")),
                      "left")
                .join(F.broadcast(placed_df), ["old", "key", "rn"], "left"))
    rows = rows.select("_row", "old", "block", "rn", F.coalesce("big_shard", "shard").alias("shard"))

    touched = {i for i, j, _ in moves if i != j} | {j for i, j, _ in moves if i != j}
    for (i, _, _), (j, _) in placed.items():
        if i != j:
            touched |= {i, j}
    untouched = [i for i in range(min(n_old, n_new)) if i not in touched]
    path = scratch_path(spark, f"shards-{uuid.uuid4().hex}")
    moved = rows.filter(~F.col("old").isin(untouched)) if untouched else rows
    moved.write.partitionBy("shard").parquet(path)
    layout = spark.read.schema(rows.schema).parquet(path)
    if untouched:
        layout = layout.unionByName(rows.filter(F.col("old").isin(untouched)))

    carried: dict[tuple[int, int], int] = {}
    for i, j, f in [*moves, *((i, j, size) for (i, _, _), (j, size) in placed.items())]:
        carried[(i, j)] = carried.get((i, j), 0) + f
    return Resharding([(i, j, f) for (i, j), f in sorted(carried.items())], path, layout, untouched)


def by_file(spark: SparkSession, path: str) -> DataFrame:
    """The table with ``OLD``: each of its files is an old shard, numbered in the order of their paths."""
    docs = spark.read.parquet(path)
    named = docs.select("*", docs.metadataColumn("_metadata")["file_path"].alias(OLD_FILE))
    names = sorted(r[0] for r in named.select(OLD_FILE).distinct().collect())  # one row for each file
    index = spark.createDataFrame([(n, i) for i, n in enumerate(names)] or [("", 0)], f"{OLD_FILE} string, {OLD} int")
    return named.join(F.broadcast(index), OLD_FILE).drop(OLD_FILE)


def dealt(docs: DataFrame, n_old: int = N_OLD) -> DataFrame:
    """The table with ``OLD``: ``n_old`` old shards of uneven sizes, by hash of the row.

    Shard k of n holds a share of about sqrt((k + 1) / n) - sqrt(k / n) of the rows, so
    the first of 17 holds about a quarter and the last a 34th.
    """
    u = F.pmod(F.xxhash64(F.lit("old"), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return docs.withColumn(OLD, F.floor(F.lit(n_old) * u * u).cast("int"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in 24 shards of near equal bytes, from ``N_OLD`` uneven ones.

    The old layout is dealt by hash, as the tables' files (one, as a rule) hold none.
    """
    r = reshard(spark, dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")), OLD, N_SHARDS)
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    out = r.rows(F.col("_row.doc_id").alias("doc_id"), row_size(F.col("_row.text")).alias("size"),
                 F.crc32(text.cast("binary")).alias("text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
