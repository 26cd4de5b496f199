"""Merkle manifest of a document table, with nested-interval labels.

Every row is a leaf; the leaves of a source ascend by doc_id and form a tree
with a fan-out of three, and the sources' roots form one more tree above
them.  A node is labelled by the interval [lo, hi) of the leaf ranks that it
covers: the node j of level k covers [j * 3^k, (j + 1) * 3^k), cut at the
number of leaves.  So containment of intervals is ancestry, and no parent
links are stored.

* Ranks come from :func:`..operators.ordinals.numbered`: a source that holds
  a third of all rows is dealt to many tasks.
* Climbing: six levels make a bucket.  Nodes are grouped by (tree, rank
  div 3^6), at most 729 in a group, and the six levels above them are hashed
  in that row.  The bucket's top is a node of the next climb, so 10^9 leaves
  take four climbs, each a small written table.
* Descending: each bucket of a climb joins the node that covers the same
  interval in the climb above and takes over its ancestors.  A node has at
  most 729 rows below it in such a join, so no key is hot, although all
  leaves share the root.
* Siblings: within the parent's interval, what the node's own interval
  leaves on the left and on the right.

Only digests are shuffled; texts are read once, where they lie.

Defined results: a NULL field is ``-`` in the leaf, so NULL and empty texts
differ; NULL doc_ids come first in their source, and rows with equal doc_id
ascend by leaf; NULL is a source of its own; a single leaf is its source's
root, and a single source's root is the root; rows that repeat are leaves
of their own; other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordinals import numbered
from .common import staged

FAN = 3               # FIXED VALUE: children of a node
LEVELS = 6            # levels hashed in one bucket
WIDE = FAN ** LEVELS  # nodes of a bucket
TREE = ["no_source", "src"]
STEP = "struct<left:string,right:string>"


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it, or ``-``."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a row of ``documents`` with ``text`` in the place of its text."""
    fields = [field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)]
    return F.sha2(F.concat(*fields), 256)


def _parents(digests: Column) -> Column:
    """The digests of every three consecutive nodes (the last run may be shorter)."""
    starts = F.sequence(F.lit(1), F.size(digests), F.lit(FAN))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(digests, i, F.lit(FAN)), ""), 256))


def _buckets(items: DataFrame, tree: list[str], carry: list[str]) -> DataFrame:
    """Nodes (tree, rank, n, leaves, digest, carried columns) by bucket, with the levels above them.

    ``n`` is the number of nodes of the tree at this height.  ``l0`` has the
    nodes' digests in order and ``l1`` to ``l6`` those of the next levels; a
    tree that has one node left stays as it is.
    """
    node = F.struct("rank", "digest", *carry)
    out = items.groupBy(*tree, F.floor(F.col("rank") / WIDE).alias("bucket")).agg(
        F.max("n").alias("n"), F.max("leaves").alias("leaves"), F.array_sort(F.collect_list(node)).alias("kids"))
    out = out.withColumn("l0", F.transform("kids", lambda x: x.digest))
    for k in range(LEVELS):
        out = out.withColumn(f"l{k + 1}", F.when(F.col("n") > FAN ** k, _parents(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
    return out if carry else out.drop("kids")


def climb(spark: SparkSession, items: DataFrame, tree: list[str], carry: list[str]) -> list[DataFrame]:
    """The bucket tables from the leaves (rank, n, digest, carried columns) to the root of every tree; each is written."""
    items, steps = items.withColumn("leaves", F.col("n")), []
    while True:
        step = staged(spark, _buckets(items, tree, carry), "merkle")
        steps.append(step)
        if step.filter(F.col("n") > WIDE).isEmpty():
            return steps
        items = step.select(*tree, F.col("bucket").alias("rank"), F.ceil(F.col("n") / WIDE).alias("n"), "leaves",
                            F.get("l6", 0).alias("digest"))
        carry = []


def roots(steps: list[DataFrame], tree: list[str]) -> DataFrame:
    """(tree, root): one row for each tree."""
    return steps[-1].select(*tree, F.get("l6", 0).alias("root"))


def _siblings(i: Column) -> Column:
    """[(digests left of the node, digests right of it)] in each of the bucket's levels, for its node ``i``.

    At level k the node covers place j = i div 3^k and its parent the places
    p to p + 2; the difference of the two intervals is [p, j) and (j, p + 2].
    """
    out = []
    for k in range(LEVELS):
        j = F.floor(i / FAN ** k).cast("int")
        p = j - F.pmod(j, F.lit(FAN))
        level = F.col(f"l{k}")
        step = F.struct(F.array_join(F.slice(level, p + 1, j - p), "").alias("left"),
                        F.array_join(F.slice(level, j + 2, p + FAN - 1 - j), "").alias("right"))
        out.append(F.when(F.col("n") > FAN ** k, step))
    return F.filter(F.array(*out), lambda s: s.isNotNull())


def descend(steps: list[DataFrame], tree: list[str], tops: DataFrame, given: list[str]) -> DataFrame:
    """One row for each leaf: what it carries, ``path`` and the ``given`` columns of its tree's row in ``tops``.

    ``tops`` is (tree, path, given...): the steps above each tree's root.
    ``path`` has a step for each level, from the leaf up.
    """
    above = tops.select(*tree, F.lit(0).cast("long").alias("bucket"), F.col("path").alias("above"), *given)
    for depth, step in enumerate(reversed(steps)):
        joined = step.join(above, [*tree, "bucket"])
        if depth == len(steps) - 1:
            kids = F.transform("kids", lambda x, i: F.struct(x.alias("kid"), F.concat(_siblings(i), F.col("above")).alias("path")))
        else:
            at = F.col("bucket") * WIDE
            kids = F.transform("l0", lambda x, i: F.struct((at + i).alias("bucket"),
                                                           F.concat(_siblings(i), F.col("above")).alias("above")))
        above = joined.select(*tree, *given, F.explode(kids).alias("_k")).select(*tree, *given, "_k.*")
    return above


class Manifest:
    """The trees of one document table: ``steps`` by source and ``top_steps`` above the sources.

    ``altered`` is a second text for every row (its leaf is carried along), e.g. one to be checked.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, altered: Column | None = None):
        own = leaf(F.col("text"))
        rows = docs.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"),
                           "doc_id", own.alias("digest"), (own if altered is None else leaf(altered)).alias("altered"))
        # NULL first: no_source is true there, and false sorts before true
        ranked = numbered(rows, [F.col("doc_id"), F.col("digest")], [F.col(c) for c in TREE], "rank", "n")
        self.steps = climb(spark, ranked, TREE, ["doc_id", "altered"])
        subroots = roots(self.steps, TREE).withColumn("subroot", F.col("root"))
        order = [~F.col("no_source"), F.col("src")]
        top = numbered(subroots.withColumnRenamed("root", "digest"), order, ordinal="rank", total="n")
        self.top_steps = climb(spark, top, [], [*TREE, "subroot"])
        self.root = roots(self.top_steps, [])

    def proofs(self) -> DataFrame:
        """One row for each leaf: doc_id, no_source, src, leaf, altered, path, subroot, root."""
        start = self.root.select(F.array().cast(f"array<{STEP}>").alias("path"), "root")
        tops = descend(self.top_steps, [], start, ["root"])
        tops = tops.select("kid.no_source", "kid.src", "kid.subroot", "path", "root")
        rows = descend(self.steps, TREE, tops, ["subroot", "root"])
        return rows.select("kid.doc_id", *TREE, F.col("kid.digest").alias("leaf"), "kid.altered", "path",
                           "subroot", "root")

    def nodes(self) -> DataFrame:
        """The manifest itself: (tree, source, level, lo, hi, digest), tree ``source`` or ``root``.

        ``lo`` and ``hi`` bound the covered ranks: of leaves in a source's tree, of sources in the upper one.
        """
        out = None
        for kind, steps in (("source", self.steps), ("root", self.top_steps)):
            source = F.when(~F.col("no_source"), F.col("src")) if kind == "source" else F.lit(None).cast("string")
            for c, step in enumerate(steps):
                for k in range(LEVELS + (c == len(steps) - 1)):
                    level, width = c * LEVELS + k, FAN ** (c * LEVELS + k)
                    # a level exists while more than one node is left below it
                    live = step if level == 0 else step.filter(F.col("leaves") > width // FAN)
                    part = live.select(source.alias("source"), "leaves", "bucket", F.posexplode(f"l{k}"))
                    lo = (F.col("bucket") * FAN ** (LEVELS - k) + F.col("pos")) * width
                    part = part.select(F.lit(kind).alias("tree"), "source", F.lit(level).alias("level"), lo.alias("lo"),
                                       F.least(lo + width, "leaves").alias("hi"), F.col("col").alias("digest"))
                    out = part if out is None else out.union(part)
        return out


def siblings(path: Column) -> Column:
    """All sibling digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, start, lambda a, s: F.sha2(F.concat(s.left, a, s.right), 256))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    altered = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    p = Manifest(spark, docs, altered).proofs()
    p = p.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
                 folded(F.col("altered"), F.col("path")).alias("folded_root"))
    return p.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _climb_sql(tree: str, start: str) -> str:
    """Levels above ``start`` (tree, k, j, n, h): three nodes at a time while more than one is left."""
    return f"""{start} UNION ALL
  SELECT {tree} max(k) + 1, j // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY j))
  FROM {{name}} WHERE n > 1 GROUP BY {tree} j // 3"""


def _steps_sql(tree: str, name: str) -> str:
    same = "s.source IS NOT DISTINCT FROM o.source AND " if tree else ""
    return f"""SELECT {tree and 'o.source,'} o.k, o.j,
         coalesce(string_agg(s.h, '' ORDER BY s.j) FILTER (s.j < o.j), '') || '|'
         || coalesce(string_agg(s.h, '' ORDER BY s.j) FILTER (s.j > o.j), '') AS step
  FROM {name} o LEFT JOIN {name} s ON {same} s.k = o.k AND s.j // 3 = o.j // 3 AND s.j <> o.j
  WHERE o.n > 1 GROUP BY {tree and 'o.source,'} o.k, o.j"""


_CRC_SQL = """xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda a, e:
    xor(xor(a, e) >> 1, CASE WHEN xor(a, e) % 2 = 1 THEN 3988292384 ELSE 0 END)))"""

OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
         CASE WHEN {_CRC_SQL} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")}
              ELSE {_leaf_sql('text')} END AS altered FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
         count(*) OVER (PARTITION BY source) AS n FROM d),
lv AS (
  {_climb_sql('source,', 'SELECT source, 0 AS k, r AS j, n, leaf AS h FROM r').format(name='lv')}),
subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n
  FROM lv WHERE n = 1),
up AS (
  {_climb_sql('', 'SELECT 0 AS k, r AS j, n, subroot AS h FROM subroots').format(name='up')}),
steps AS ({_steps_sql('source,', 'lv')}),
up_steps AS ({_steps_sql('', 'up')}),
low AS (
  SELECT r.source, r.r, list(step ORDER BY k) AS path FROM r JOIN steps s
  ON s.source IS NOT DISTINCT FROM r.source AND s.j = r.r // pow(3, s.k)::BIGINT GROUP BY r.source, r.r),
high AS (
  SELECT t.r, list(step ORDER BY k) AS path FROM subroots t JOIN up_steps s ON s.j = t.r // pow(3, s.k)::BIGINT
  GROUP BY t.r),
p AS (
  SELECT r.*, t.subroot, (SELECT h FROM up WHERE n = 1) AS root,
         coalesce(low.path, []) || coalesce(high.path, []) AS path
  FROM r JOIN subroots t ON t.source IS NOT DISTINCT FROM r.source
  LEFT JOIN low ON low.source IS NOT DISTINCT FROM r.source AND low.r = r.r LEFT JOIN high ON high.r = t.r),
f AS (
  SELECT *, list_reduce([altered] || path, lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2)))
         AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM f
"""
