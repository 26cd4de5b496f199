import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from codequarry.llm import merkle as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8")).hexdigest()


def leaf(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode('utf-8'))}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def tree(nodes):
    """(root, for each node its steps (left, right)) by plain loops."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, j in enumerate(at):
            p = j - j % 3
            paths[i].append((level[p:j], level[j + 1:p + 3]))
        level = [h(*level[i:i + 3]) for i in range(0, len(level), 3)]
        at = [j // 3 for j in at]
    return level[0], paths


def brute(rows, altered):
    """Multiset of (doc_id, leaf, subroot, root, siblings, folded root)."""
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        ls = sorted(((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), leaf(r, altered(r.text)), r.doc_id) for r in by[s]))
        trees[s] = (ls, *tree([x[2] for x in ls]))
    root, tops = tree([trees[s][1] for s in order])
    out = Counter()
    for s, top in zip(order, tops):
        ls, subroot, paths = trees[s]
        for x, path in zip(ls, paths):
            f, sib = x[3], ""
            for left, right in path + top:
                f, sib = h(*left, f, *right), sib + "".join(left + right)
            out[(x[4], x[2], subroot, root, h(sib), f)] += 1
    return out


def got(spark, docs, altered=None):
    p = M.Manifest(spark, docs, altered).proofs()
    p = p.select("doc_id", "leaf", "subroot", "root", F.sha2(M.siblings(F.col("path")), 256).alias("proof"),
                 M.folded(F.col("altered"), F.col("path")).alias("folded"))
    return Counter(tuple(r) for r in p.collect())


def test_odd_rows(spark, odd):
    swap = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    assert got(spark, odd, swap) == brute(odd.collect(), lambda t: None if t is None else t.replace("\n", ""))


def test_empty_table_one_row_one_source(spark, odd, none):
    assert got(spark, none) == {}
    one = odd.filter("doc_id = 4")
    (r,) = got(spark, one)
    assert r[1] == r[2] == r[3] == r[5] and r[4] == h()
    assert M.Manifest(spark, one).nodes().count() == 2  # the leaf, and the root above its source


def table(spark, sizes, seed=3):
    """Documents by source, with a tree higher than one bucket and many sources."""
    r = random.Random(seed)
    rows = []
    for s, n in sizes.items():
        rows += [(r.randrange(10 ** 9), s, "en", i, f"t{i}\n{s}" if i % 5 else None) for i in range(n)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)


def test_trees_above_one_bucket_and_a_hot_source(spark):
    docs = table(spark, {"hot": 2300, "b": 730, "c": 729, "d": 728, "e": 244, "f": 1, None: 10, "é": 2, "": 3})
    want = brute(docs.collect(), lambda t: t)
    have = got(spark, docs)
    assert have == want
    assert all(x[5] == x[3] for x in have)  # every unaltered leaf leads to the root


def test_many_sources_make_an_upper_tree_of_several_buckets(spark):
    docs = table(spark, {f"s{i:04d}": 1 + i % 3 for i in range(800)})
    assert got(spark, docs) == brute(docs.collect(), lambda t: t)


def test_ranks_do_not_depend_on_partitions(spark):
    docs = table(spark, {"hot": 900, "b": 5})
    assert got(spark, docs.repartition(1)) == got(spark, docs.repartition(40))


def test_intervals_nest(spark):
    docs = table(spark, {"hot": 2300, "b": 5, "f": 1})
    nodes = [r.asDict() for r in M.Manifest(spark, docs).nodes().filter("tree = 'source'").collect()]
    at = {(n["source"], n["level"], n["lo"]): n for n in nodes}
    assert len(at) == len(nodes)
    for n in nodes:
        width = 3 ** n["level"]
        assert n["lo"] % width == 0 and n["hi"] <= n["lo"] + width
        kids = [at[k] for j in range(3) if (k := (n["source"], n["level"] - 1, n["lo"] + j * width // 3)) in at]
        if n["level"]:
            assert kids[0]["lo"] == n["lo"] and kids[-1]["hi"] == n["hi"]
            assert n["digest"] == h(*[k["digest"] for k in kids])
    tops = {n["source"]: n["hi"] - n["lo"] for n in sorted(nodes, key=lambda n: n["level"])}
    assert tops == {"hot": 2300, "b": 5, "f": 1}
