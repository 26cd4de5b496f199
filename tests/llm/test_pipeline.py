import hashlib
import math
import re
import struct
from collections import Counter

import pytest

import corpus_pipeline as P
import __spark_entry__ as entry
from codequarry.llm import bpe, quality
from codequarry.llm.common import held_out, join_hot, keep_rows, row_digest, training_row

from .test_mixing import water_fill
from .test_near_dedup import brute_classes

tokenizers = pytest.importorskip("tokenizers")


def test_registered_and_staged():
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "bpe"]
    names = set(entry.queries())
    assert {"pipeline"} <= names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))


def test_stages_pass_odd_rows_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        for name, stage in P.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            if name != "bpe":
                assert out.columns == docs.columns
            assert out.count() >= (0 if docs is none else 1)


def plain_exact(rows):
    """Of texts equal without white space the longest stays, then the smallest doc_id."""
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        if key not in best or (-len(r[1] or ""), r[0]) < (-len(best[key][1] or ""), best[key][0]):
            best[key] = r
    return list(best.values())


def plain_near(rows):
    """One row of each class of all-pairs near copies: the smallest doc_id."""
    first = brute_classes([(d, t) for d, t, _ in rows])
    return [r for r, c in zip(rows, first) if r[0] == c]


def plain_mix(rows):
    """Each source shuffled by hash and repeated, the last document cut, up to its target in words."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    md5 = lambda s: hashlib.md5(s.encode("utf-8")).hexdigest()
    by = {}
    for d, t, s in rows:
        by.setdefault(s, []).append((md5(f"mix-1:{d}:{md5(t or '')}"), d, t))
    sizes = {s: sum(len(words(t)) for _, _, t in v) for s, v in by.items()}
    out = []
    for s, target in water_fill(sizes).items():
        left = math.floor(target + 0.5)
        while left > 0 and sizes[s]:
            for _, d, t in sorted(by[s]):
                n = len(words(t))
                if n and n <= left:
                    out.append((d, t))
                elif n and left > 0:
                    out.append((d, "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t)[:left])))
                left -= min(n, left)
    return out


def test_run_equals_the_stages_by_hand(spark):
    """Every stage in plain Python on its predecessor's rows; the last one's rows are those of run()."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    good = [r for r in rows if model.score([r[1] or ""])[0] >= quality.THRESHOLD]
    said = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(said.get(r[0]) == 1 for r in good) >= 0.95 * sum(v == 1 for v in said.values()) and len(good) < len(rows)
    exact = plain_exact(good)
    near = plain_near(exact)
    assert len(exact) < len(good) and len(near) < len(exact)
    mix = plain_mix(near)
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    want = Counter()
    for d, t in mix:
        ids = library.encode(t, add_special_tokens=False).ids
        want[(d, len(ids), tuple(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
              hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded_sha256) for r in P.run(spark, sf).collect())
    assert got == want


def test_keep_rows_returns_one_row_for_each_key(spark, odd):
    keys = odd.select(odd.doc_id.alias("_id"), row_digest(odd.text).alias("_dg")).groupBy("_id", "_dg").count()
    out = keep_rows(odd, keys.withColumnRenamed("count", "_reps"))
    assert out.columns == odd.columns and out.count() == keys.count()


def test_learned_and_held_out_rows_do_not_meet(spark):
    rows = spark.range(300).selectExpr("id", "pmod(crc32(cast(cast(id as string) as binary)), 3) = 1 as want")
    got = rows.select("want", training_row(rows.id).alias("t"), held_out(rows.id).alias("h")).collect()
    assert all(r.h == r.want and r.t != r.h for r in got)


def test_hot_keys_are_joined_without_a_shuffle_of_their_rows(spark):
    left = spark.range(3000).selectExpr("if(id % 3 = 0, -1, id) as k", "id")
    right = spark.range(-1, 3000).selectExpr("id as k", "id * 2 as v")
    sizes = left.groupBy("k").count().withColumnRenamed("count", "n")
    got = join_hot(left, right, "k", sizes, 3000, least=10, share=100)
    assert sorted((r.id, r.v) for r in got.collect()) == sorted((i, -2 if i % 3 == 0 else 2 * i) for i in range(3000))
    hot = sizes.filter("n > 30")
    assert [r.k for r in hot.collect()] == [-1]
