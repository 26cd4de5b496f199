import numpy as np
import pandas as pd
import pytest

from codequarry.llm import embedding_dedup as E

MISS = 1e-6


def brute(rows):
    """vec_id -> (links, smallest reachable id), from all pairs."""
    ok = [i for i, (d, v, l) in enumerate(rows) if d is not None and l is not None and v
          and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {d: (0, d) for d, _, _ in rows}
    near = {i: [] for i in ok}
    for i in ok:
        for j in ok:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b):
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    near[i].append(j)
    for i in ok:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[rows[i][0]] = (len(near[i]), min(rows[k][0] for k in seen))
    return out


def vectors(dim, n, seed):
    r = np.random.default_rng(seed)
    rows, centers = [], r.normal(size=(6, dim))
    for i in range(n):
        c = centers[i % 6] if i % 3 else r.normal(size=dim)
        v = np.round(c + r.normal(size=dim) * (0.24 if i % 2 else 0.05), 3)
        rows.append((i, v.tolist(), None if i % 17 == 5 else i % 4))
    rows += [(n + k, rows[k][1], rows[k][2]) for k in (0, 1, 1, 2)]                # copies
    rows += [(n + 10, None, 1), (n + 11, [0.0] * dim, 1), (n + 12, [float("nan")] * dim, 1), (n + 13, [], 1),
             (n + 14, [None] + [1.0] * (dim - 1), 1), (n + 15, [float("inf")] * dim, 1), (n + 16, [1.0], 1),
             (n + 17, [2.0], 1), (n + 18, [-2.0], 1)]
    return rows


@pytest.mark.parametrize("cell,block,miss", [(16384, 1024, 0.0), (16384, 16, 0.0), (12, 4, 0.0), (16384, 16, MISS), (12, 8, MISS)])
def test_links_and_components_match_all_pairs(spark, monkeypatch, cell, block, miss):
    monkeypatch.setattr(E, "CELL", cell)
    monkeypatch.setattr(E, "BLOCK", block)
    rows = vectors(24, 150, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.embedding_classes(spark, df, miss).collect()}
    assert got == brute(rows)


def test_pivots_skip_far_blocks_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 32)
    r = np.random.default_rng(9)
    centers = np.eye(16)[:5] * 10
    rows = [(i, (centers[i % 5] + r.normal(size=16) * 0.6).round(3).tolist(), 0) for i in range(600)]
    rows += [(600 + i, (centers[i % 5] + centers[(i + 1) % 5] + r.normal(size=16)).round(3).tolist(), 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {x.vec_id: (x.n_links, x.component_id) for x in E.embedding_classes(spark, df).collect()}
    assert got == brute(rows)
    kept = {}

    def counted(spark, stored, pivots, real=E.exact_pairs):
        kept["rows"] = (placed := real(spark, stored, pivots)).count()
        kept["blocks"] = placed.select("block").distinct().count()
        return placed

    monkeypatch.setattr(E, "exact_pairs", counted)
    E.embedding_classes(spark, df).count()
    assert kept["rows"] < 0.6 * len(rows) * kept["blocks"]


def test_estimates_are_unbiased_and_the_bound_holds():
    r = np.random.default_rng(5)
    u = E.unit(r.normal(size=(400, 64)))
    v = E.unit(u + r.normal(size=u.shape) * 0.05)
    packed, f = E.codes(v)
    rot = u @ E.rotation(64).T
    est = (rot * E._signs(packed, 64)).sum(axis=1) / 8 / f
    true = (u * v).sum(axis=1)
    assert abs((est - true).mean()) < 0.01
    assert (np.abs(est - true) <= np.sqrt(1 - true ** 2) * np.sqrt(1 - f * f) / f * E.Z / np.sqrt(63)).all()
    assert np.allclose(E.rotation(64) @ E.rotation(64).T, np.eye(64))


def test_more_nodes_get_more_bits_and_enough_tables():
    assert E.tables_for(0, MISS) == (0, 1) and E.tables_for(E.CELL, MISS) == (0, 1)
    assert E.tables_for(E.CELL * 1000, 0.0) == (0, 1)
    for n in (E.CELL * 2, E.CELL * 1000):
        bits, tables = E.tables_for(n, MISS)
        assert n / 2 ** bits <= E.CELL and (1 - E.AGREE ** bits) ** tables <= MISS


@pytest.mark.parametrize("dim,bits", [(64, 11), (16, 16), (2, 5)])
def test_pairs_at_the_threshold_meet_as_often_as_the_tables_assume(dim, bits):
    r = np.random.default_rng(7)
    a = E.unit(r.normal(size=(4000, dim)))
    b = r.normal(size=a.shape)
    b = E.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    b = E.COSINE * a + np.sqrt(1 - E.COSINE ** 2) * b
    pdf = pd.DataFrame({"v": [*a, *b], "label": 0, "dim": dim, "n_label": E.CELL * 2 ** bits})
    cells = np.stack(next(iter(E._encoder(MISS)([pdf])))["cells"].to_numpy())
    assert cells.shape[1] == E.tables_for(E.CELL * 2 ** bits, MISS)[1]
    met = (cells[:len(a)] == cells[len(a):]).mean()
    assert abs(met / E.AGREE ** bits - 1) < (0.2 if dim == 2 else 0.04)


def test_null_ids_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1, 5, "x"), (1, [1.0, 0.0], 1, 5, "x"), (2, [1.0, 0.1], 1, 5, "x")],
                               "vec_id long, embedding array<double>, label int, node long, cells string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.embedding_classes(spark, df).collect()}
    assert got == {None: (0, None, True), 1: (1, 1, True), 2: (1, 1, False)}
    assert E.embedding_classes(spark, df.limit(0)).count() == 0
