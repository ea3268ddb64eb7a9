import numpy as np
import pytest
from brute import Forest

from bytequarry.llm import covertree
from bytequarry.llm.covertree import embedding_duplicates


def brute(rows, cosine):
    good = {i: np.array(v, float) for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    f, n = Forest(), {}
    for i, a in good.items():
        n[i] = sum(j != i and len(a) == len(b) and a @ b >= cosine * np.sqrt(a @ a) * np.sqrt(b @ b) for j, b in good.items())
        for j, b in good.items():
            if i < j and len(a) == len(b) and a @ b >= cosine * np.sqrt(a @ a) * np.sqrt(b @ b):
                f.join(i, j)
    return sorted((v, n.get(i, 0), min(rows[k][0] for k in range(len(rows)) if f.root(k) == f.root(i))) for i, (v, _) in enumerate(rows))


def vectors(seed, dim):
    r = np.random.default_rng(seed)
    out = [r.normal(size=dim) for _ in range(120)]
    for _ in range(6):
        c = r.normal(size=dim)
        out += [c + r.normal(size=dim) * s for s in r.choice([0, 0.05, 0.2, 0.3], 30)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]
    return rows + [(900, None), (901, []), (902, [0.0] * dim), (903, [None] * dim), (904, [float("nan")] * dim), (905, [float("inf")] + [1.0] * (dim - 1)), (906, rows[0][1] + [0.0]), (907, rows[0][1] + [1e-9]), (5, rows[5][1]), (908, [-x for x in rows[3][1]]), (909, [x * 1e-30 for x in rows[3][1]])]


@pytest.mark.parametrize(("dim", "cosine", "least"), [(8, 0.95, 256), (3, 0.99, 16), (16, 0.8, 40)])
def test_against_all_pairs(spark, monkeypatch, dim, cosine, least):
    monkeypatch.setattr(covertree, "LEAST", least)
    rows = vectors(dim, dim)
    df = spark.createDataFrame([(d, v, 1, 2) for d, v in rows], "vec_id long, embedding array<double>, row int, cell int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_duplicates(df, cosine).collect())
    assert got == brute(rows, cosine)


def test_empty_and_unusable(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_duplicates(spark.createDataFrame([], schema)).collect() == []
    got = embedding_duplicates(spark.createDataFrame([(1, None), (None, [1.0]), (2, [0.0])], schema)).collect()
    assert sorted((tuple(r) for r in got), key=str) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]
    got = embedding_duplicates(spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (7, [2.0, 4.0]), (None, [-1.0, 0.0]), (None, [-1.0, 0.0])], schema)).collect()
    assert sorted((tuple(r) for r in got), key=str) == [(7, 2, 7, True), (None, 1, None, False), (None, 1, None, True), (None, 2, 7, False), (None, 2, 7, False)]


def test_cells_are_divided_and_dense_ones_taken_whole(spark, monkeypatch):
    """Small bounds make several levels of cells; a dense cluster and copies are counted without all pairs."""
    for name, value in (("LEAST", 8), ("MOST", 24), ("SAMPLE", 60), ("CENTRES", 5), ("CHUNK", 50)):
        monkeypatch.setattr(covertree, name, value)
    r = np.random.default_rng(5)
    centres = r.normal(size=(9, 6))
    rows = [(i, (centres[i % 9] + r.normal(size=6) * 0.12).tolist()) for i in range(260)]
    rows += [(300 + i, (centres[0] + r.normal(size=6) * 1e-4).tolist()) for i in range(60)] + [(400 + i, rows[1][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in embedding_duplicates(df, 0.97).collect())
    assert got == brute(rows, 0.97)


def test_pruning_before_the_shuffle(spark, monkeypatch):
    """Of far clusters only cells of one cluster meet, and cells meet no more others when there are four times the clusters."""
    monkeypatch.setattr(covertree, "LEAST", 8)
    r, share = np.random.default_rng(6), []
    for clusters in (12, 48):
        c = np.linalg.qr(r.normal(size=(64, 64)))[0][:clusters]
        x = np.repeat(c, 40, axis=0) + r.normal(size=(clusters * 40, 64)) * 0.01
        rows = [(i, 64, v.tobytes(), 1) for i, v in enumerate(x)]
        placed, nodes = covertree.divided(spark.createDataFrame(rows, "row long, dim int, data binary, w long"), 40)
        blocks = placed.groupBy("cell").agg(covertree.F.count("*").cast("int").alias("n"))
        of = {}
        for p in placed.collect():
            of.setdefault(p.cell, set()).add(p.row // 40)
        met = [(p.c1, p.c2) for p in covertree.surviving(blocks, nodes, 0.32).collect()]
        assert len(met) == len(set(met)) and all(a <= b and of[a] & of[b] for a, b in met)
        share.append(len(met) / len(of))
    assert share[1] < 1.5 * share[0]
