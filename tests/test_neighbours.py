"""Neighbour graphs and the layouts made of them, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import neighbours as nb
from trackloom.operators import projection as pr
from trackloom.operators import umap as um


def table(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], np.sort(d, axis=1)[:, :k]


@pytest.fixture(scope="module")
def groups():
    r = np.random.default_rng(1)
    return np.concatenate([r.normal(size=8) * 3 + r.normal(size=(100, 8)) for _ in range(4)]), np.repeat(np.arange(4), 100)


def test_a_bucket_is_exact(spark, groups):
    x = groups[0][::2]
    at, d = brute(x, 5)
    got = nb.neighbour_graph(table(spark, x), "id", "v", 5).orderBy("node", "d", "other").collect()
    assert [r["other"] for r in got] == at.reshape(-1).tolist() and np.allclose([r["d"] for r in got], d.reshape(-1))


def test_descent_finds_the_neighbours_and_states_its_recall(spark, monkeypatch):
    monkeypatch.setattr(nb, "BUCKET", 40)
    monkeypatch.setattr(nb, "BLOCK", 100)
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(25, 6)).repeat(24, 0) + r.normal(0, 0.5, (600, 6)), np.zeros((60, 6))])  # 60 copies
    rows = table(spark, x)
    graph = nb.neighbour_graph(rows, "id", "v", 10).checkpoint()
    assert graph.groupBy("node").count().where("count <> 10").count() == 0 and graph.where("node = other").count() == 0
    exact = nb.exact_neighbours(rows, "id", "v", 10, F.col("id") % 20 == 0)
    at, d = brute(x, 10)
    want = {int(i): d[i].tolist() for i in range(0, len(x), 20)}
    got = {}
    for q in exact.orderBy("node", "d").collect():
        got.setdefault(q["node"], []).append(q["d"])
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-6) for i in want)
    share = nb.recall(graph, exact).first()
    assert share["queries"] == len(want) and share["neighbours"] == 10 * len(want) and share["recall"] >= 0.95


def test_union_of_weights(spark, groups):
    x, k = groups[0][::4], 6
    at, d = brute(x, k)
    w = np.zeros((len(x), len(x)))
    for i in range(len(x)):
        gap, low, high = d[i] - d[i][0], 1e-9, 1e6
        for _ in range(200):
            s = (low * high) ** 0.5
            low, high = (low, s) if np.exp(-gap / s).sum() > np.log2(k) else (s, high)
        w[i, at[i]] = np.exp(-gap / s)
    w = w + w.T - w * w.T
    got = nb.fuzzy_union(nb.neighbour_graph(table(spark, x), "id", "v", k), k).collect()
    assert len(got) == np.count_nonzero(np.triu(w))
    assert all(abs(r["w"] - w[r["a"], r["b"]]) < 1e-6 for r in got)


def test_curve():
    for least, want in ((0.1, (1.577, 0.895)), (0.5, (0.583, 1.334))):  # what the published fit gives
        assert np.allclose(um.curve(least), want, atol=0.01)


@pytest.mark.parametrize("rows,edges", [(1000, 2000), (70, 12)])
def test_layout_keeps_neighbours(spark, groups, monkeypatch, rows, edges):
    """In one block, and in six with rows that are dealt to several."""
    monkeypatch.setattr(um, "ROWS", rows)
    monkeypatch.setattr(um, "EDGES", edges)
    x, of = groups
    got = {r["key"]: r["y"] for r in um.umap(table(spark, x), "id", "v", exchanges=10).collect()}
    y = np.array([got[i] for i in range(len(x))])
    assert np.isfinite(y).all() and pr.rank_quality(x, y)["trustworthiness"] > 0.85
    at, _ = brute(y, 1)
    assert (of[at[:, 0]] == of).mean() > 0.97


def test_odd_tables(spark):
    shape = "id long, v array<double>, node string"
    assert nb.neighbour_graph(spark.createDataFrame([], shape), "id", "v").count() == 0
    assert um.umap(spark.createDataFrame([], shape), "id", "v").count() == 0
    odd = spark.createDataFrame([(1, [1.0, 2.0], "a"), (None, [1.0, 2.0], "a"), (2, None, "a")], shape)
    assert [r["key"] for r in um.umap(odd, "id", "v").collect()] == [1]
    same = spark.createDataFrame([(i, [1.0, 2.0], "a") for i in range(20)], shape)
    got = um.umap(same, "id", "v", k=5, epochs=20, exchanges=4).collect()
    assert len(got) == 20 and np.isfinite([r["y"] for r in got]).all()


def test_layout_of_few_rows_is_declared_and_scanned(groups):
    from trackloom.operators import registry

    x, of = groups[0][::2], groups[1][::2]
    method = registry.get("umap")
    y = method.run(x, None, **method.filled(len(x), {"epochs": 100}))
    at, _ = brute(y, 1)
    assert pr.rank_quality(x, y)["trustworthiness"] > 0.85 and (of[at[:, 0]] == of).mean() > 0.97
    assert len(method.grid(len(x))) == 20
