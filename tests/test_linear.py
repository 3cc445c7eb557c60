"""Layouts, patterns and maps on rows against the dense forms, and tables of more rows than those take."""

import numpy as np
import pytest

from trackloom.operators import classify as cl
from trackloom.operators import linear as ln
from trackloom.operators import projection as pr
from trackloom.operators import som


def table(spark, n, seed=0, groups=3):
    r = np.random.default_rng(seed)
    y = r.integers(0, groups, n)
    x = r.normal(size=(n, 6)) @ r.normal(size=(6, 6)) + 5 + y[:, None] * np.arange(6)
    return x, y, spark.createDataFrame([(i, int(g), v.tolist()) for i, (v, g) in enumerate(zip(x, y, strict=True))], "k long, g int, v array<double>").repartition(3)


def placed(df):
    return np.array([[r[c] for c in df.columns[1:]] for r in df.orderBy("k").collect()])


@pytest.mark.parametrize("groups", [2, 3])
def test_same_as_dense(spark, groups):
    x, y, t = table(spark, 300, groups=groups)
    of = ln.total(ln.moments(t, "v"))
    same = lambda a, b: np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-7)
    same(placed(ln.projected(t, "k", "v", of.mean, ln.principal(of))), pr.pca(x)[0])
    same(placed(ln.scaling(t, "k", "v")), pr.mds(x))
    same(placed(ln.discriminant(t, "k", "v", "g")), pr.lda(x, y))
    same(np.abs(placed(ln.least_squares(t, "k", "v", "g"))), np.abs(pr.plsda(x, y)[0]))
    same(ln.patterns(t, "v", "g"), cl.haufe(x, cl.fit_lda(x, y)[1]))
    same(ln.correlations(t, "v", 2), pr.axis_correlations(x, x[:, :2]))


def test_bootstrap_of_means_is_that_of_the_rows(spark):
    x, y, t = table(spark, 400)
    t = t.selectExpr("k", "g", "v[0] as v")
    seen, low, high = ln.bca_means(t, "k", "g", "v", "0", "1", 4000, block=50)
    a, b = x[y == 0, 0], x[y == 1, 0]
    want = cl.bca_interval(a, b, lambda p, q: float(q.mean() - p.mean()), 4000)
    assert abs(seen - (b.mean() - a.mean())) < 1e-9 and np.allclose((low, high), want, atol=0.06 * (want[1] - want[0]))


def test_queries_take_more_rows_than_a_matrix(spark, tmp_path):
    from trackloom.plans import maps

    x, y, t = table(spark, pr.LIMIT + 100)
    t.selectExpr("k as vec_id", "g as label", "v as embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    q = maps.queries()
    for name in ("layout_pca", "layout_mds", "layout_lda", "layout_plsda", "som_train_batch"):
        assert q[name](spark, str(tmp_path)).count() == len(x), name
    for name in ("axis_correlation", "pca_variance", "haufe_patterns", "bootstrap_bca"):
        assert q[name](spark, str(tmp_path)).count() > 0, name


def test_two_nearest_in_parts_and_ward_as_merging_all(monkeypatch):
    r = np.random.default_rng(1)
    x, w = r.integers(0, 3, (500, 2)).astype(float), r.integers(0, 3, (30, 2)).astype(float)
    monkeypatch.setattr(som, "TOGETHER", 100)
    d = np.maximum((x * x).sum(1)[:, None] + (w * w).sum(1) - 2 * x @ w.T, 0)
    order = np.argsort(d, axis=1, kind="stable")
    n1, _, n2, _ = som.two_nearest(x, w)
    assert (n1 == order[:, 0]).all() and (n2 == order[:, 1]).all()
    c = r.normal(size=(40, 3))
    parts = [[i] for i in range(len(c))]
    while len(parts) > 4:
        m, n = np.array([c[p].mean(0) for p in parts]), np.array([len(p) for p in parts], float)
        cost = ((m[:, None] - m[None]) ** 2).sum(2) * np.outer(n, n) / (n[:, None] + n)
        cost[np.tril_indices(len(n))] = np.inf
        i, j = np.unravel_index(cost.argmin(), cost.shape)
        parts[i] += parts.pop(j)
    assert {tuple(sorted(p)) for p in parts} == {tuple(np.flatnonzero(cl.cluster_nodes(c, np.ones(40), 4, "ward") == i)) for i in range(4)}
