"""Squared distances as one product, and what Shepard correlation makes of them."""

import numpy as np

from trackloom.operators import ordination as od

from .test_large import table


def test_products_hold_squared_distances():
    r = np.random.default_rng(0)
    a, b = r.normal(size=(9, 4)), r.normal(size=(7, 4))
    left, right = od.as_products(a, b)
    assert np.allclose(left @ right, ((a[:, None] - b) ** 2).sum(2))


def test_shepard_takes_distances_as_products(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(200, 5))
    x[3] = x[70]
    rows = table(spark, x).selectExpr("id", "v", "slice(v, 1, 2) AS w")
    monkeypatch.setattr(od, "distances", None)  # no distance matrix is made on the way
    got = od.shepard(rows, "id", "v", "w", block=60).first()
    upper = np.triu_indices(200, 1)
    rank = lambda v: np.argsort(np.argsort(v)).astype(float)
    d = [np.sqrt(((x[:, None, :c] - x[:, :c]) ** 2).sum(2))[upper] for c in (5, 2)]
    assert got["pairs"] == 19_900 and abs(got["spearman"] - np.corrcoef(rank(d[0]), rank(d[1]))[0, 1]) < 1e-4


def test_a_layout_is_made_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    x = np.random.default_rng(2).normal(size=(80, 3))
    rows = table(spark, x).selectExpr("id", "v", "slice(v, 1, 2) AS w").mapInArrow(counted, "id long, v array<double>, w array<double>")
    assert od.shepard(rows, "id", "v", "w").first()["pairs"] == 80 * 79 // 2
    assert seen.value == 80


def test_kernel_axes_begin_near_the_wanted_ones(spark, monkeypatch):
    from trackloom.operators import projection as pr

    x = np.random.default_rng(3).normal(size=(400, 6)) * [0.5, 0.4, 0.3, 0.1, 0.1, 0.1]
    lacks = []
    run = od.Krylov.extend

    def extend(self):
        out = run(self)
        lacks.append(out[2][-2:].max())  # what the two leading axes lack
        return out

    monkeypatch.setattr(od.Krylov, "extend", extend)
    far, first = x + 40, []  # the series is of no use for the first, whose axes are the same
    want, start = pr.kernel_pca(x), od._kernel_start
    for rows, begun in ((far, start), (x, start), (x, lambda *a: None)):
        lacks.clear()
        monkeypatch.setattr(od, "_kernel_start", begun)
        got = od.kernel_axes(table(spark, rows), "id", "v", block=150).collect()
        first.append(lacks[0])
        for i in (0, 1):
            c = np.array([r["coordinate"] for r in sorted(got, key=lambda r: r["key"]) if r["axis"] == i + 1])
            assert np.allclose(np.abs(c), np.abs(want[:, i]), atol=1e-5)
    assert first[1] < 0.2 * first[2]
