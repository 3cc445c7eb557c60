"""Online and relevance maps of more rows than a matrix may have, against the dense ones."""

import numpy as np

from trackloom.config import SomConfig
from trackloom.operators import projection as pr
from trackloom.operators import scan, som

from .test_large import table

SMALL = "/root/testdata/sf0.001"


def test_rows_moved_together_are_moved_one_after_another():
    r = np.random.default_rng(0)
    w, x, h = r.normal(size=(6, 3)), r.normal(size=(5, 3)), r.uniform(0, 0.6, (6, 6))
    b = som.two_nearest(x, w)[0]
    want = w.copy()
    for i, at in enumerate(b):
        want += h[at][:, None] * (x[i] - want)
    got, left, distance = som.moved(w, x, lambda b: h[b])
    assert np.allclose(got, want) and np.allclose(left, np.prod(1 - h[b], axis=0)) and np.isclose(distance, som.two_nearest(x, w)[1].sum())


def test_online_map_over_rows(spark, monkeypatch):
    from trackloom.plans import maps

    r = np.random.default_rng(7)
    x = r.normal(size=(600, 3)) + 6 * np.eye(3)[r.integers(0, 3, 600)]
    cfg = SomConfig(algorithm="online", epochs=20, width=6, height=5)
    # one lane that takes one row at a time is the sequential map in the lane's order
    few = x[:40]
    got = scan.online(table(spark, few), "id", "v", SomConfig(epochs=2, width=4, height=3), lanes=1, together=1)
    lattice = som.Lattice.grid(4, 3)
    w = som.plane(few.mean(0), np.cov(few.T, ddof=0), lattice)
    for epoch in (1, 2):
        h = lattice.neighbourhood(got.history[epoch - 1]["sigma"]) * 0.5 * np.exp(-epoch)
        for i in np.random.default_rng([0, epoch, 0]).permutation(40):
            w += h[((w - few[i]) ** 2).sum(1).argmin()][:, None] * (few[i] - w)
    assert np.allclose(got.codebook, w)
    want = som.online(x, cfg)
    for lanes, together in ((4, 0), (2, 8)):
        got = scan.online(table(spark, x), "id", "v", cfg, lanes=lanes, together=together)
        assert len(got.history) == 20 and got.history[-1]["quantisation_error"] < got.history[0]["quantisation_error"]
        assert som.two_nearest(x, got.codebook)[1].mean() < 1.1 * som.two_nearest(x, want.codebook)[1].mean()
    monkeypatch.setattr(pr, "LIMIT", 100)
    monkeypatch.setattr(maps, "SomConfig", lambda **given: SomConfig(**({"epochs": 5} | given)))
    rows = maps.queries()["som_train_online"](spark, SMALL).collect()
    assert len({g["vec_id"] for g in rows}) == len(rows) == spark.read.parquet(f"{SMALL}/embeddings.parquet").count()


def test_relevance_map_over_rows(spark, monkeypatch):
    from trackloom.plans import maps

    r = np.random.default_rng(8)
    y = r.integers(0, 3, 300)
    x = np.c_[r.normal(size=(300, 2)) + 4 * np.eye(3)[y][:, :2], r.normal(size=(300, 3))]
    cfg = SomConfig(algorithm="relevance", epochs=6, width=4, height=3)
    want = som.relevance(x, y, cfg)
    got = scan.relevance(table(spark, x, y), "v", "g", cfg)
    assert np.allclose(got.relevance, want.relevance) and np.allclose(got.codebook, want.codebook)
    assert got.relevance[:2].min() > got.relevance[2:].max() and [h["epoch"] for h in got.history] == list(range(1, 7))
    assert np.isclose(got.history[-1]["quantisation_error"], want.history[-1]["quantisation_error"])
    monkeypatch.setattr(pr, "LIMIT", 100)
    rows = maps.queries()["som_train_relevance"](spark, SMALL).collect()
    assert len({g["vec_id"] for g in rows}) == len(rows) == spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
