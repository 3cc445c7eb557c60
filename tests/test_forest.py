"""Forest importance finds the features that carry the groups."""

import numpy as np

from trackloom.operators import forest as fo


def test_signal_features_rank_first(spark):
    r = np.random.default_rng(1)
    y = np.arange(150) % 3
    x = r.normal(size=(150, 7))
    x[:, [1, 4, 6]] += 2.0 * np.eye(3)[y]
    rows = [(i, f"g{y[i]}", int(i % 5), x[i].tolist()) for i in range(150)] + [(None, "g1", 1, x[0].tolist()), (900, None, 1, x[0].tolist()), (901, "g1", 1, None)]
    df = spark.createDataFrame(rows, "id long, grp string, rep int, vec array<double>").repartition(3)
    names = [f"f{j}" for j in range(7)]
    got = fo.importance(df, "id", "grp", "vec", names, k=3, trees=30, depth=6, repeats=3).collect()
    assert [g["rank"] for g in got] == list(range(1, 8)) and {g["feature"] for g in got[:3]} == {"f1", "f4", "f6"}
    assert got[0]["balanced_accuracy"] > 0.75 and all(g["importance"] > 0.05 for g in got[:3]) and all(abs(g["importance"]) < 0.06 for g in got[3:])
    assert fo.importance(df.where("grp = 'g1'"), "id", "grp", "vec", names).collect() == []


def test_forest_balances_groups(spark):
    r = np.random.default_rng(3)
    y = np.r_[np.zeros(190), np.ones(10)]
    x = r.normal(size=(200, 3)) + 1.5 * y[:, None]
    df = spark.createDataFrame([(str(int(c)), v.tolist()) for c, v in zip(y, x, strict=True)], "grp string, vec array<double>")
    model = fo.forest(df, "grp", "vec", ["0", "1"], trees=20, depth=3)
    assert model.transform(fo.labelled(df, "grp", "vec", ["0", "1"])).where("grp = '1' and prediction = 1").count() >= 8


def test_large_nodes_are_split_as_small_ones(spark, monkeypatch):
    r = np.random.default_rng(5)
    y = np.arange(300) % 3
    x = r.normal(size=(300, 9)) + 1.2 * np.eye(9)[y]
    df = spark.createDataFrame([(i, f"g{y[i]}", int(i % 2), x[i].tolist()) for i in range(300)], "key long, g string, fold int, v array<double>")
    monkeypatch.setattr(fo, "BLOCK", 40)
    cuts = np.quantile(x, np.arange(1, fo.BINS) / fo.BINS, axis=0).T
    packs = fo.binned(df, cuts, ["g0", "g1", "g2"], {0: 150, 1: 150})
    weights, grown = {f: np.array([1.0, 1.5, 1.0]) for f in (0, 1)}, []
    for small in (10_000, 20):
        monkeypatch.setattr(fo, "SMALL", small)
        grown.append(fo.forests(packs, weights, {0: 150, 1: 150}, 9, 6, 7, 0))
    for f in (0, 1):
        assert len(grown[0][f]) == len(grown[1][f]) == 6
        for a, b in zip(grown[0][f], grown[1][f], strict=True):
            for c in ("number", "feature", "left"):
                assert np.array_equal(getattr(a, c), getattr(b, c)), c
            assert np.array_equal(a.bin[a.feature >= 0], b.bin[b.feature >= 0]) and np.allclose(a.share, b.share)
    codes = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x[:50].T, strict=True)], 1).astype(np.uint8)

    def hits(codes):
        total = 0
        for tree in grown[0][0]:
            *_, (_, _, at) = tree.reached(lambda k, f: codes[k, f], 50)
            total = total + tree.share[at]
        return (total.argmax(1) == y[:50]) @ np.eye(3)[y[:50]]

    got = fo.permuted_hits(grown[0][0], y[:50], codes, 3, 2, np.random.default_rng(1))
    random = np.random.default_rng(1)
    new = [random.permuted(codes, axis=0) for _ in range(2)]
    for at, n in enumerate(new):
        for j in range(9):
            changed = codes.copy()
            changed[:, j] = n[:, j]
            assert np.abs(got[1 + at * 9 + j] - hits(changed)).max() <= 1  # sums of shares are added in another order
    assert np.array_equal(got[0], hits(codes))
