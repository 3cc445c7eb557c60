"""Principal coordinates, dispersions, permutations and Shepard correlation against dense versions."""

import numpy as np
import pytest

from trackloom.operators import ordination as od
from trackloom.operators.statistics import distances


@pytest.fixture(scope="module")
def samples():
    r = np.random.default_rng(2)
    y = np.arange(230) % 3
    return r.normal(size=(230, 8)) * (1 + 0.5 * (y == 2))[:, None] + 2 * r.normal(size=(3, 8))[y], y


@pytest.fixture(scope="module")
def table(spark, samples):
    x, y = samples
    return spark.createDataFrame([(i * 3, str(y[i]), x[i].tolist()) for i in range(len(x))] + [(None, "0", x[0].tolist()), (1, "0", None)], "id long, grp string, vec array<double>").repartition(5)


def dense(x, metric):
    d = distances(x, x, metric)
    np.fill_diagonal(d, 0)
    j = np.eye(len(x)) - 1 / len(x)
    w, v = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
    return d, w, v


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "cosine"])
def test_principal_coordinates(spark, samples, table, metric):
    x, _ = samples
    got = od.pcoa(table, "id", "vec", metric, axes=3, block=60).toPandas()
    _, w, v = dense(x, metric)
    for imaginary, order in ((False, np.argsort(-w)), (True, np.argsort(w))):
        part = got[got.imaginary == imaginary]
        for axis in sorted(part.axis.unique()):
            k = order[axis - 1]
            one = part[part.axis == axis].sort_values("key")
            assert one.key.tolist() == [3 * i for i in range(len(x))]
            assert abs(one.eigenvalue.iloc[0] - w[k]) <= 1e-6 * abs(w).max()
            want = v[:, k] * np.sqrt(abs(w[k]))
            assert min(np.abs(one.coordinate - want).max(), np.abs(one.coordinate + want).max()) < 1e-5
    assert set(got[~got.imaginary].axis) == {1, 2, 3}
    assert len(got[got.imaginary]) == (0 if metric == "euclidean" else 3 * len(x))


def test_few_rows(spark, table):
    assert od.pcoa(table.where("id < 0"), "id", "vec").collect() == []
    got = od.pcoa(table.where("id <= 3"), "id", "vec").toPandas()
    assert sorted(got.key) == [0, 3] and abs(got.coordinate.sum()) < 1e-9
    assert od.shepard(table.where("id = 0"), "id", "vec", "vec").first()["spearman"] is None


@pytest.mark.parametrize("metric", ["euclidean", "cityblock"])
def test_dispersions_are_those_of_all_axes(samples, table, metric):
    x, y = samples
    _, w, v = dense(x, metric)
    real, imaginary = v[:, w > 1e-10] * np.sqrt(w[w > 1e-10]), v[:, w < -1e-10] * np.sqrt(-w[w < -1e-10])
    want = np.zeros(len(x))
    for g in range(3):
        at = y == g
        want[at] = np.sqrt(np.clip(((real[at] - real[at].mean(0)) ** 2).sum(1) - ((imaginary[at] - imaginary[at].mean(0)) ** 2).sum(1), 0, None))
    got = od.dispersions(table, "id", "grp", "vec", metric, block=60).toPandas().sort_values("key")
    assert np.abs(got.dist - want).max() < 1e-6
    row = od.permdisp(table, "id", "grp", "vec", metric, permutations=99, block=60).first()
    centre, between, within = want.mean(), 0.0, 0.0
    for g in range(3):
        z = want[y == g]
        between, within = between + len(z) * (z.mean() - centre) ** 2, within + ((z - z.mean()) ** 2).sum()
    assert abs(row["F"] - between / 2 / (within / (len(x) - 3))) < 1e-6 and row["p"] == 0.01 and row["groups"] == 3


def test_shares_of_labels():
    sizes, counts = np.array([5, 0, 7, 3, 6]), np.array([9, 4, 8])
    shares = np.array([[od.dealt(sizes, counts, b, s) for b in range(5)] for s in range(400)])
    assert (shares.sum(1) == counts).all() and (shares.sum(2) == sizes).all()
    assert np.abs(shares.mean(0) - sizes[:, None] * counts / 21).max() < 0.2


def test_null_is_that_of_permutations(spark, samples, table):
    x, y = samples
    null = od.permuted_F(table, "id", "grp", "vec", permutations=200, block=60).toPandas()
    assert sorted(null.seed) == list(range(200))
    r, plain = np.random.default_rng(0), []
    for _ in range(400):
        z = r.permutation(y)
        within = sum(((x[z == g] - x[z == g].mean(0)) ** 2).sum() for g in range(3))
        total = ((x - x.mean(0)) ** 2).sum()
        plain.append((total - within) / 2 / (within / (len(x) - 3)))
    assert abs(null.pseudo_F.mean() - np.mean(plain)) < 0.1 and abs(null.pseudo_F.std() - np.std(plain)) < 0.12
    again = od.permuted_F(table.repartition(2), "id", "grp", "vec", permutations=200, block=60).toPandas()
    assert np.allclose(again.sort_values("seed").pseudo_F.values, null.sort_values("seed").pseudo_F.values)


def test_shepard_is_spearman(spark, samples):
    x, _ = samples
    layout = x[:, :2] + 0.3 * np.sin(5 * x[:, 2:4])
    df = spark.createDataFrame([(i, x[i].tolist(), layout[i].tolist()) for i in range(len(x))], "id long, vec array<double>, xy array<double>").repartition(4)
    row = od.shepard(df, "id", "vec", "xy", block=60).first()
    at = np.triu_indices(len(x), 1)
    a, b = (np.argsort(np.argsort(distances(v, v, "euclidean")[at])) for v in (x, layout))
    assert row["pairs"] == len(at[0]) and abs(row["spearman"] - np.corrcoef(a, b)[0, 1]) < 1e-5


@pytest.mark.parametrize("metric", ["cosine", "correlation"])
def test_dispersions_of_unit_vectors_compare_no_pairs(spark, metric, monkeypatch):
    from trackloom.operators.statistics import distances

    r = np.random.default_rng(4)
    x = r.normal(size=(90, 5))
    x[7], x[8] = 0, x[9]
    g = [None if i % 4 == 3 else f"g{i % 4}" for i in range(90)]
    t = spark.createDataFrame([(i, h, v.tolist()) for i, (h, v) in enumerate(zip(g, x, strict=True))], "id long, grp string, vec array<double>")
    monkeypatch.setattr(od, "over_pairs", None)
    got = {row["key"]: row["dist"] for row in od.dispersions(t, "id", "grp", "vec", metric).collect()}
    d2 = distances(x, x, metric) ** 2
    for i in range(90):
        own = np.array([h == g[i] for h in g])
        want = d2[i, own].mean() - d2[np.ix_(own, own)].mean() / 2
        assert abs(got[i] - np.sqrt(max(want, 0))) < 1e-7
