"""Steps that large tables go through, on small ones against plain versions."""

import numpy as np
import pyarrow as pa
import pytest

from trackloom.operators import som


def table(spark, x, y=None):
    y = np.zeros(len(x), int) if y is None else y
    return spark.createDataFrame([(int(i), int(g), [float(c) for c in v]) for i, (g, v) in enumerate(zip(y, x, strict=True))], "id long, g int, v array<double>")


def test_sums_by_node_without_objects():
    r = np.random.default_rng(0)
    x, node = r.normal(size=(50, 3)), r.integers(0, 6, 50)
    want = np.zeros((8, 3))
    np.add.at(want, node, x)
    assert np.allclose(som.by_node(x, node, 8), want) and som.by_node(x[:0], node[:0], 8).sum() == 0
    assert np.array_equal(som.matrix(pa.array(x.tolist())[5:9]), x[5:9])
    with pytest.raises(ValueError):
        som.matrix(pa.array([[1.0, 2.0], [3.0], [4.0, 5.0, 6.0]]))


def test_pairs_of_blocks_are_met_once_in_few_large_blocks(spark):
    from trackloom.operators import ordination as od
    from trackloom.operators import statistics as st

    assert [-(-n // st.block_rows(n)) for n in (100, 10_000, 100_000, 600_000)] == [1, 20, 24, 37]
    r = np.random.default_rng(1)
    x, y = r.normal(size=(700, 4)), r.integers(0, 3, 700)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    m = np.array([[d[np.ix_(y == a, y == b)].mean() for b in range(3)] for a in range(3)])
    n = np.bincount(y)
    want = sum(n[a] * n[b] / (n[a] + n[b]) * (2 * m[a, b] - m[a, a] - m[b, b]) for a in range(3) for b in range(a + 1, 3))
    rows = table(spark, x, y)
    for block in (None, 150):
        assert np.isclose(st.energy(rows, "id", "g", "v", block).first()["energy"], want)
    upper = np.triu_indices(700, 1)
    rank = lambda v: np.argsort(np.argsort(v)).astype(float)
    near = np.sqrt(((x[:, None, :2] - x[:, :2]) ** 2).sum(2))
    want = np.corrcoef(rank(d[upper]), rank(near[upper]))[0, 1]
    for block in (None, 150):
        got = od.shepard(rows.selectExpr("id", "v", "slice(v, 1, 2) AS w"), "id", "v", "w", block=block).first()
        assert got["pairs"] == 700 * 699 // 2 and abs(got["spearman"] - want) < 1e-4


def test_cosine_axes_from_moments_agree_with_all_pairs(spark):
    from trackloom.operators import ordination as od

    x = np.random.default_rng(2).normal(size=(60, 5)) + 0.5
    x[7] = 0
    u = np.where(np.arange(60)[:, None] == 7, 0, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))
    d = 1 - u @ u.T
    d[7] = d[:, 7] = 0
    d[np.arange(60), np.arange(60)] = 0
    j = np.eye(60) - 1 / 60
    value, vector = np.linalg.eigh(-0.5 * j @ d**2 @ j)
    real, imaginary = np.argsort(-value)[:5], np.argsort(value)[:5]
    got = od.pcoa(table(spark, x), "id", "v", "cosine").collect()
    for flag, want in ((False, real), (True, imaginary)):
        for i, k in enumerate(want):
            c = sorted((r["key"], r["coordinate"], r["eigenvalue"]) for r in got if r["imaginary"] == flag and r["axis"] == i + 1)
            assert len(c) == 60 and np.isclose(c[0][2], value[k])
            assert np.allclose(np.abs([r[1] for r in c]), np.abs(vector[:, k]) * np.sqrt(abs(value[k])), atol=1e-8)


def test_kernel_axes_over_pairs_of_blocks(spark):
    from trackloom.operators import ordination as od
    from trackloom.operators import projection as pr

    x = np.random.default_rng(3).normal(size=(90, 4)) * [3, 2, 1, 1]
    want = pr.kernel_pca(x)
    got = od.kernel_axes(table(spark, x), "id", "v", block=40).collect()
    for i in (0, 1):
        c = [r["coordinate"] for r in sorted(got, key=lambda r: r["key"]) if r["axis"] == i + 1]
        assert np.allclose(np.abs(c), np.abs(want[:, i]), atol=1e-5)


def test_resampled_discriminants_against_the_dense_ones(spark):
    from trackloom.operators import classify as cl
    from trackloom.operators import resampled as rs

    r = np.random.default_rng(4)
    y = r.permutation(np.repeat([0, 1, 2], [300, 200, 150]))
    x = r.normal(size=(650, 4)) * [1, 2, 3, 1] + np.array([[0, 0, 0, 0], [1, 0, 0, 0], [0, 2, 0, 0]])[y] + 5
    rows = table(spark, x, y)
    tool = rs.Draws(rows, "id", "g", "v")
    of = tool.cells()
    packs = {p["block"]: p for p in tool.rows.collect()}
    for draw in ((0, False), (3, True)):
        label, fold = np.zeros(650, int), np.zeros(650, int)
        for b, p in packs.items():
            label[p["keys"]], fold[p["keys"]] = of(b, np.array([tool.groups.index(g) for g in p["g"]]), draw)
        assert np.bincount(label).tolist() == [300, 200, 150] and (draw[1] or (label == y).all())
        for g in range(3):
            assert np.ptp(np.bincount(fold[label == g], minlength=5)) <= 1
        want = cl.out_of_fold(x, label, fold, "lda_shrinkage")
        counts = np.array([[((label == a) & (want == b)).sum() for b in range(3)] for a in range(3)])
        assert np.array_equal(tool.confusions([draw])[0], counts)
    got, plain = rs.classify(rows, "id", "g", "v", permutations=19), cl.classify(x, y, permutations=19)
    assert abs(got.balanced_accuracy - plain.balanced_accuracy) < 0.03 and got.p == plain.p == 0.05 and got.low < got.balanced_accuracy < got.high
    assert np.allclose(rs.importance(rows, "id", "g", "v"), cl.importance(x, y), atol=0.03)


def test_rank_quality_block_by_block(spark, monkeypatch):
    from trackloom.operators import projection as pr
    from trackloom.operators import ranked as rk

    x = np.random.default_rng(5).integers(0, 6, (110, 5)).astype(float)  # with equal distances
    x[60] = x[3]
    want, near = pr.rank_quality(x, x[:, :2]), pr.agreement([x, x[:, :2]])[0, 1]
    for held in (8_000_000, 3300):
        monkeypatch.setattr(rk, "HELD", held)
        got = rk.quality(table(spark, x), "id", "v", 2)
        assert np.allclose(got["rnx"], want["rnx"]) and np.isclose(got["agreement"], near)
        assert np.isclose(got["trustworthiness"], want["trustworthiness"]) and np.isclose(got["continuity"], want["continuity"])


def test_floats_travel_as_floats_to_the_same_neighbours(spark):
    from pyspark.sql import functions as F

    from trackloom.operators import neighbours as nb

    rows = table(spark, np.random.default_rng(6).normal(size=(700, 4)).astype(np.float32))
    floats = rows.select("id", F.col("v").cast("array<float>").alias("v"))
    assert floats.select(nb.numbers(floats, "v").alias("x")).schema["x"].dataType.simpleString() == "array<float>"
    for find in (lambda t: nb.neighbour_graph(t, "id", "v", 5), lambda t: nb.exact_neighbours(t, "id", "v", 5, F.col("id") % 20 == 0)):
        assert find(floats).orderBy("node", "d", "other").select("node", "other", "d").collect() == find(rows).orderBy("node", "d", "other").select("node", "other", "d").collect()
