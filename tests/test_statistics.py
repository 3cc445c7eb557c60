"""Statistics, maps, layouts and classifiers: known answers and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.config import SomConfig
from trackloom.functions import special
from trackloom.operators import classify as cl
from trackloom.operators import projection as pr
from trackloom.operators import som
from trackloom.operators import statistics as st


def groups(n=25, k=3, d=15, shift=0.0, seed=0):
    r = np.random.default_rng(seed)
    y = np.repeat(np.arange(k), n)
    x = r.normal(size=(n * k, d))
    x[np.arange(n * k), y] += shift
    return x, y


def table(spark, x, y):
    return spark.createDataFrame([(i, int(g), [float(v) for v in row]) for i, (row, g) in enumerate(zip(x, y, strict=True))], "id long, g int, v array<double>")


def pairwise_f(x, y):
    d2 = pr.euclidean(x) ** 2
    n, k = len(x), len(np.unique(y))
    total = d2.sum() / 2 / n
    within = sum(d2[np.ix_(y == g, y == g)].sum() / 2 / (y == g).sum() for g in np.unique(y))
    return (total - within) / (k - 1) / (within / (n - k))


def test_permanova_equals_the_pairwise_definition(spark):
    x, y = groups(shift=0.5)
    assert st.permanova(st.coordinates(table(spark, x, y), "id", "g", "v")).first()["pseudo_F"] == pytest.approx(pairwise_f(x, y))


def test_energy_equals_the_pairwise_definition(spark):
    x, y = groups(n=10, shift=0.5)
    d = pr.euclidean(x)
    m = lambda a, b: d[np.ix_(y == a, y == b)].mean()
    want = sum(10 * 10 / 20 * (2 * m(a, b) - m(a, a) - m(b, b)) for a in range(3) for b in range(a + 1, 3))
    for block in (7, 500):
        assert st.energy(table(spark, x, y), "id", "g", "v", block).first()[0] == pytest.approx(want)


def test_permutations_keep_blocks(spark):
    t = spark.createDataFrame([(i, i % 3, i % 4, (i % 4) % 2) for i in range(48)], "id long, g int, block int, pure int")
    p = st.permuted(t, "id", "g", 1, within="block").join(t, "id")
    assert p.groupBy("block", "g").count().exceptAll(p.groupBy("block", F.col("permuted").alias("g")).count()).count() == 0
    nested = st.permuted(t, "id", "pure", 1, unit="block").join(t, "id")
    assert nested.groupBy("block").agg(F.countDistinct("permuted").alias("n")).where("n > 1").count() == 0
    assert st.permutation_p(0, 99) == 0.01 and st.effective_permutations([1, 1, 1]) == 6


def test_discovery_rates_are_ordered(spark):
    p = spark.createDataFrame([(i, None if i == 3 else i / 20) for i in range(10)], "key int, p double")
    rows = st.false_discovery(p).orderBy("p").collect()
    q = [r["q"] for r in rows if r["p"] is not None]
    assert q == sorted(q) and all(r["q"] >= r["p"] - 1e-12 for r in rows if r["p"] is not None) and rows[0]["q"] is None


def test_distribution_tails():
    assert special.f_tail(4.0, 2, 10) == pytest.approx(0.05291, abs=1e-4)
    assert special.f_tail(1.0, 7, 7) == pytest.approx(0.5)
    assert special.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and special.chi2_tail(40, 20) == pytest.approx(0.004995, abs=1e-5)
    assert special.hypergeometric_tail(1, 10, 5, 2) == pytest.approx(1 - 2 / 9)


def test_null_and_shift():
    assert cl.classify(*groups(), repeats=1, permutations=39, bootstrap=50).p > 0.05
    found = cl.classify(*groups(shift=3.0), repeats=2, permutations=19, bootstrap=200)
    assert found.p == pytest.approx(0.05) and found.low <= found.balanced_accuracy <= found.high + 0.05 and found.balanced_accuracy > 0.7


@pytest.mark.parametrize("model", sorted(cl.MODELS))
def test_every_model_separates(model):
    x, y = groups(shift=3.0)
    assert cl.balanced_accuracy(y, cl.out_of_fold(x, y, cl.folds(y, 5, 0), model)) > 0.7


def test_null_scores_on_the_cluster_are_the_same(spark):
    x, y = groups(n=8)
    assert np.allclose(cl.null_scores(x, y, "lda_shrinkage", 4, 6, 0, None, None), cl.null_scores(x, y, "lda_shrinkage", 4, 6, 0, None, spark))


def test_blocks_are_not_split():
    y, blocks = np.repeat([0, 1], 20), np.repeat(np.arange(8), 5)
    fold = cl.folds(y, 4, 0, blocks)
    assert all(len(np.unique(fold[blocks == b])) == 1 for b in range(8))
    z = cl.shuffled(y, blocks, np.random.default_rng(0))
    assert all(len(np.unique(z[blocks == b])) == 1 for b in range(8))


def test_suppressor_fades():
    r = np.random.default_rng(1)
    y = np.repeat([0, 1], 100)
    noise = r.normal(size=200)
    x = np.c_[y + noise, noise + r.normal(0, 0.1, 200), r.normal(size=(200, 3))]
    w = cl.fit_lda(x, y)[1]
    a = np.abs(cl.haufe(x, w)).sum(1)
    assert np.abs(w[1]).sum() > 0.5 * np.abs(w[0]).sum() and a[1] < 0.5 * a[0]


def test_importance_of_clusters():
    x, y = groups(n=40, k=2, d=6, shift=2.0)
    x[:, 1] = x[:, 0] + np.random.default_rng(2).normal(0, 0.05, len(x))
    parts = cl.feature_clusters(x)
    assert [0, 1] in parts or any({0, 1} <= set(p) for p in parts)
    assert cl.importance(x, y, repeats=3, clusters=parts).max() > 0.05


def test_bootstrap_brackets_the_difference():
    r = np.random.default_rng(0)
    a, b = r.normal(1, 0.5, 40), r.normal(3, 0.5, 40)
    low, high = cl.bca_interval(a, b, lambda p, q: float(q.mean() - p.mean()), 500)
    assert low < b.mean() - a.mean() < high and cl.hedges_g(a, b) > 2
    assert cl.verdict(0.01, 0.01, 0.9, 0.33)["confidence"] == "strong" and cl.verdict(0.5, 0.5, 0.3, 0.33)["confidence"] == "none"


def test_layouts_and_their_quality():
    x, y = groups(n=20, shift=3.0)
    for name in (*pr.METHODS, *pr.SUPERVISED):
        coords, _ = pr.layout(name, x, y)
        assert coords.shape == (60, 2) and np.isfinite(coords).all()
    assert pr.layout("umap", x)[0] is None and "umap" in pr.layout("umap", x)[1]
    flat = np.random.default_rng(0).normal(size=(60, 2))
    assert pr.rank_quality(flat, flat)["trustworthiness"] == 1 and pr.rank_quality(flat, flat)["auc"] == pytest.approx(1)
    assert abs(pr.rank_quality(x, np.random.default_rng(5).normal(size=(60, 2)))["auc"]) < 0.15
    turned = flat @ np.array([[0, 1], [-1, 0]]) * 3 + 5
    assert np.allclose(pr.procrustes(flat, turned), flat) and pr.agreement([flat, turned])[0, 1] == 1
    assert pr.seed_stability([flat, turned]).max() < 1e-9
    own, dubious = pr.reliability(x, pr.pca(x)[0], nulls=5)
    assert own.shape == dubious.shape == (60,)
    with pytest.raises(ValueError):
        pr.mds(np.zeros((pr.LIMIT + 1, 2)))


def test_maps(spark):
    x, y = groups(n=40, shift=3.0)
    for kind in ("batch", "supervised", "relevance", "online", "growing"):
        m = som.trained(x, SomConfig(algorithm=kind, epochs=15), y)
        assert np.isfinite(m.codebook).all() and m.history[-1]["quantisation_error"] <= m.history[0]["quantisation_error"] * 1.1
    assert som.Lattice.grid(6, 6, "hex").adjacent.sum(1).max() == 6 and som.Lattice.grid(6, 6, "rect").adjacent.sum(1).max() == 4
    assert (som.Lattice.grid(6, 6, "rect", True).adjacent.sum(1) == 4).all()


def test_epochs_on_the_cluster_are_the_same(spark, monkeypatch):
    x, y = groups(n=20, shift=2.0)
    cfg = SomConfig(epochs=3, width=4, height=3)
    start = x[:12].copy()
    local = som.batch(x, cfg, start=start)
    monkeypatch.setattr(som, "LOCAL", 1)
    far = som.batch(table(spark, x, y).withColumnRenamed("v", "features"), cfg, start=start)
    assert np.allclose(local.codebook, far.codebook)


def test_node_clusters():
    w = np.r_[np.random.default_rng(0).normal(0, 0.1, (10, 3)), np.random.default_rng(1).normal(5, 0.1, (10, 3))]
    for method in ("kmeans", "ward"):
        labels = cl.cluster_nodes(w, np.ones(20), 2, method)
        assert len(set(labels[:10])) == 1 and labels[0] != labels[10]


def test_tiny_designs():
    x, y = np.random.default_rng(0).normal(size=(4, 3)), np.array([0, 0, 1, 1])
    assert math.isfinite(cl.classify(x, y, k=2, repeats=1, bootstrap=10).balanced_accuracy)


def test_verdict_rules():
    confidence = lambda *a, **k: cl.verdict(*a, **k)["confidence"]
    assert confidence(0.01, 0.01, 0.5, 0.33) == "moderate" and confidence(0.01, 0.5, 0.9, 0.33) == "weak" and confidence(0.5, 0.01, 0.9, 0.33) == "weak"
    assert confidence(0.01, None, 0.0, 0.0, r2=0.2) == "moderate" and confidence(0.01, None, 0.0, 0.0, r2=0.05) == "weak"
    assert confidence(0.5, None, 0.0, 0.0) == "none" and confidence(None, None, 0.0, 0.0) == "unknown"


def test_correlations_of_rows_that_have_both(spark):
    from trackloom.operators import prepare as prep

    rows = [(1e6 + i, None if i % 3 == 0 else float(i * i), 0.1, 5.0 - 2 * i, None) for i in range(30)]
    table = spark.createDataFrame(rows, "a double, b double, same double, c double, none double").repartition(4)
    got = {(x["a"], x["b"]): x["r"] for x in prep.correlations(table, ["a", "b", "same", "c", "none"]).collect()}
    both = np.array([(i, i * i) for i in range(30) if i % 3])
    assert len(got) == 10 and got["a", "b"] == pytest.approx(np.corrcoef(both.T)[0, 1]) and got["a", "c"] == pytest.approx(-1)
    assert all(got[p] is None for p in got if {"same", "none"} & set(p))
    assert prep.uncorrelated(table, ["a", "b", "c"]) == ["a", "b"] and prep.uncorrelated(table.limit(0), ["a", "b", "c"]) == ["a", "b", "c"]


def test_ranks_and_quantiles_of_features_need_no_task_for_all_rows(spark):
    import numpy as np

    from trackloom.operators import prepare

    r = np.random.default_rng(5)
    v = [[None if x < 0.1 else float(round(x * 20)), float(y)] for x, y in r.uniform(size=(3000, 2))]
    t = spark.createDataFrame([(i, *x) for i, x in enumerate(v)], "k long, a double, b double")
    out = prepare.scaled(t, ["a", "b"], "rank")
    assert "SinglePartition" not in out.groupBy().count()._jdf.queryExecution().optimizedPlan().toString()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window [count(" not in plan and "rank(" not in plan
    got = {x["k"]: (x["a"], x["b"]) for x in out.collect()}
    for c in (0, 1):
        there = sorted(x[c] for x in v if x[c] is not None)
        for k, x in enumerate(v):
            want = None if x[c] is None else (np.searchsorted(there, x[c]) + np.searchsorted(there, x[c], "right") + 1) / 2 - 0.5
            assert got[k][c] is None if want is None else abs(got[k][c] - want / len(there)) < 1e-12
    for made in (prepare.scaled(t, ["a", "b"], "robust"), prepare.winsorised(t, ["a", "b"], 0.05), prepare.imputed(t, ["a", "b"]), prepare.summary(t, ["a", "b"])):
        assert "percentile(" not in made._jdf.queryExecution().optimizedPlan().toString()
