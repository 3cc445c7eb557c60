"""Fold plans, recall and pair tables against the dense classifiers over the same folds."""

import collections

import numpy as np
import pytest

from trackloom.operators import classify as cl
from trackloom.operators import crossval as cv


@pytest.fixture(scope="module")
def samples():
    r = np.random.default_rng(7)
    y = np.repeat(list("aaabbc"), 20)
    return r.normal(size=(120, 6)) * [1, 2, 3, 1, 1, 5] + (np.array([ord(c) - 97 for c in y])[:, None] * [1.0, 0.5, 0, 0, 0, 0]), y, np.arange(120) % 5


@pytest.fixture(scope="module")
def table(spark, samples):
    x, y, r = samples
    rows = [(i, y[i], int(r[i]), x[i].tolist()) for i in range(len(x))] + [(None, "a", 1, x[0].tolist()), (500, None, 1, x[0].tolist())]
    return spark.createDataFrame(rows, "id long, grp string, rep int, vec array<double>").repartition(4)


def folds_of(plan):
    return {r["key"]: r["folds"] for r in plan.collect()}


def test_stratified_plan(table, samples, monkeypatch):
    _, y, _ = samples
    for together in (100_000, 30):  # one block, and several
        monkeypatch.setattr(cv, "TOGETHER", together)
        plan, scheme = cv.fold_plan(table, "id", "grp", k=5, repeats=3)
        got = folds_of(plan)
        assert scheme == "repeated_stratified" and sorted(got) == list(range(120)) and all(len(f) == 3 for f in got.values())
        for r in range(3):
            n = collections.Counter((y[i], f[r]) for i, f in got.items())
            assert n == {(g, f): c // 5 for g, c in (("a", 60), ("b", 40), ("c", 20)) for f in range(5)}
        assert any(f[0] != f[1] for f in got.values())


def test_plans_by_replicate(table, samples):
    _, _, rep = samples
    plan, scheme = cv.fold_plan(table, "id", "grp", "rep", "leave_one_replicate_out")
    assert scheme == "leave_one_replicate_out" and folds_of(plan) == {i: [int(rep[i])] for i in range(120)}
    plan, scheme = cv.fold_plan(table, "id", "grp", "rep", k=3)
    got = folds_of(plan)
    assert scheme == "grouped" and len({f[0] for f in got.values()}) == 3 and all(len({got[i][0] for i in range(120) if rep[i] == r}) == 1 for r in range(5))
    assert cv.fold_plan(table.where("rep < 2"), "id", "grp", "rep", "leave_one_replicate_out")[1] == "repeated_stratified"
    assert sorted(collections.Counter(cv.grouped_folds([("p", "a", 10), ("q", "a", 10), ("r", "b", 10), ("s", "b", 10)], 2).values()).values()) == [2, 2]


@pytest.mark.parametrize("scheme,replicate", [("repeated_stratified", None), ("leave_one_replicate_out", "rep")])
def test_tables_against_dense_models(table, samples, scheme, replicate):
    x, y, _ = samples
    plan, _ = cv.fold_plan(table, "id", "grp", replicate, scheme, repeats=2)
    folds = np.array([f for _, f in sorted(folds_of(plan).items())])
    codes = np.searchsorted(list("abc"), y)
    dense = [cl.out_of_fold(x, codes, folds[:, r], "lda_shrinkage") for r in range(folds.shape[1])]
    got = {r["group"]: r for r in cv.recall_table(table, "id", "grp", "vec", replicate, scheme, repeats=2).collect()}
    for g, name in enumerate("abc"):
        assert abs(got[name]["recall"] - np.mean([np.mean(p[codes == g] == g) for p in dense])) < 1e-12 and got[name]["n"] == (codes == g).sum()
    assert abs(got["a"]["balanced_accuracy"] - np.mean([cl.balanced_accuracy(codes, p) for p in dense])) < 1e-12
    pairs = {(r["group_a"], r["group_b"]): r for r in cv.pairwise_accuracy(table, "id", "grp", "vec", replicate, scheme, repeats=2).collect()}
    assert set(pairs) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), row in pairs.items():
        at = (y == a) | (y == b)
        z = (y[at] == b).astype(int)
        want = np.mean([cl.balanced_accuracy(z, cl.out_of_fold(x[at], z, folds[at, r], "lda_shrinkage")) for r in range(folds.shape[1])])
        assert abs(row["balanced_accuracy"] - want) < 1e-12 and row["n_a"] == (y == a).sum()


def test_nested_replicates(table):
    nested = table.where("grp in ('a', 'b')").selectExpr("id", "grp", "if(grp = 'b', 9, rep % 2) AS rep", "vec")  # b is one replicate
    got = {r["group"]: r["recall"] for r in cv.recall_table(nested, "id", "grp", "vec", "rep", "leave_one_replicate_out").collect()}
    assert got["b"] == 0.0  # no fold that holds b out has seen it
    assert cv.pairwise_accuracy(table.where("grp = 'a'"), "id", "grp", "vec").collect() == []


def test_folds_in_parts_are_those_of_whole_groups(spark, monkeypatch):
    import hashlib

    from trackloom.operators import crossval

    t = spark.createDataFrame([(i, i % 3) for i in range(400)], "k long, g int")
    monkeypatch.setattr(crossval, "TOGETHER", 20)
    got = {r["key"]: r["folds"] for r in crossval.fold_plan(t, "k", "g", repeats=2)[0].collect()}
    for repeat in range(2):
        for g in range(3):
            own = sorted((i for i in range(400) if i % 3 == g), key=lambda i: (hashlib.md5(f"0|{repeat}|{i}".encode()).hexdigest(), i))
            assert [got[i][repeat] for i in own] == [n % 5 for n in range(len(own))]
