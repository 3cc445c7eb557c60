"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from trackloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def normal(t):
    t = t[sorted(t.columns)]
    for c in t.columns:
        t[c] = t[c].astype(float).round(6) if t[c].dtype.kind in "iuf" else t[c].astype(str)
    return t.sort_values(list(t.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    a, b = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    a, b = normal(a), normal(b)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if a[c].dtype.kind == "f":
            same |= (a[c] - b[c]).abs() <= 2e-6
        assert same.all(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_map_queries_run_with_production_defaults(spark, monkeypatch):
    import inspect

    import numpy as np

    from trackloom.config import SomConfig, StatsConfig
    from trackloom.plans import maps

    r, seen = np.random.default_rng(0), {}
    monkeypatch.setattr(maps, "matrix", lambda s, d: (np.arange(30), r.normal(size=(30, 3)), np.arange(30) % 2))
    for module, name in ((maps.pr, "tsne"), (maps.som, "trained"), (maps.cl, "classify")):

        def spy(*a, plain=getattr(module, name), name=name, **k):
            bound = inspect.signature(plain).bind(*a, **k)
            bound.apply_defaults()
            seen.setdefault(name, []).append(bound.arguments)
            return plain(*a, **k)

        monkeypatch.setattr(module, name, spy)
    q = maps.queries()
    for name in ("layout_tsne", "som_train_online", "som_train_growing", "classify_cv"):
        assert q[name](spark, "").count() in (1, 30)
    assert seen["tsne"][0]["steps"] == 400 and [a["cfg"].epochs for a in seen["trained"]] == [SomConfig().epochs] * 2
    c, s = seen["classify"][0], StatsConfig()
    assert (c["repeats"], c["permutations"], c["bootstrap"]) == (s.repeats, s.permutations, s.bootstrap)
