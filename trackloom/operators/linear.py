"""Layouts and patterns that are linear in the rows, from moments of the groups: a pass returns features squared numbers a
group and task, a second one the fourth moment that shrinkage needs, and rows meet their axes where they are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import NORMAL
from .ordination import packed
from .projection import signed


@dataclass
class Moments:
    """Rows, mean and sums of products about the mean."""

    n: int
    mean: np.ndarray
    s: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * other.n / n, self.s + other.s + np.outer(d, d) * self.n * other.n / n)

    @property
    def covariance(self) -> np.ndarray:
        return self.s / self.n


def moments(rows: DataFrame, vector: str, group: str | None = None) -> dict:
    """Moments of each group's vectors, a null group among them; without group of all rows, under None."""
    rows = rows.where(F.col(vector).isNotNull()).select(F.col(vector), *([group] if group else []))
    kind = rows.schema[group].dataType.simpleString() if group else "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float)
            names = b.column(1).to_pylist() if group else [None] * len(x)
            at: dict = {}
            for i, name in enumerate(names):
                at.setdefault(name, []).append(i)
            for name, i in at.items():
                c = x[i] - (m := x[i].mean(0))
                part = Moments(len(i), m, c.T @ c)
                found[name] = found[name] + part if name in found else part
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), pa.array([m.n for m in found.values()], pa.int64()), pa.array([np.r_[m.mean, m.s.ravel()].tobytes() for m in found.values()], pa.binary())], ["g", "n", "w"])

    out: dict = {}
    for r in rows.mapInArrow(run, f"g {kind}, n long, w binary").toLocalIterator():
        flat = np.frombuffer(r["w"], float)
        d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
        part = Moments(r["n"], flat[:d], flat[d:].reshape(d, d))
        out[r["g"]] = out[r["g"]] + part if r["g"] in out else part
    return out


def total(of: dict) -> Moments:
    return sum(list(of.values())[1:], next(iter(of.values())))


def projected(rows: DataFrame, key: str, vector: str, centre: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(key, axis1, axis2, ...): each centred row on the axes."""
    names = [f"axis{i + 1}" for i in range(axes.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = (np.array(b.column(1).to_pylist(), float) - centre) @ axes
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in y.T]], [key, *names])

    kind = rows.schema[key].dataType.simpleString()
    return rows.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{c} double" for c in names))


def principal(all_: Moments, k: int = 2) -> np.ndarray:
    return signed(np.linalg.eigh(all_.covariance)[1][:, ::-1][:, :k])


def scaling(rows: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """Classical scaling of Euclidean distances, which are principal scores; an axis' largest score is positive."""
    of = total(moments(rows, vector))
    y = projected(rows, key, vector, of.mean, principal(of, k))
    ends = y.agg(*[F.max_by(c, F.abs(c)).alias(c) for c in y.columns[1:]]).first()
    return y.select(key, *[(F.col(c) * (-1.0 if ends[c] < 0 else 1.0)).alias(c) for c in y.columns[1:]])


def shrunk(rows: DataFrame, vector: str, group: str, of: dict) -> np.ndarray:
    """Ledoit and Wolf's covariance within the groups of `of`, as projection.ledoit_wolf."""
    means = {g: m.mean for g, m in of.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = 0.0
        for b in batches:
            x = [np.array(v, float) - means[g] for v, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if g in means]
            s += float(((np.array(x) ** 2).sum(1) ** 2).sum()) if x else 0.0
        yield pa.RecordBatch.from_pydict({"s": [s]})

    fourth = rows.where(F.col(vector).isNotNull()).select(vector, group).mapInArrow(run, "s double").agg(F.sum("s")).first()[0]
    n = sum(m.n for m in of.values())
    s = sum(m.s for m in of.values()) / n
    d = len(s)
    mu = np.trace(s) / d
    delta = ((s - mu * np.eye(d)) ** 2).sum() / d
    beta = min(delta, (fourth / n - (s**2).sum()) / (d * n))
    a = beta / delta if delta > 0 else 0.0
    return (1 - a) * s + a * mu * np.eye(d)


def grouped(rows: DataFrame, vector: str, group: str) -> dict:
    of = {g: m for g, m in moments(rows, vector, group).items() if g is not None}
    if len(of) < 2:
        raise ValueError("two groups are needed")
    return {g: of[g] for g in sorted(of)}


def discriminant(rows: DataFrame, key: str, vector: str, group: str, k: int = 2) -> DataFrame:
    """Scores of projection.lda; rows without a group are placed, not learnt from."""
    of = grouped(rows, vector, group)
    whole = total(of)
    value, vectors = np.linalg.eigh(shrunk(rows, vector, group, of))
    white = vectors / np.sqrt(np.maximum(value, 1e-12))
    b = (np.stack([m.mean for m in of.values()]) - whole.mean) @ white
    axes = signed(white @ np.linalg.svd(b, full_matrices=False)[2].T[:, : min(k, len(of) - 1)])
    if axes.shape[1] < k:
        c = whole.covariance
        rest = np.eye(len(c)) - axes @ np.linalg.lstsq(axes.T @ c @ axes, axes.T @ c, rcond=None)[0]
        more = signed(np.linalg.eigh(rest.T @ c @ rest)[1][:, ::-1][:, : k - axes.shape[1]])
        axes = np.c_[axes, rest @ more]
    return projected(rows, key, vector, whole.mean, axes)


def least_squares(rows: DataFrame, key: str, vector: str, group: str, k: int = 2) -> DataFrame:
    """Scores of projection.plsda."""
    of = grouped(rows, vector, group)
    whole = total(of)
    c, m = whole.s, np.stack([g.n * (g.mean - whole.mean) for g in of.values()], 1)
    turn, axes = np.eye(len(c)), []
    for _ in range(k):
        w = np.linalg.svd(m, full_matrices=False)[0][:, 0]
        axes.append(turn @ w)
        cw = c @ w
        away = np.eye(len(c)) - np.outer(w, cw / (w @ cw))
        m, c, turn = away.T @ m, away.T @ c @ away, turn @ away
    return projected(rows, key, vector, whole.mean, np.array(axes).T)


def patterns(rows: DataFrame, vector: str, group: str) -> np.ndarray:
    """classify.haufe of the shrunk discriminants' weights."""
    of = grouped(rows, vector, group)
    w = np.linalg.pinv(shrunk(rows, vector, group, of)) @ np.stack([m.mean for m in of.values()]).T
    w = w - w.mean(1, keepdims=True)
    cov = total(of).covariance
    return cov @ w / np.maximum((w * (cov @ w)).sum(0), 1e-300)


def correlations(rows: DataFrame, vector: str, axes: int) -> np.ndarray:
    """Of each feature with the first `axes` features; 0 where one is constant."""
    s = total(moments(rows, vector)).s
    scale = np.sqrt(np.outer(np.diag(s), np.diag(s)[:axes]))
    return np.where(scale > 0, s[:, :axes] / np.where(scale > 0, scale, 1), 0.0)


def bca_means(rows: DataFrame, key: str, group: str, value: str, a: str, b: str, draws: int = 2000, alpha: float = 0.05, seed: int = 0, block: int = 5000) -> tuple[float, float, float]:
    """Mean of group b less that of a, and its bias-corrected accelerated bootstrap interval.

    A draw deals each group's rows over the blocks by a multinomial, and a block draws its share from its own rows, which
    together is a draw with replacement from all; a block returns a sum a draw and group, and the moments that the jackknife
    of a mean needs.
    """
    rows = rows.where(F.col(group).cast("string").isin(a, b)).select(key, group, F.array(F.col(value).cast("double")).alias("v"))
    rows = rows.where(F.col("v")[0].isNotNull())
    centre = rows.agg(F.avg(F.col("v")[0])).first()[0]
    packs, _ = packed(rows, key, group, "v", block)
    sizes = {(r["block"], r["g"]): r["n"] for r in packs.select("block", F.explode("g").alias("g")).groupBy("block", "g").agg(F.count("*").alias("n")).collect()}
    blocks = {g: sorted(k for k, h in sizes if h == g) for g in (a, b)}
    if not blocks[a] or not blocks[b]:
        raise ValueError("a group has no rows")
    n = {g: sum(sizes[k, g] for k in blocks[g]) for g in (a, b)}
    dealt = {g: dict(zip(blocks[g], np.random.default_rng([seed, i]).multinomial(n[g], [sizes[k, g] / n[g] for k in blocks[g]], size=draws).T, strict=True)) for i, g in enumerate((a, b))}
    share = packs.sparkSession.createDataFrame([(k, g, d.astype(np.int64).tobytes()) for g, of in dealt.items() for k, d in of.items()], "block int, h string, d binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, g, x, h, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = np.frombuffer(x, float)[np.array(g) == h] - centre
                r = np.random.default_rng([seed, k, int(h == b)])
                s = [float(v[r.integers(0, len(v), m)].sum()) for m in np.frombuffer(d, np.int64)]
                yield pa.RecordBatch.from_pydict({"h": pa.array([h]), "w": pa.array([np.r_[v.sum(), (v**2).sum(), (v**3).sum(), s].tobytes()], pa.binary())})

    got = {g: np.zeros(3 + draws) for g in (a, b)}
    for r in packs.select("block", "g", "x").join(share, "block").select("block", "g", "x", "h", "d").mapInArrow(run, "h string, w binary").toLocalIterator():
        got[r["h"]] += np.frombuffer(r["w"], float)
    mean = {g: got[g][0] / n[g] for g in got}
    seen = mean[b] - mean[a]
    boot = np.sort(got[b][3:] / n[b] - got[a][3:] / n[a])
    second = third = 0.0  # of the jackknife's deviations, which are (x - mean) / (n - 1), with b's sign turned
    for g, sign in ((a, -1.0), (b, 1.0)):
        m, q, c = mean[g], got[g][1] / n[g], got[g][2] / n[g]
        if n[g] > 1:
            second += n[g] * (q - m * m) / (n[g] - 1) ** 2
            third += sign * n[g] * (c - 3 * m * q + 2 * m**3) / (n[g] - 1) ** 3
    bend = third / max(6 * second**1.5, 1e-300)
    z0 = NORMAL.inv_cdf(float(np.clip(np.mean(boot < seen), 0.001, 0.999)))
    ends = []
    for q in (alpha / 2, 1 - alpha / 2):
        z = z0 + NORMAL.inv_cdf(q)
        ends.append(float(np.quantile(boot, np.clip(NORMAL.cdf(z0 + z / (1 - bend * z)), 0.001, 0.999))))
    return float(seen), ends[0], ends[1]
