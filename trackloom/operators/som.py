"""Self-organising maps.

A map is small (hundreds of nodes), so its codebook goes to every task; assignments, hits and batch epochs run on rows
where they are. An epoch returns sums by node from each task and nothing else. Tables of up to LOCAL rows are trained on
the driver instead, which saves a job an epoch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SomConfig

LOCAL = 20_000
#: Distances of rows to nodes that are held at a time.
TOGETHER = 1 << 20


def between(a: np.ndarray, b: np.ndarray, size: np.ndarray | None) -> np.ndarray:
    """Distances of places on a lattice; size: of a toroidal one."""
    d = np.abs(a[:, None] - b[None])
    if size is not None:
        d = np.minimum(d, size - d)
    return np.sqrt((d**2).sum(2))


def fading(d: np.ndarray, sigma: float, kind: str = "gaussian") -> np.ndarray:
    """The neighbourhood's weight at distances d."""
    s = max(sigma, 1e-6)
    if kind == "bubble":
        return (d <= s).astype(float)
    g = np.exp(-(d**2) / (2 * s * s))
    return (1 - d**2 / (s * s)) * g if kind == "mexican_hat" else g


@dataclass
class Lattice:
    cols: np.ndarray
    rows: np.ndarray
    topology: str = "hex"
    toroidal: bool = False
    size: np.ndarray | None = field(init=False, default=None)
    xy: np.ndarray = field(init=False)
    distance: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        hexagonal = self.topology == "hex"
        pitch = np.sqrt(3) / 2 if hexagonal else 1.0
        self.xy = np.stack([self.cols + (0.5 * (self.rows % 2) if hexagonal else 0.0), self.rows * pitch], 1).astype(float)
        if self.toroidal:
            self.size = np.array([self.cols.max() + 1, (self.rows.max() + 1) * pitch])
        self.distance = between(self.xy, self.xy, self.size)

    @classmethod
    def grid(cls, width: int, height: int, topology: str = "hex", toroidal: bool = False) -> Lattice:
        return cls(np.tile(np.arange(width), height), np.repeat(np.arange(height), width), topology, toroidal)

    @property
    def adjacent(self) -> np.ndarray:
        """Nodes at the least distance or five hundredths more."""
        near = self.distance[self.distance > 0].min(initial=np.inf)
        return (self.distance > 0) & (self.distance <= 1.05 * near)

    def neighbourhood(self, sigma: float, kind: str = "gaussian") -> np.ndarray:
        return fading(self.distance, sigma, kind)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, int(c), int(r), float(x), float(y)) for i, (c, r, (x, y)) in enumerate(zip(self.cols, self.rows, self.xy, strict=True))]
        return spark.createDataFrame(rows, "node int, col int, row int, x double, y double")


def two_nearest(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest and second nearest node of each row with their distances; of equal ones the smaller node. Rows are taken so
    many at a time that their distances stay within some megabytes."""
    step, norms = max(1, TOGETHER // max(len(w), 1)), (w * w).sum(1)
    parts = [_two_nearest(x[i : i + step], w, norms) for i in range(0, max(len(x), 1), step)]
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _two_nearest(x: np.ndarray, w: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    d = np.maximum((x * x).sum(1)[:, None] + norms - 2 * x @ w.T, 0)
    at, first = np.arange(len(x)), d.argmin(1)
    least = d[at, first]
    if len(w) > 1:
        d[at, first] = np.inf
    second = d.argmin(1)
    return first, np.sqrt(least), second, np.sqrt(d[at, second])


def assigned(vectors: DataFrame, key: str, vector: str, codebook: np.ndarray) -> DataFrame:
    """(key, bmu, bmu_distance, runner_up, runner_up_distance) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n1, d1, n2, d2 = two_nearest(np.array(b.column(1).to_pylist(), float), codebook)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n1, pa.int32()), pa.array(d1), pa.array(n2, pa.int32()), pa.array(d2)], [key, "bmu", "bmu_distance", "runner_up", "runner_up_distance"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, vector).mapInArrow(run, f"{key} {kind}, bmu int, bmu_distance double, runner_up int, runner_up_distance double")


def hits(assignment: DataFrame, group: str) -> DataFrame:
    return assignment.groupBy(F.col("bmu").alias("node"), F.col(group).alias("g")).agg(F.count("*").alias("hits"))


def u_matrix(codebook: np.ndarray, lattice: Lattice) -> np.ndarray:
    """Mean distance of each node's weights to those of its neighbours."""
    d = np.sqrt(np.maximum(((codebook[:, None] - codebook[None]) ** 2).sum(2), 0))
    a = lattice.adjacent
    return (d * a).sum(1) / np.maximum(a.sum(1), 1)


def topographic_error(assignment: DataFrame, lattice: Lattice) -> DataFrame:
    """Share of rows whose two nearest nodes are not neighbours."""
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(lattice.adjacent), strict=True)]
    near = assignment.sparkSession.createDataFrame(pairs, "a int, b int")
    x = assignment.join(F.broadcast(near), (F.col("bmu") == F.col("a")) & (F.col("runner_up") == F.col("b")), "left")
    return x.agg(F.avg(F.when(F.col("a").isNull(), 1.0).otherwise(0.0)).alias("topographic_error"))


def quality(assignment: DataFrame, group: str, lattice: Lattice) -> DataFrame:
    """quantisation_error, topographic_error, occupied, largest_load, ambiguity and purity."""
    a = assignment.agg(F.avg("bmu_distance").alias("quantisation_error"), F.countDistinct("bmu").alias("occupied"), F.avg(F.try_divide("bmu_distance", "runner_up_distance")).alias("ambiguity"))
    h = hits(assignment, group).groupBy("node").agg(F.max("hits").alias("top"), F.sum("hits").alias("n")).agg((F.sum("top") / F.sum("n")).alias("purity"), F.max("n").alias("largest_load"))
    return a.crossJoin(h).crossJoin(topographic_error(assignment, lattice))


def enrichment(assignment: DataFrame, group: str) -> DataFrame:
    """(node, g, observed, expected, log2_enrichment) of the cells that have rows."""
    h = hits(assignment, group)
    by_node, by_g = h.groupBy(F.col("node").alias("n_")).agg(F.sum("hits").alias("k")), h.groupBy(F.col("g").alias("g_")).agg(F.sum("hits").alias("m"))
    total = h.agg(F.sum("hits").alias("total"))
    x = h.join(by_node, F.col("node") == F.col("n_")).join(by_g, F.col("g") == F.col("g_")).crossJoin(total)
    expected = F.col("k") * F.col("m") / F.col("total")
    return x.select("node", "g", F.col("hits").alias("observed"), expected.alias("expected"), F.log2((F.col("hits") + 0.5) / (expected + 0.5)).alias("log2_enrichment"))


def gradients(codebook: np.ndarray, lattice: Lattice, weights: np.ndarray, names: list[str]) -> list[tuple[str, float, float, float]]:
    """(feature, angle_deg, magnitude, plane_r2) of the hit-weighted plane through each feature's node values."""
    w = np.where(weights > 0, weights, 0.0).astype(float)
    a = np.c_[np.ones(len(w)), lattice.xy]
    normal = np.linalg.pinv(a.T @ (a * w[:, None])) @ (a * w[:, None]).T
    out = []
    for name, z in zip(names, codebook.T, strict=True):
        b = normal @ z
        mean = (w * z).sum() / w.sum()
        total = (w * (z - mean) ** 2).sum()
        out.append((name, float(np.degrees(np.arctan2(b[2], b[1]))), float(np.hypot(b[1], b[2])), float(1 - (w * (z - a @ b) ** 2).sum() / total) if total > 0 else 0.0))
    return out


# --- training --------------------------------------------------------------------------------------------------------


@dataclass
class Map:
    codebook: np.ndarray
    lattice: Lattice
    history: list[dict] = field(default_factory=list)
    relevance: np.ndarray | None = None


def initial(x: np.ndarray, lattice: Lattice, kind: str, rng: np.random.Generator) -> np.ndarray:
    n = len(lattice.cols)
    if kind == "sample":
        return x[rng.choice(len(x), n, replace=n > len(x))].copy()
    if kind == "random":
        return rng.uniform(x.min(0), x.max(0), (n, x.shape[1]))
    return plane(x.mean(0), np.cov(x.T, ddof=0).reshape(x.shape[1], x.shape[1]), lattice)


def plane(mean: np.ndarray, covariance: np.ndarray, lattice: Lattice) -> np.ndarray:
    """Nodes on the plane of the two leading components."""
    value, vector = np.linalg.eigh(covariance)
    axes = (vector[:, ::-1] * np.sqrt(np.maximum(value[::-1], 0)))[:, :2]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)
    span = np.ptp(lattice.xy, axis=0)
    unit = (lattice.xy - lattice.xy.min(0)) / np.where(span > 0, span, 1) * 2 - 1
    return mean + 1.7 * unit[:, : axes.shape[1]] @ axes.T


def sums(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    b, d, _, _ = two_nearest(x, w)
    return by_node(x, b, len(w)), np.bincount(b, minlength=len(w)).astype(float), float(d.sum())


def by_node(x: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
    """Sums of the rows of each node."""
    order = np.argsort(node, kind="stable")
    there, first = np.unique(node[order], return_index=True)
    s = np.zeros((nodes, x.shape[1]))
    if len(there):
        s[there] = np.add.reduceat(x[order], first, axis=0)
    return s


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, without nulls, as rows of doubles; no number becomes a Python object."""
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or len(lengths) and lengths.min() != lengths.max():
        raise ValueError("vectors of one length are needed")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def width_at(epoch: int, cfg: SomConfig, lattice: Lattice) -> float:
    """Width of the neighbourhood in an epoch, the first being 1."""
    start = max(lattice.distance.max() / 2, cfg.sigma_final)
    return max(cfg.sigma_final, start * np.exp(-epoch / max(1.0, cfg.decay * cfg.epochs)))


def batch(x: np.ndarray | DataFrame, cfg: SomConfig, vector: str = "features", start: np.ndarray | None = None) -> Map:
    """Batch training. x: a matrix, or a table of vectors whose epochs run as jobs that return sums by node."""
    if isinstance(x, DataFrame):
        n = x.count()
        if n <= LOCAL:
            return batch(np.array([r[0] for r in x.select(vector).collect()], float), cfg, start=start)
        sample = np.array([r[0] for r in x.select(vector).sample(min(1.0, LOCAL / n), cfg.seed).limit(LOCAL).collect()], float)
        each = lambda w: _spark_sums(x.select(vector), w)
    else:
        n, sample = len(x), x
        each = lambda w: sums(x, w)
    lattice = Lattice.grid(*cfg.size(n), cfg.topology, cfg.toroidal)
    w = initial(sample, lattice, cfg.init, np.random.default_rng(cfg.seed)) if start is None else start.copy()
    history = []
    for epoch in range(1, cfg.epochs + 1):
        sigma = width_at(epoch, cfg, lattice)
        s, c, error = each(w)
        w = updated(w, s, c, lattice.neighbourhood(sigma, cfg.neighbourhood))
        history.append({"epoch": epoch, "sigma": sigma, "quantisation_error": error / max(n, 1)})
    return Map(w, lattice, history)


def updated(w: np.ndarray, s: np.ndarray, c: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The codebook after an epoch of sums s and counts c by node, spread by h; a node that nothing reaches stays."""
    weight = h @ c
    reached = np.abs(weight) > 1e-12
    return np.where(reached[:, None], (h @ s) / np.where(reached, weight, 1)[:, None], w)


def _spark_sums(vectors: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, c, e = np.zeros_like(w), np.zeros(len(w)), 0.0
        for b in batches:
            if b.num_rows:
                s_, c_, e_ = sums(np.array(b.column(0).to_pylist(), float), w)
                s, c, e = s + s_, c + c_, e + e_
        at = np.arange(len(w))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(s), pa.list_(pa.float64())), pa.array(c), pa.array(np.where(at == 0, e, 0.0))], ["node", "s", "c", "e"])

    d = w.shape[1]
    total = vectors.mapInArrow(run, "node long, s array<double>, c double, e double").groupBy("node").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(d)]).alias("s"), F.sum("c").alias("c"), F.sum("e").alias("e")).orderBy("node").collect()
    return np.array([r["s"] for r in total]), np.array([r["c"] for r in total]), sum(r["e"] for r in total)


def moved(w: np.ndarray, x: np.ndarray, rates: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
    """The codebook after these rows, one after another, moved it by the rates of their nodes to all nodes; what is left of each
    node's former place; and the sum of the rows' distances. All find their nearest nodes before the first moves it."""
    d = (w * w).sum(1) - 2 * (x @ w.T)
    b = d.argmin(1)
    rate = rates(b)
    distance = float(np.sqrt(np.maximum(d[np.arange(len(x)), b] + (x * x).sum(1), 0)).sum())
    left = np.cumprod((1 - rate)[::-1], axis=0)[::-1]  # of what is there before a row
    return left[0][:, None] * w + (rate * np.vstack([left[1:], np.ones((1, len(w)))])).T @ x, left[0], distance


def online(x: np.ndarray, cfg: SomConfig) -> Map:
    """One row at a time in a random order; sequential by nature, so for tables that fit a task (scan.online takes more)."""
    rng = np.random.default_rng(cfg.seed)
    lattice = Lattice.grid(*cfg.size(len(x)), cfg.topology, cfg.toroidal)
    w = initial(x, lattice, cfg.init, rng)
    history = []
    for epoch in range(1, cfg.epochs + 1):
        sigma = width_at(epoch, cfg, lattice)
        h = lattice.neighbourhood(sigma, cfg.neighbourhood) * min(1.0, cfg.learning_rate * np.exp(-epoch / max(1.0, cfg.decay * cfg.epochs)))
        for i in rng.permutation(len(x)):
            b = int(((w - x[i]) ** 2).sum(1).argmin())
            w += h[b][:, None] * (x[i] - w)
        history.append({"epoch": epoch, "sigma": sigma, "quantisation_error": float(two_nearest(x, w)[1].mean())})
    return Map(w, lattice, history)


def supervised(x: np.ndarray, y: np.ndarray, cfg: SomConfig) -> Map:
    """Batch training on features and group indicators side by side, weighted by label_weight; the codebook is that of the
    features."""
    a, k = cfg.label_weight, int(y.max()) + 1
    scale = np.sqrt((1 - a) / x.shape[1])
    m = batch(np.c_[scale * x, np.sqrt(a / k) * np.eye(k)[y]], cfg)
    return Map(m.codebook[:, : x.shape[1]] / scale, m.lattice, m.history)


def relevance_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, lam: np.ndarray, own: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, int]:
    """The sum over rows of the gradient of `relevance`, and how many rows have both a node of their own group and one of
    another; a few rows' distances at a time."""
    total, fine, step = np.zeros(len(lam)), 0, max(1, TOGETHER // max(len(w), 1))
    norms = (w * w) @ lam
    for s in range(0, len(x), step):
        v, g = x[s : s + step], y[s : s + step]
        d = np.maximum(((v * v) @ lam)[:, None] + norms - 2 * (v * lam) @ w.T, 0)
        same, at = own == g[:, None], np.arange(len(v))
        good, bad = np.where(same & known, d, np.inf), np.where(~same & known, d, np.inf)
        i, j = good.argmin(1), bad.argmin(1)
        ok = np.isfinite(good[at, i]) & np.isfinite(bad[at, j])
        dp, dm = good[at, i][ok][:, None], bad[at, j][ok][:, None]
        total += ((dm * (v[ok] - w[i[ok]]) ** 2 - dp * (v[ok] - w[j[ok]]) ** 2) / np.maximum((dp + dm) ** 2, 1e-12)).sum(0)
        fine += int(ok.sum())
    return total, fine


def relevance(x: np.ndarray, y: np.ndarray, cfg: SomConfig) -> Map:
    """Batch training with a weight for each feature, moved so that rows come nearer to nodes of their own group than to
    others; weights have a floor and mean one."""
    d, lam = x.shape[1], np.ones(x.shape[1])
    m = batch(x, cfg)
    w, history = m.codebook, []
    k = int(y.max()) + 1
    for epoch in range(1, cfg.epochs + 1):
        root = np.sqrt(lam)
        b = two_nearest(x * root, w * root)[0]
        votes = np.zeros((len(w), k))
        np.add.at(votes, (b, y), 1)
        own, known = votes.argmax(1), votes.sum(1) > 0
        dist = ((x[:, None] - w[None]) ** 2 * lam).sum(2) if len(x) * len(w) * d < 5e7 else None
        if dist is None:
            dist = (x * x) @ lam
            dist = dist[:, None] + (w * w) @ lam - 2 * (x * lam) @ w.T
        good = np.where((own == y[:, None]) & known, dist, np.inf)
        bad = np.where((own != y[:, None]) & known, dist, np.inf)
        i, j = good.argmin(1), bad.argmin(1)
        ok = np.isfinite(good[np.arange(len(x)), i]) & np.isfinite(bad[np.arange(len(x)), j])
        if ok.any():
            dp, dm = good[ok, i[ok]][:, None], bad[ok, j[ok]][:, None]
            g = (dm * (x[ok] - w[i[ok]]) ** 2 - dp * (x[ok] - w[j[ok]]) ** 2) / np.maximum((dp + dm) ** 2, 1e-12)
            lam = np.maximum(lam - cfg.relevance_rate * d * g.mean(0), cfg.relevance_floor)
            lam *= d / lam.sum()
        root = np.sqrt(lam)
        s, c, error = sums(x * root, w * root)
        h = m.lattice.neighbourhood(width_at(epoch, cfg, m.lattice), cfg.neighbourhood)
        weight = h @ c
        w = np.where(weight[:, None] > 1e-12, (h @ (s / root)) / np.maximum(weight, 1e-12)[:, None], w)
        history.append({"epoch": epoch, "sigma": width_at(epoch, cfg, m.lattice), "quantisation_error": error / len(x)})
    return Map(w, m.lattice, history, lam)


def growing(x: np.ndarray, cfg: SomConfig) -> Map:
    """A map that adds nodes at its border where the error exceeds -d ln(spread), and passes the error on inside."""
    rng = np.random.default_rng(cfg.seed)
    d = x.shape[1]
    limit, most = -d * np.log(cfg.spread), min(cfg.max_nodes, max(4, int(10 * np.sqrt(len(x)))))
    places = {(0, 0): 0, (1, 0): 1, (0, 1): 2, (1, 1): 3}
    w = list(x[rng.choice(len(x), 4, replace=len(x) < 4)].astype(float))
    error = [0.0] * 4
    side = lambda p: [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
    history = []
    for epoch in range(1, cfg.epochs + 1):
        rate = cfg.learning_rate * np.exp(-epoch / 15)
        at = {i: p for p, i in places.items()}
        for i in rng.permutation(len(x)):
            b = int(((np.array(w) - x[i]) ** 2).sum(1).argmin())
            error[b] += float(((w[b] - x[i]) ** 2).sum())
            for k, f in ((b, rate), *((places[q], rate / 4) for q in side(at[b]) if q in places)):
                w[k] = w[k] + f * (x[i] - w[k])
            if error[b] > limit and len(w) < most:
                free = [q for q in side(at[b]) if q not in places]
                for q in free[: most - len(w)]:
                    opposite = places.get((2 * at[b][0] - q[0], 2 * at[b][1] - q[1]))
                    places[q] = len(w)
                    at[len(w)] = q
                    w.append(2 * w[b] - w[opposite] if opposite is not None else w[b].copy())
                    error.append(0.0)
                if not free:
                    for q in side(at[b]):
                        error[places[q]] *= 1.5
                error[b] = limit / 2
        history.append({"epoch": epoch, "nodes": len(w), "quantisation_error": float(two_nearest(x, np.array(w))[1].mean())})
    cols, rows = (np.array([at[i][k] for i in range(len(w))]) for k in (0, 1))
    return Map(np.array(w), Lattice(cols - cols.min(), rows - rows.min(), "rect"), history)


def trained(x: np.ndarray, cfg: SomConfig, y: np.ndarray | None = None) -> Map:
    """By cfg.algorithm; without two groups the supervised ones are trained as batch."""
    two = y is not None and len(np.unique(y)) > 1
    if cfg.algorithm in ("supervised", "relevance") and two:
        return {"supervised": supervised, "relevance": relevance}[cfg.algorithm](x, y, cfg)
    return {"online": online, "growing": growing}.get(cfg.algorithm, batch)(x, cfg)
