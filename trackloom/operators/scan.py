"""Parameter scans: every cell of a grid is laid out and scored, cells that are as good as the best form a plateau, and of
a plateau the cell nearest to what the method suggests is chosen. A cell that fails is a row with its error.

Maps are trained on rows where they are, all cells in one pass an epoch. A layout of up to LIMIT rows is a task; t-SNE and
Isomap of more rows work by pairs of blocks, and so do their measures. Other methods raise there.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SomConfig
from . import geodesic, pairs, registry, scores, som
from . import projection as pr
from . import ranked as rk
from .ordination import packed

#: Columns by which cells are compared, and whether more is better. Fixed values.
CRITERIA = {"rnx_auc": True, "trustworthiness": True, "continuity": True, "dubious_fraction": False, "group_silhouette": True, "quantisation_error": False, "topographic_error": False}


def judged(cells: list[dict], keys: list[str], score: str, higher: bool, tolerance: float = 0.02, of_range: bool = False, suggested: dict | None = None) -> list[dict]:
    """The cells (in the order of the grid) with cell, near, component, best and chosen.

    near: within tolerance of the best score, as a share of that score or of the scores' range, whichever is more
    (of_range: of the range alone). component: near cells that are reached from each other by single steps of one
    parameter share their least number. chosen: of the near cells the one nearest to the suggested values, relative to
    them; the best where nothing is suggested. A cell without a finite score is none of these.
    """
    good = [i for i, c in enumerate(cells) if c.get(score) is not None and math.isfinite(c[score])]
    out = [{**c, "cell": i, "near": False, "component": None, "best": False, "chosen": False} for i, c in enumerate(cells)]
    if not good:
        return out
    value = [out[i][score] for i in good]
    top = max(value) if higher else min(value)
    best, span = good[value.index(top)], max(value) - min(value)
    band = tolerance * ((span or 1.0) if of_range else max(abs(top), span, 1e-12))
    near = [i for i, v in zip(good, value, strict=True) if abs(v - top) <= band]
    place = {k: {v: j for j, v in enumerate(sorted({c[k] for c in cells}, key=lambda v: (isinstance(v, str), v)))} for k in keys}
    at = {i: [place[k][out[i][k]] for k in keys] for i in near}
    name = {i: i for i in near}
    for _ in near:  # a step joins neighbours, so as many steps as there are cells join every component
        moved = {i: min(name[j] for j in near if sum(abs(a - b) for a, b in zip(at[i], at[j], strict=True)) <= 1) for i in near}
        if moved == name:
            break
        name = moved

    def far(i: int) -> float:
        total = 0.0
        for k, want in (suggested or {}).items():
            have = out[i][k]
            total += float(have != want) if isinstance(want, (str, bool)) else ((have - want) / max(abs(want), 1e-9)) ** 2
        return total

    for i in near:
        out[i].update(near=True, component=name[i])
    out[best]["best"] = True
    out[min(near, key=far) if suggested else best]["chosen"] = True
    return out


# --- maps ------------------------------------------------------------------------------------------------------------


@dataclass
class Cell:
    """One map of a scan: its history and snapshots (epoch, codebook), or the error that stopped it."""

    config: SomConfig
    map: som.Map | None = None
    snapshots: list[tuple[int, np.ndarray]] | None = None
    error: str | None = None


def _start(vectors: DataFrame, vector: str, n: int, cells: list[Cell]) -> None:
    """First codebooks: from the moments or the range of all rows, or rows of the least hashes."""
    kinds = {c.config.init for c in cells}
    moments = _moments(vectors, vector) if kinds & {"pca", "random"} else None
    for c in cells:
        try:
            lattice = som.Lattice.grid(*c.config.size(n), c.config.topology, c.config.toroidal)
            nodes = len(lattice.cols)
            if not nodes:
                raise ValueError("a map needs a node")
            if c.config.init == "sample":
                picked = vectors.select(vector).orderBy(F.xxhash64(F.lit(c.config.seed), vector), vector).limit(nodes).collect()
                w = np.array([picked[i % len(picked)][0] for i in range(nodes)], float)
            elif c.config.init == "random":
                w = np.random.default_rng(c.config.seed).uniform(moments[2], moments[3], (nodes, len(moments[0])))
            else:
                w = som.plane(*moments[:2], lattice)
            c.map, c.snapshots = som.Map(w, lattice), [(0, w)]
        except Exception as failed:
            c.error = f"{type(failed).__name__}: {failed}"


def _moments(vectors: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean, covariance, least and greatest values of the features; a task returns its sums about its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, s, low, high = 0, None, None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            x = som.matrix(b.column(0))
            m = x.mean(0)
            if n == 0:
                mean, s, low, high = m * 0, np.zeros((len(m), len(m))), x.min(0), x.max(0)
            d, both = m - mean, n + len(x)
            s = s + (x - m).T @ (x - m) + np.outer(d, d) * n * len(x) / both
            mean, n = mean + d * len(x) / both, both
            low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "mean": mean.tolist(), "s": s.ravel().tolist(), "low": low.tolist(), "high": high.tolist()}])

    n, mean, s, low, high = 0, 0.0, 0.0, np.inf, -np.inf
    for r in vectors.select(vector).mapInArrow(run, "n long, mean array<double>, s array<double>, low array<double>, high array<double>").toLocalIterator():
        m = np.array(r["mean"])
        d, both = m - mean, n + r["n"]
        s = s + np.array(r["s"]).reshape(len(m), len(m)) + np.outer(d, d) * n * r["n"] / both
        mean, n = mean + d * r["n"] / both, both
        low, high = np.minimum(low, r["low"]), np.maximum(high, r["high"])
    return mean, s / max(n, 1), low, high


#: Tasks that add up what the tasks over the rows return; so many numbers a map reach the driver.
ADDERS = 8


def _pass(vectors: DataFrame, vector: str, cells: list[Cell]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float, float]]:
    """Of each map: sums of the rows by node, their counts and squared distances by node, the sum of distances, and the rows
    whose two nearest nodes are no neighbours. vector: arrays, or blocks of rows as bytes. A task returns a row a map, of
    nodes times features numbers; such rows are added up as they come."""
    books = [(c.map.codebook, c.map.lattice.adjacent) for c in cells]
    schema, names = "map int, part int, w binary", ["map", "part", "w"]

    def passed_on(held: dict[int, np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
        for i, w in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([w.tobytes()], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {i: np.zeros(w.size + 2 * len(w) + 2) for i, (w, _) in enumerate(books)}
        for b in batches:
            if b.num_rows:
                blocks = pa.types.is_binary(b.column(0).type)
                x = np.concatenate([np.frombuffer(v.as_py(), float) for v in b.column(0)]).reshape(-1, books[0][0].shape[1]) if blocks else som.matrix(b.column(0))
                for i, (w, near) in enumerate(books):
                    n1, d1, n2, _ = som.two_nearest(x, w)
                    s = som.by_node(x, n1, len(w))
                    held[i] += np.r_[s.ravel(), np.bincount(n1, minlength=len(w)), np.bincount(n1, d1 * d1, len(w)), d1.sum(), (~near[n1, n2]).sum()]
        yield from passed_on(held, TaskContext.get().partitionId())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, w in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                held[i] = held.get(i, 0.0) + np.frombuffer(w.as_py(), float)
        yield from passed_on(held, TaskContext.get().partitionId())

    total: dict[int, np.ndarray] = {}
    for r in sorted(vectors.select(vector).mapInArrow(run, schema).repartition(ADDERS, "part").mapInArrow(add, schema).collect(), key=lambda r: (r["map"], r["part"])):
        total[r["map"]] = total.get(r["map"], 0.0) + np.frombuffer(r["w"], float)
    out = []
    for i, (w, _) in enumerate(books):
        t = total.get(i, np.zeros(w.size + 2 * len(w) + 2))
        out.append((t[: w.size].reshape(w.shape), t[w.size : -2 - len(w)], t[-2 - len(w) : -2], float(t[-2]), float(t[-1])))
    return out


def maps(vectors: DataFrame, vector: str, grid: list[dict], base: SomConfig | None = None, snapshots: int = 20) -> list[Cell]:
    """A batch map for each cell of the grid (fields of SomConfig by name), all trained together: a pass over the rows an
    epoch, whatever the number of cells. History has epoch, sigma, quantisation_error and topographic_error before the
    epoch's update, and one entry more for the finished map; up to so many snapshots are kept. Rows with a null vector or
    null components are left out."""
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # a row of sums is as large as a map
    rows = vectors.where(_whole(vector)).select(vector).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, cells = rows.count(), []
        for g in grid:
            try:
                cells.append(Cell(replace(base or SomConfig(), **g)))
            except TypeError as failed:
                cells.append(Cell(base or SomConfig(), error=str(failed)))
        if not n:
            return [replace(c, error="no rows") for c in cells]
        _start(rows, vector, n, [c for c in cells if not c.error])
        for epoch in range(1, max((c.config.epochs for c in cells), default=0) + 2):
            live = [c for c in cells if not c.error and epoch <= c.config.epochs + 1]
            if not live:
                break
            for c, (s, count, _, e, t) in zip(live, _pass(rows, vector, live), strict=True):
                m, cfg = c.map, c.config
                sigma = som.width_at(min(epoch, cfg.epochs), cfg, m.lattice)
                m.history.append({"epoch": epoch, "sigma": sigma, "quantisation_error": e / n, "topographic_error": t / n})
                if epoch > cfg.epochs:
                    continue
                m.codebook = som.updated(m.codebook, s, count, m.lattice.neighbourhood(sigma, cfg.neighbourhood))
                if epoch % max(1, cfg.epochs // max(snapshots, 1)) == 0 or epoch == cfg.epochs:
                    c.snapshots.append((epoch, m.codebook))
        return cells
    finally:
        rows.unpersist()


#: Tasks that an epoch of `online` is dealt to, and the most rows that one of them holds.
LANES, HELD = 12, 100_000


def online(vectors: DataFrame, key: str, vector: str, cfg: SomConfig, lanes: int = 0, together: int = 0) -> som.Map:
    """som.online over rows of any number: an epoch is a pass over the rows, which are dealt to lanes.

    A lane takes its rows one after another in a random order, from the codebook that the epoch begins with. What it does to
    a node is linear, w -> a w + v, and the lanes' moves are made one after another in a random order: of som.online it
    differs in that a lane finds nearest nodes on its own map, and that so many rows `together` (a hundredth of the nodes)
    find theirs before any of them moves it. With one lane and one row at a time the steps are those of som.online. History
    has the mean distance of a row to its node when the row was met.
    """
    rows = vectors.where(_whole(vector))
    packs, sizes = packed(rows, key, None, vector)
    first = Cell(cfg)
    if not (n := sum(sizes)):
        raise ValueError("no rows")
    _start(rows.select(vector), vector, n, [first])
    if first.error:
        raise ValueError(first.error)
    w, lattice, history = first.map.codebook, first.map.lattice, []
    together, lanes = together or max(1, len(w) // 100), lanes or max(LANES, -(-n // HELD))
    kept = packs.select(F.pmod(F.col("block"), F.lit(lanes)).alias("lane"), "block", "x").repartitionByRange(lanes, "lane").sortWithinPartitions("lane", "block").select("lane", "x").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for epoch in range(1, cfg.epochs + 1):
            sigma = som.width_at(epoch, cfg, lattice)
            rate = min(1.0, cfg.learning_rate * np.exp(-epoch / max(1.0, cfg.decay * cfg.epochs)))

            def rates(b: np.ndarray, xy=lattice.xy, size=lattice.size, sigma=sigma, rate=rate) -> np.ndarray:
                return rate * som.fading(som.between(xy[b], xy, size), sigma, cfg.neighbourhood)

            moved, error = _lanes(kept, w, rates, together, [cfg.seed, epoch]), 0.0
            for i in np.random.default_rng([cfg.seed, epoch]).permutation(sorted(moved)).tolist():
                a, v, e = moved[i]
                w, error = a[:, None] * w + v, error + e
            history.append({"epoch": epoch, "sigma": sigma, "quantisation_error": error / n})
        return som.Map(w, lattice, history)
    finally:
        kept.unpersist()


def _lanes(rows: DataFrame, w: np.ndarray, rates: Callable[[np.ndarray], np.ndarray], together: int, seed: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Of each lane of (lane, x), in their order, what it does to the codebook: a and v of w -> a w + v; and the sum of
    distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            x = np.concatenate(held).reshape(-1, w.shape[1])
            x = x[np.random.default_rng([*seed, now]).permutation(len(x))]
            own, kept, error = w, np.ones(len(w)), 0.0
            for s in range(0, len(x), together):
                own, left, e = som.moved(own, x[s : s + together], rates)
                kept, error = kept * left, error + e
            data = np.r_[kept, (own - kept[:, None] * w).ravel(), error].tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([data], pa.binary())], ["lane", "w"])

        for b in batches:
            for lane, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if lane != now:
                    if now is not None:
                        yield done()
                    now, held = lane, []
                held.append(np.frombuffer(x.as_py(), float))
        if now is not None:
            yield done()

    out = {}
    for r in rows.mapInArrow(run, "lane int, w binary").collect():
        t = np.frombuffer(r["w"], float)
        out[r["lane"]] = t[: len(w)], t[len(w) : -1].reshape(w.shape), float(t[-1])
    return out


def relevance(vectors: DataFrame, vector: str, label: str, cfg: SomConfig) -> som.Map:
    """som.relevance over rows of any number: each epoch is three passes that return sums, of the groups' votes by node, of
    the gradient of the weights, and of the rows by node. Rows without a label count in the last alone."""
    rows = vectors.where(_whole(vector)).select(F.col(vector).alias("v"), F.col(label).alias("label"))
    names = sorted(r[0] for r in rows.where("label is not null").select("label").distinct().collect())
    first = maps(rows, "v", [{}], cfg)[0]
    if first.error:
        raise RuntimeError(first.error)
    m = som.Map(first.map.codebook, first.map.lattice)
    number = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col("label")) - 1, F.lit(-1)) if names else F.lit(-1)
    wide = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("v", number.cast("int").alias("g")).repartition(wide).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        w, n, k = m.codebook, rows.count(), len(names)
        nodes, d = w.shape
        lam = np.ones(d)
        for epoch in range(1, cfg.epochs + 1):

            def voted(x: np.ndarray, y: np.ndarray, w=w, root=np.sqrt(lam)) -> np.ndarray:
                b = som.two_nearest(x[y >= 0] * root, w * root)[0]
                return np.bincount(b * k + y[y >= 0], minlength=nodes * k).astype(float)

            votes = _summed(rows, voted, nodes * k).reshape(nodes, k)
            own, known = votes.argmax(1) if k else np.zeros(nodes, int), votes.sum(1) > 0

            def gradient(x: np.ndarray, y: np.ndarray, w=w, lam=lam, own=own, known=known) -> np.ndarray:
                g, ok = som.relevance_gradient(x[y >= 0], y[y >= 0], w, lam, own, known)
                return np.r_[g, ok]

            t = _summed(rows, gradient, d + 1)
            if t[d] > 0:
                lam = np.maximum(lam - cfg.relevance_rate * d * t[:d] / t[d], cfg.relevance_floor)
                lam *= d / lam.sum()

            def placed(x: np.ndarray, y: np.ndarray, w=w, root=np.sqrt(lam)) -> np.ndarray:
                s, c, e = som.sums(x * root, w * root)
                return np.r_[s.ravel(), c, e]

            t = _summed(rows, placed, nodes * (d + 1) + 1)
            s, c = t[: nodes * d].reshape(nodes, d) / np.sqrt(lam), t[nodes * d : -1]
            h = m.lattice.neighbourhood(som.width_at(epoch, cfg, m.lattice), cfg.neighbourhood)
            weight = (h @ c)[:, None]
            w = np.where(weight > 1e-12, (h @ s) / np.maximum(weight, 1e-12), w)
            m.history.append({"epoch": epoch, "sigma": som.width_at(epoch, cfg, m.lattice), "quantisation_error": float(t[-1]) / max(n, 1)})
        return som.Map(w, m.lattice, m.history, lam)
    finally:
        rows.unpersist()


def _summed(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over (v, g) of what a batch of rows gives, `size` numbers; tasks' sums are added up by ADDERS tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of(som.matrix(b.column(0)), b.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "w"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {p: np.frombuffer(w.as_py(), float) for b in batches for p, w in zip(b.column(0).to_pylist(), b.column(1), strict=True)}
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([min(parts)], pa.int32()), pa.array([sum(parts[p] for p in sorted(parts)).tobytes()], pa.binary())], ["part", "w"])

    found = rows.mapInArrow(run, "part int, w binary").repartition(ADDERS, "part").mapInArrow(add, "part int, w binary").collect()
    return sum((np.frombuffer(r["w"], float) for r in sorted(found, key=lambda r: r["part"])), np.zeros(size))


def growing(vectors: DataFrame, key: str, vector: str, cfg: SomConfig) -> som.Map:
    """som.growing over rows of any number: an epoch is a pass over the rows, whose moves are taken together.

    A row moves its node by the rate and the nodes beside it by a quarter; over an epoch in random order a node keeps
    (1 - rate)^hits (1 - rate / 4)^hits beside of its place, and goes for the rest to the mean of its rows, those of the
    nodes beside it at a quarter. After the moves every node whose error exceeds -d ln(spread) grows or passes its error on,
    once an epoch, the largest error first. History has the error before an epoch's moves.
    """
    rows, sizes = packed(vectors.where(_whole(vector)), key, None, vector)
    rows = rows.select("x").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = sum(sizes)
        first = vectors.where(_whole(vector)).select(vector).orderBy(F.xxhash64(F.lit(cfg.seed), key), key).limit(4).collect()
        if not first:
            raise ValueError("no rows")
        w = np.array([first[i % len(first)][0] for i in range(4)], float)
        limit, most = -w.shape[1] * np.log(cfg.spread), min(cfg.max_nodes, max(4, int(10 * np.sqrt(n))))
        places = [(0, 0), (1, 0), (0, 1), (1, 1)]
        error, history = np.zeros(4), []
        for epoch in range(1, cfg.epochs + 1):
            cols, lines = np.array(places).T
            lattice = som.Lattice(cols, lines, "rect")
            [(s, c, squares, e, _)] = _pass(rows, "x", [Cell(cfg, som.Map(w, lattice))])
            rate = min(cfg.learning_rate * np.exp(-epoch / 15), 1 - 1e-12)
            beside = lattice.adjacent.astype(float)
            near, weight = beside @ c, rate * c + rate / 4 * (beside @ c)
            keep = np.exp(c * np.log1p(-rate) + near * np.log1p(-rate / 4))[:, None]
            w = np.where(weight[:, None] > 0, keep * w + (1 - keep) * (rate * s + rate / 4 * (beside @ s)) / np.where(weight > 0, weight, 1)[:, None], w)
            w, places, error = _grown(w, places, error + squares, limit, most)
            history.append({"epoch": epoch, "nodes": len(w), "quantisation_error": e / n})
        cols, lines = np.array(places).T
        return som.Map(w, som.Lattice(cols - cols.min(), lines - lines.min(), "rect"), history)
    finally:
        rows.unpersist()


def _grown(w: np.ndarray, places: list[tuple[int, int]], error: np.ndarray, limit: float, most: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Nodes, places and errors after every node over the limit grew to its free sides or passed its error on."""
    at, w, places, error = {p: i for i, p in enumerate(places)}, list(w), list(places), error.tolist()
    for b in sorted((i for i, e in enumerate(error) if e > limit), key=lambda i: (-error[i], i)):
        if len(w) >= most:
            break
        c, r = places[b]
        sides = [(c + 1, r), (c - 1, r), (c, r + 1), (c, r - 1)]
        free = [q for q in sides if q not in at]
        for q in free[: most - len(w)]:
            opposite = at.get((2 * c - q[0], 2 * r - q[1]))
            at[q] = len(w)
            places.append(q)
            w.append(2 * w[b] - w[opposite] if opposite is not None else w[b].copy())
            error.append(0.0)
        if not free:
            for q in sides:
                error[at[q]] *= 1.5
        error[b] = limit / 2
    return np.array(w), places, np.array(error)


def map_scan(vectors: DataFrame, vector: str, grid: list[dict], base: SomConfig | None = None, criterion: str = "quantisation_error", tolerance: float = 0.02) -> tuple[DataFrame, list[Cell]]:
    """Scores of the maps of a grid (band relative to the range of the scores) and the maps themselves."""
    cells = maps(vectors, vector, grid, base)
    rows = []
    for g, c in zip(grid, cells, strict=True):
        last = c.map.history[-1] if c.map else {}
        rows.append({**g, "quantisation_error": last.get("quantisation_error"), "topographic_error": last.get("topographic_error"), "error": c.error})
    return table(vectors, judged(rows, list(grid[0]), criterion, CRITERIA[criterion], tolerance, of_range=True), list(grid[0])), cells


def placed(vectors: DataFrame, key: str, vector: str, cells: list[Cell]) -> DataFrame:
    """(cell, key, node) of every row on every finished map, in one pass over the rows; empty without a finished map."""
    kind = vectors.schema[key].dataType.simpleString()
    books = [(i, c.map.codebook) for i, c in enumerate(cells) if c.map is not None and not c.error]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = som.matrix(b.column(1))
            for i, w in books:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), b.column(0), pa.array(som.two_nearest(x, w)[0].astype(np.int32))], ["cell", "key", "node"])

    return vectors.where(_whole(vector)).select(key, vector).mapInArrow(run, f"cell int, key {kind}, node int")


def _whole(vector: str):
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v))


def kymograph(spark, cell: Cell) -> DataFrame:
    """(node, feature, epoch, value): the weights of every node at each snapshot, epoch 0 before training."""
    return spark.createDataFrame([(int(i), int(j), int(e), float(v)) for e, w in cell.snapshots or [] for (i, j), v in np.ndenumerate(w)], "node int, feature int, epoch int, value double")


# --- layouts ---------------------------------------------------------------------------------------------------------

MEASURES = ("rnx_auc", "trustworthiness", "continuity", "dubious_fraction", "group_silhouette")


def layouts(t: DataFrame, key: str, vector: str, label: str | None, method: str, grid: list[dict], nulls: int = 20) -> DataFrame:
    """(cell, key, axis1, axis2, the measures, error): every layout of a grid, one task a cell; a cell that fails is one
    row without key. Rows with a null vector or null components are left out; more than LIMIT rows are laid out together where
    the method has such a way (LARGE), and raise otherwise."""
    m = registry.get(method)
    rows = t.where(_whole(vector)).select(F.col(key).alias("key"), F.col(vector).alias("v"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("g"))
    n = rows.count()
    if n > pr.LIMIT and method in LARGE:
        return _large_layouts(rows, method, [m.filled(n, g) for g in grid], nulls)
    if n > pr.LIMIT:
        raise ValueError(f"{n} rows; dense projections take {pr.LIMIT} at most")
    cells = [json.dumps(m.filled(n, g)) for g in grid]
    kind = t.schema[key].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = pa.schema([("cell", pa.int32()), ("key", arrow), ("axis1", pa.float64()), ("axis2", pa.float64()), *[(c, pa.float64()) for c in MEASURES], ("error", pa.string())])

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("key")
        cell, q = part["cell"][0].as_py(), {}
        try:
            x, named = np.array(part["v"].to_pylist(), float), part["g"].to_pylist()
            y = np.unique([str(g) for g in named], return_inverse=True)[1]
            groups = len({g for g in named if g is not None})
            if why := m.unusable(len(x), groups):
                raise ValueError(why)
            xy = np.asarray(m.run(x, y if groups > 1 else None, **json.loads(cells[cell])), float)
            if not np.isfinite(xy).all():
                raise ValueError("coordinates that are no numbers")
            found = pr.rank_quality(x, xy)
            q = {"rnx_auc": found["auc"], "trustworthiness": found["trustworthiness"], "continuity": found["continuity"], "dubious_fraction": float(pr.reliability(x, xy, nulls=nulls)[1].mean())}
            q["group_silhouette"] = scores.silhouette(xy, y) if groups > 1 else None
        except Exception as failed:
            return pa.Table.from_pylist([{"cell": cell, "error": f"{type(failed).__name__}: {failed}"}], schema)
        fixed = [pa.array([q[c]] * len(x), pa.float64()) for c in MEASURES]
        return pa.Table.from_arrays([part["cell"].cast(pa.int32()), part["key"].cast(arrow), pa.array(xy[:, 0]), pa.array(xy[:, 1]), *fixed, pa.nulls(len(x), pa.string())], schema=schema)

    spread = rows.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(len(cells) - 1))))
    measured = ", ".join(f"{c} double" for c in MEASURES)
    return spread.groupBy("cell").applyInArrow(run, f"cell int, key {kind}, axis1 double, axis2 double, {measured}, error string")


def _tsne(rows: DataFrame, cells: list[dict]) -> list[DataFrame]:
    """The layouts of the cells, those of as many steps together."""
    out: dict[int, DataFrame] = {}
    for steps in dict.fromkeys(c["steps"] for c in cells):
        at = [i for i, c in enumerate(cells) if c["steps"] == steps]
        every = pairs.tsne(rows, "row", "v", [float(cells[i]["perplexity"]) for i in at], steps).checkpoint()
        out |= {i: every.where(F.col("layout") == k) for k, i in enumerate(at)}
    return [out[i] for i in range(len(cells))]


def _isomap(rows: DataFrame, cells: list[dict]) -> list[DataFrame]:
    axis = lambda i: F.sum(F.when(F.col("axis") == i, F.col("coordinate")).otherwise(0.0)).alias(f"axis{i}")
    return [geodesic.isomap(rows, "row", "v", c["neighbours"]).groupBy("key").agg(axis(1), axis(2)) for c in cells]


#: Methods whose layouts of a scan go beyond LIMIT rows: of (row, v) and the cells' parameters (key, axis1, axis2) a cell.
LARGE = {"tsne": _tsne, "isomap": _isomap}


def _large_layouts(rows: DataFrame, method: str, cells: list[dict], nulls: int) -> DataFrame:
    """layouts() of (key, v, g) of any number, by pairs of blocks. key is unique."""
    packs, sizes = packed(rows, "key", "g", "v")
    begin = np.r_[0, np.cumsum(sizes)[:-1]].tolist()
    at = packs.select("block", F.posexplode(F.arrays_zip("keys", "g")).alias("pos", "s"))
    row = F.element_at(F.array(*map(F.lit, begin)), F.col("block") + 1) + F.col("pos")
    known = [r["g"] for r in rows.select(F.coalesce("g", F.lit("None")).alias("g")).distinct().orderBy("g").collect()]
    grouped = rows.where("g is not null").select("g").distinct().limit(2).count() > 1
    number = F.array_position(F.array(*map(F.lit, known)), F.coalesce("s.g", F.lit("None"))) - 1
    named = at.select(row.cast("long").alias("row"), F.col("s.keys").alias("key"), number.alias("number"))
    every = named.join(rows.select("key", "v"), "key").select("row", "key", "v", "number").checkpoint()
    out = None
    for i, layout in enumerate(LARGE[method](every.select("row", "v"), cells)):
        xy = every.join(layout.select(F.col("key").alias("row"), "axis1", "axis2").hint("merge"), "row").withColumn("xy", F.array("axis1", "axis2")).checkpoint()
        got = rk.layout_quality(xy, "row", "v", "xy", "number" if grouped else None, nulls)
        q = {"rnx_auc": got["auc"], "trustworthiness": got["trustworthiness"], "continuity": got["continuity"], "dubious_fraction": got["dubious"], "group_silhouette": got["silhouette"]}
        one = xy.select(F.lit(i).alias("cell"), "key", "axis1", "axis2", *[F.lit(q[c]).cast("double").alias(c) for c in MEASURES], F.lit(None).cast("string").alias("error"))
        out = one if out is None else out.unionByName(one)
    return out


def layout_scan(t: DataFrame, key: str, vector: str, label: str | None, method: str, chosen: dict[str, list] | None = None, criterion: str = "rnx_auc", tolerance: float = 0.02, nulls: int = 10) -> tuple[DataFrame, DataFrame]:
    """Scores of a method's grid and all its layouts. The grid is the given one, else the method's own."""
    n = t.where(_whole(vector)).count()
    m = registry.get(method)
    grid = m.grid(n, chosen)
    every = layouts(t, key, vector, label, method, grid, nulls).persist(StorageLevel.MEMORY_AND_DISK)
    seen = {r["cell"]: r.asDict() for r in every.groupBy("cell").agg(*[F.first(c, ignorenulls=True).alias(c) for c in (*MEASURES, "error")]).collect()}
    rows = [{**g, **{c: seen.get(i, {}).get(c) for c in (*MEASURES, "error")}} for i, g in enumerate(grid)]
    if criterion == "group_silhouette" and label is None:
        criterion = "rnx_auc"
    keys = list(grid[0])
    suggested = {k: v for k, v in m.filled(n).items() if k in keys}
    return table(t, judged(rows, keys, criterion, CRITERIA[criterion], tolerance, suggested=suggested), keys), every.where("error is null").drop("error", *MEASURES)


def table(t: DataFrame, rows: list[dict], keys: list[str]) -> DataFrame:
    """The judged cells as a table: the parameters as they are, the scores as doubles."""
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    of = {k: kinds[type(rows[0][k])] for k in keys} | {"cell": "int", "near": "boolean", "component": "int", "best": "boolean", "chosen": "boolean", "error": "string"}
    order = ["cell", *[c for c in rows[0] if c != "cell"]]
    return t.sparkSession.createDataFrame([tuple(r[c] for c in order) for r in rows], ", ".join(f"{c} {of.get(c, 'double')}" for c in order))
