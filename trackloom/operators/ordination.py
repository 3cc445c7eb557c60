"""Principal coordinates, dispersion tests, permutation nulls and Shepard correlation over all pairs of rows.

Rows are packed into blocks, and a task has pairs of blocks: distances are computed where they are used and none is stored or
sent. Compute grows with the square of the rows by definition; what a pass returns grows with the rows at most.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .statistics import anova, block_rows, distances, permutation_p

#: Rows of a block; a pair of blocks makes BLOCK**2 distances at a time.
BLOCK = 500


def configured(spark: SparkSession) -> None:
    """Bounds the Arrow batches, as a row here holds a block, and names a folder for checkpoints where none is named: a local
    one, which only serves a session of one process."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not where and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="trackloom-"))


def packed(rows: DataFrame, key: str, group: str | None, vector: str, block: int = BLOCK) -> tuple[DataFrame, list[int]]:
    """((block, keys, g, x) checkpointed, rows of each block): rows by hash of key, in the order of key; g is the group as a
    string, x the vectors as doubles. Rows whose key or vector is null are left out; vectors have one length."""
    configured(rows.sparkSession)
    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), (F.col(group).cast("string") if group else F.lit("")).alias("g"), F.col(vector).cast("array<double>").alias("v"))
    n = max(1, -(-rows.count() // block))
    kind = rows.schema["key"].dataType

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        x = np.array(t["v"].to_pylist(), float)
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32()), "keys": pa.array([t["key"].to_pylist()]), "g": pa.array([t["g"].to_pylist()], pa.list_(pa.string())), "x": pa.array([x.tobytes()], pa.binary())})

    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("g", T.ArrayType(T.StringType())), T.StructField("x", T.BinaryType())])
    out = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")).groupBy("block").applyInArrow(pack, schema).checkpoint()
    sizes = {r["block"]: r["n"] for r in out.select("block", F.size("keys").alias("n")).collect()}
    return out, [sizes.get(b, 0) for b in range(n)]


def array(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, float).reshape(rows, -1)


def over_pairs(left: DataFrame, right: DataFrame, blocks: int, run: Callable, schema: str) -> DataFrame:
    """run over (i, left's columns, right's columns) of every pair of blocks; both have the column block."""
    a = left.withColumnRenamed("block", "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = right.select(*[F.col(c).alias("j" if c == "block" else f"{c}_j") for c in right.columns])
    return a.join(b.hint("merge"), "j").select("i", *[c for c in left.columns if c != "block"], *[c for c in b.columns if c != "j"]).mapInArrow(run, schema)


# --- principal coordinates -------------------------------------------------------------------------------------------


def summed(parts: DataFrame, by: str) -> DataFrame:
    """(by, w): sums of matrices of doubles of one size."""

    def add(t: pa.Table) -> pa.Table:
        w = np.sum([np.frombuffer(x.as_py(), float) for x in t["w"]], axis=0)
        return pa.table({by: t[by].slice(0, 1), "w": pa.array([w.tobytes()], pa.binary())})

    return parts.groupBy(by).applyInArrow(add, T.StructType([parts.schema[by], T.StructField("w", T.BinaryType())]))


class Krylov:
    """An orthonormal block Krylov basis of the doubly centred matrix that of_pairs gives of two blocks' vectors, in blocks of
    rows. Blocks are joined by sorting: a broadcast would bring the whole basis to the driver."""

    def __init__(self, rows: DataFrame, sizes: list[int], of_pairs: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, seed: int, near: Callable[[np.ndarray], np.ndarray] | None = None):
        """near: of a block's vectors, columns that are near the wanted ones; they take the place of as many random ones."""
        self.rows, self.sizes, self.of_pairs, self.n = rows, sizes, of_pairs, sum(sizes)
        one = 1 / np.sqrt(self.n)

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                w = []
                for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    w.append(np.random.default_rng([seed, k]).normal(size=(sizes[k], width)))
                    if near is not None:
                        close = near(array(x.as_py(), sizes[k]))[:, :width]
                        w[-1][:, : close.shape[1]] = close
                w = [v.tobytes() for v in w]
                yield pa.RecordBatch.from_pydict({"block": b.column(0), "q": pa.array([np.full(sizes[k], one).tobytes() for k in b.column(0).to_pylist()], pa.binary()), "w": pa.array(w, pa.binary())})

        #: The basis, its columns (the constant vector, which centres, is the first), and where its last block begins.
        self.basis, self.columns, self.last = None, 1, 1
        self.inner = np.zeros((0, 0))
        self._append(rows.select("block", *(["x"] if near is not None else [F.lit(b"").alias("x")])).mapInArrow(start, "block int, q binary, w binary"), width)

    def _products(self, joined: DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(basis' (w - basis c), its own square) over (q, w): one row a task."""
        sizes, columns = self.sizes, self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for k, q, w in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    q, w = array(q, sizes[k]), array(w, sizes[k])
                    w = w - q @ c
                    part = np.vstack([q, np.zeros((0, columns))]).T @ w, w.T @ w
                    total = part if total is None else (total[0] + part[0], total[1] + part[1])
            if total is not None:
                yield pa.RecordBatch.from_pydict({"k": pa.array([0], pa.int32()), "w": pa.array([np.concatenate([x.ravel() for x in total]).tobytes()], pa.binary())})

        flat = np.frombuffer(summed(joined.mapInArrow(run, "k int, w binary"), "k").first()["w"], float)
        wide = c.shape[1]
        return flat[: columns * wide].reshape(columns, wide), flat[columns * wide :].reshape(wide, wide)

    def _append(self, joined: DataFrame, wide: int) -> np.ndarray:
        """Makes w orthonormal to the basis (twice, against rounding) and adds it; the coefficients of w in the old and new
        columns. joined: (block, q, w), w with `wide` columns."""
        c, m = self._products(joined, np.zeros((self.columns, wide)))
        scale = np.trace(m)
        more, m = self._products(joined, c)
        c = c + more
        e, u = np.linalg.eigh((lambda s: (s + s.T) / 2)(m - more.T @ more))
        good = e > 1e-20 * max(scale, 1e-300)
        r, turn = np.sqrt(e[good])[:, None] * u[:, good].T, u[:, good] / np.sqrt(e[good])
        sizes = self.sizes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for k, q, w in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    q, w = array(q, sizes[k]), array(w, sizes[k])
                    out.append(np.hstack([q, (w - q @ c) @ turn]).tobytes())
                yield pa.RecordBatch.from_pydict({"block": b.column(0), "q": pa.array(out, pa.binary())})

        self.basis = joined.mapInArrow(run, "block int, q binary").checkpoint()
        self.last, self.columns = self.columns, self.columns + int(good.sum())
        return np.vstack([c, r])

    def newest(self) -> DataFrame:
        """(block, q): the basis' last block of columns."""
        sizes, last, now = self.sizes, self.last, self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = [np.ascontiguousarray(array(q, sizes[k])[:, last:now]).tobytes() for k, q in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                yield pa.RecordBatch.from_pydict({"block": b.column(0), "q": pa.array(q, pa.binary())})

        return self.basis.select("block", "q").mapInArrow(run, "block int, q binary")

    def product(self) -> DataFrame:
        """(block, w): the matrix times the basis' last block of columns."""
        sizes, of_pairs = self.sizes, self.of_pairs

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, ws = b.column(0).to_pylist(), []
                for i, x, y, q in zip(at, b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    rows = len(y) // (len(x) // sizes[i])
                    x, y, q, step = array(x, sizes[i]), array(y, rows), array(q, rows), max(16, (1 << 20) // rows)
                    ws.append(np.vstack([of_pairs(x[s : s + step], y) @ q for s in range(0, len(x), step)]).tobytes())
                yield pa.RecordBatch.from_pydict({"block": b.column(0), "w": pa.array(ws, pa.binary())})

        x = self.rows.select("block", "x")
        right = x.join(self.newest().hint("merge"), "block").select("block", "x", "q")
        return summed(over_pairs(x, right, len(sizes), run, "block int, w binary"), "block")

    def extend(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One pass over all pairs: eigenvalues and eigenvectors of the matrix within the basis as it was, and what each
        lacks to be one of the whole matrix."""
        last, now = self.last, self.columns
        w = self.product().checkpoint()
        got = self._append(self.basis.join(w.hint("merge"), "block").select("block", "q", "w"), now - last)
        inner = np.zeros((now - 1, now - 1))
        inner[: len(self.inner), : len(self.inner)] = self.inner
        inner[:, last - 1 :] = got[1:now]
        inner[last - 1 :, :] = inner[:, last - 1 :].T
        self.inner = (inner + inner.T) / 2
        value, vector = np.linalg.eigh(self.inner)
        return value, vector, np.linalg.norm(got[now:] @ vector[last - 1 :], axis=0)

    def vectors(self, vector: np.ndarray, names: list[tuple[int, bool, float]]) -> DataFrame:
        """(key, axis, imaginary, eigenvalue, coordinate) of the basis times vector."""
        sizes = self.sizes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, keys, q in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    y = array(q, sizes[k])[:, 1 : 1 + len(vector)] @ vector
                    for c, (axis, imaginary, value) in enumerate(names):
                        yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "axis": pa.array([axis] * len(keys), pa.int32()), "imaginary": [imaginary] * len(keys), "eigenvalue": [value] * len(keys), "coordinate": y[:, c]})

        kind = self.rows.schema["keys"].dataType.elementType.simpleString()
        return self.rows.select("block", "keys").join(self.basis.hint("merge"), "block").mapInArrow(run, f"key {kind}, axis int, imaginary boolean, eigenvalue double, coordinate double")


def pcoa(rows: DataFrame, key: str, vector: str, metric: str = "euclidean", axes: int = 5, tolerance: float = 1e-7, passes: int = 60, width: int = 40, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(key, axis, imaginary, eigenvalue, coordinate): the leading real axes and, of distances that are not Euclidean, the
    leading imaginary ones (negative eigenvalues), axes of each at most.

    Eigenpairs of -J D^2 J / 2 by a block Krylov basis: a pass multiplies the matrix, computed block by block, with the
    basis' last `width` columns. It ends when what the wanted pairs lack is under tolerance times the largest eigenvalue; raises
    where that takes more passes. Cosine distances of up to WIDE features need no pairs. Axes whose eigenvalue is zero within that are left out. An axis' sign is that in which
    its largest coefficient in the basis is positive. A table without two rows has no axes.
    """
    kind = rows.schema[key].dataType.simpleString()
    if metric == "cosine" and (wide := rows.agg(F.max(F.size(vector))).first()[0]) and wide <= WIDE:
        return _cosine_axes(rows, key, vector, axes, tolerance)
    rows, sizes = packed(rows, key, None, vector, block)
    return leading(rows, sizes, lambda x, y: -0.5 * distances(x, y, metric) ** 2, kind, axes, tolerance, passes, width, seed)


def kernel_axes(rows: DataFrame, key: str, vector: str, gamma: float | None = None, axes: int = 2, tolerance: float = 1e-7, passes: int = 60, width: int = 40, block: int | None = None, seed: int = 0) -> DataFrame:
    """(key, axis, imaginary, eigenvalue, coordinate): the leading axes of the centred kernel exp(-gamma d^2), gamma by
    default 1 / features, as projection.kernel_pca; a pass over all pairs a step, as `pcoa`."""
    kind = rows.schema[key].dataType.simpleString()
    rows = rows.where(F.col(vector).isNotNull())
    n, wide = rows.agg(F.count("*"), F.max(F.size(vector))).first()
    rows, sizes = packed(rows, key, None, vector, block or block_rows(n))
    g = gamma or 1 / max(wide or 1, 1)

    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        left, right = as_products(x, y)
        d = left @ right
        np.maximum(d, 0, out=d)
        d *= -g
        return np.exp(d, out=d)

    near = _kernel_start(rows, sizes, g, min(width // 2, n - 1)) if n > 2 and wide <= WIDE else None
    return leading(rows, sizes, kernel, kind, axes, tolerance, passes, width, seed, near=near)


def _kernel_start(rows: DataFrame, sizes: list[int], g: float, width: int) -> Callable[[np.ndarray], np.ndarray] | None:
    """Of vectors the leading axes of the kernel's series up to squares of products, exp(-g (x^2 + y^2)) (1 + 2g xy + (2g xy)^2 / 2),
    from moments of its features; a start that is near where g xy is small. None where the series has no axes."""

    def features(x: np.ndarray) -> np.ndarray:
        i, j = np.triu_indices(x.shape[1])
        return np.exp(-g * (x * x).sum(1))[:, None] * np.hstack([np.ones((len(x), 1)), np.sqrt(2 * g) * x, np.sqrt(2) * g * np.where(i == j, 1.0, np.sqrt(2.0)) * x[:, i] * x[:, j]])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, 0.0, 0.0
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = array(x.as_py(), sizes[k])
                for s in range(0, len(x), 1000):
                    p = features(x[s : s + 1000])
                    n, total, products = n + len(p), total + p.sum(0), products + p.T @ p
        if n:
            for s in range(0, len(total), 128):  # a few rows of the matrix at a time
                yield pa.RecordBatch.from_pydict({"at": pa.array([s], pa.int32()), "w": pa.array([np.c_[np.full(len(total), n)[s : s + 128], total[s : s + 128], products[s : s + 128]].tobytes()], pa.binary())})

    parts = sorted(summed(rows.select("block", "x").mapInArrow(moments, "at int, w binary"), "at").collect())
    flat = [np.frombuffer(r["w"], float) for r in parts]
    wide = int(np.sqrt(sum(map(len, flat)) + 1)) - 1  # (wide + 2) numbers in each of wide rows
    found = np.vstack([v.reshape(-1, wide + 2) for v in flat])
    n, mean = found[0, 0], found[:, 1] / found[0, 0]
    c = found[:, 2:] - n * np.outer(mean, mean)
    value, vector = np.linalg.eigh((c + c.T) / 2)
    good = np.argsort(-value)[:width]
    good = good[value[good] > 1e-9 * max(value[-1], 1e-300)]
    if not len(good) or not np.isfinite(value).all():
        return None
    turn = vector[:, good] / np.sqrt(value[good]) * np.sqrt(n)
    return lambda x: np.vstack([(features(x[s : s + 1000]) - mean) @ turn for s in range(0, len(x), 1000)] or [np.zeros((0, len(good)))])


def leading(rows: DataFrame, sizes: list[int], of_pairs: Callable | DataFrame | None, kind: str, axes: int, tolerance: float = 1e-7, passes: int = 60, width: int = 40, seed: int = 0, space: type[Krylov] = Krylov, signs: tuple[int, ...] = (1, -1), near: Callable | None = None) -> DataFrame:
    """The leading axes of each of the signs of eigenvalues; space's third argument is of_pairs; near: as Krylov takes it."""
    if sum(sizes) < 2:
        return rows.sparkSession.createDataFrame([], f"key {kind}, axis int, imaginary boolean, eigenvalue double, coordinate double")
    space = space(rows, sizes, of_pairs, min(max(axes + 5, width), sum(sizes) - 1), seed, *([near] if near else []))
    for _ in range(passes):
        value, vectors, lacks = space.extend()
        top = max(np.abs(value).max(), 1e-300)
        order = np.argsort(-np.abs(value), kind="stable")
        wanted = [i for s in signs for i in [i for i in order if s * value[i] > tolerance * top][:axes]]
        if space.last == space.columns or lacks[wanted].max(initial=0) <= tolerance * top and sum(value > 0) >= min(axes, len(value)):
            break
    else:
        raise RuntimeError(f"the axes lack {lacks[wanted].max():.2g} after {passes} passes")
    names = [(1 + i, False, float(value[w])) for i, w in enumerate(w for w in wanted if value[w] > 0)] + [(1 + i, True, float(value[w])) for i, w in enumerate(w for w in wanted if value[w] < 0)]
    v = vectors[:, wanted] * np.sqrt(np.abs(value[wanted]))
    return space.vectors(v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])]), names)


#: Features up to which cosine distances are laid out by moments: their products are 65 * 64 / 2 = 2,080 at 64.
WIDE = 64


def _cosine_axes(rows: DataFrame, key: str, vector: str, axes: int, tolerance: float) -> DataFrame:
    """`pcoa` of cosine distances in time linear in the rows.

    With unit vectors u, and e = 1 (0 with u = 0 for a vector without direction, which is at distance zero from all), the
    squared distance is ee' - 2uu' + (uu')^2, so -D^2/2 is P S P' with features P = (e, u, products of u's components) and
    signs S = (-1/2, 1, -1/2). For C = P'P of the centred features and R = C^(1/2), the eigenvalues are those of R S R, and
    an eigenvector w of it gives the coordinates P S R w / sqrt(|value|).
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    configured(spark)
    schema = f"key {kind}, axis int, imaginary boolean, eigenvalue double, coordinate double"
    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))

    def features(column: pa.Array) -> np.ndarray:
        x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
        size = np.sqrt((x * x).sum(1))
        fine = np.isfinite(size) & (size > 0)
        u = np.where(fine[:, None], x / np.where(fine, size, 1)[:, None], 0.0)
        i, j = np.triu_indices(u.shape[1])
        return np.hstack([fine[:, None].astype(float), u, u[:, i] * u[:, j] * np.where(i == j, 1.0, np.sqrt(2.0))])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, 0.0, 0.0
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                p = features(b.column(0).slice(s, 1000))
                n, total, products = n + len(p), total + p.sum(0), products + p.T @ p
        if n:
            for s in range(0, len(total), 128):  # a few rows of the matrix at a time
                yield pa.RecordBatch.from_pydict({"at": pa.array([s], pa.int32()), "w": pa.array([np.c_[np.full(len(total), n)[s : s + 128], total[s : s + 128], products[s : s + 128]].tobytes()], pa.binary())})

    parts = sorted(summed(rows.select("v").coalesce(16).mapInArrow(moments, "at int, w binary"), "at").collect())
    if not parts:
        return spark.createDataFrame([], schema)
    d = rows.agg(F.max(F.size("v"))).first()[0]
    wide = 1 + d + d * (d + 1) // 2
    found = np.vstack([np.frombuffer(r["w"], float).reshape(-1, wide + 2) for r in parts])
    n, mean, c = found[0, 0], found[:, 1] / found[0, 0], found[:, 2:]
    if n < 2:
        return spark.createDataFrame([], schema)
    c = c - n * np.outer(mean, mean)
    sign = np.r_[-0.5, np.ones(d), np.full(wide - d - 1, -0.5)]
    value, vector_ = np.linalg.eigh((c + c.T) / 2)
    root = (vector_ * np.sqrt(np.maximum(value, 0))) @ vector_.T
    value, w = np.linalg.eigh(root * sign @ root)
    top = max(np.abs(value).max(), 1e-300)
    order = np.argsort(-np.abs(value), kind="stable")
    floor = max(tolerance, 1e-9) * top
    real, imaginary = ([i for i in order if s * value[i] > floor][:axes] for s in (1, -1))
    names = [(1 + i, False, float(value[k])) for i, k in enumerate(real)] + [(1 + i, True, float(value[k])) for i, k in enumerate(imaginary)]
    if not names:
        return spark.createDataFrame([], schema)
    turn = sign[:, None] * (root @ w[:, real + imaginary]) / np.sqrt(np.abs(value[real + imaginary]))
    turn = turn * np.where(turn[np.abs(turn).argmax(0), np.arange(turn.shape[1])] < 0, -1.0, 1.0)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                keys = b.column(0).slice(s, 1000)
                y = (features(b.column(1).slice(s, 1000)) - mean) @ turn
                for c, (axis, imaginary, of) in enumerate(names):
                    yield pa.RecordBatch.from_pydict({"key": keys, "axis": pa.array([axis] * len(keys), pa.int32()), "imaginary": [imaginary] * len(keys), "eigenvalue": [of] * len(keys), "coordinate": y[:, c]})

    return rows.mapInArrow(placed, schema)


# --- dispersion ------------------------------------------------------------------------------------------------------


def dispersions(rows: DataFrame, key: str, group: str, vector: str, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """(key, g, dist): distance of each row to its group's centroid in the space of all principal coordinates, imaginary
    axes subtracted, as squared distances within groups alone give it; under zero it is zero.

    A null group is a group of its own, ''. Cosine and correlation distances are products of unit vectors, whose squared sums
    follow from the groups' moments, so those take time in rows; the others compare all pairs.
    """
    if metric in ("cosine", "correlation"):
        return _to_centroids(_unit_sums(rows, key, group, vector, metric))
    rows, sizes = packed(rows, key, group, vector, block)
    kind = rows.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, g, x, h, y in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                d2 = distances(array(x, len(g)), array(y, len(h)), metric) ** 2
                own = np.array([c or "" for c in g], object)[:, None] == np.array([c or "" for c in h], object)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "g": [c or "" for c in g], "s": (d2 * own).sum(1)})

    x = rows.select("block", "keys", "g", "x")
    one = over_pairs(x, rows.select("block", "g", "x"), len(sizes), run, f"key {kind}, g string, s double").groupBy("key", "g").agg(F.sum("s").alias("s")).checkpoint()
    return _to_centroids(one)


def _to_centroids(one: DataFrame) -> DataFrame:
    """(key, g, dist) of the sums s of squared distances to the own group's rows."""
    whole = one.groupBy(F.col("g").alias("og")).agg(F.sum("s").alias("t"), F.count("*").alias("n"))
    square = F.col("s") / F.col("n") - F.col("t") / (2 * F.col("n") * F.col("n"))
    return one.join(F.broadcast(whole), F.col("g") == F.col("og")).select("key", "g", F.sqrt(F.greatest(square, F.lit(0.0))).alias("dist"))


def _unit_sums(rows: DataFrame, key: str, group: str, vector: str, metric: str) -> DataFrame:
    """(key, g, s): sum of the squared cosine or correlation distances to all rows of the own group. With the mean m and the
    sums of products S of the n unit vectors of a group it is n (1 - um)^2 + uSu. A vector without direction is at distance
    zero from all, as in `distances`."""
    from .linear import moments

    configured(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), F.col(vector).cast("array<double>").alias("v"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(2).to_pylist(), float)
                x = x - x.mean(1, keepdims=True) if metric == "correlation" else x
                with np.errstate(invalid="ignore", divide="ignore"):
                    x = x / np.sqrt((x * x).sum(1))[:, None]
                u = [v if fine else None for v, fine in zip(x.tolist(), np.isfinite(x).all(1), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(u, pa.list_(pa.float64()))], ["key", "g", "u"])

    units = rows.mapInArrow(unit, f"key {kind}, g string, u array<double>")
    of = {g: (m.n, m.mean, m.s) for g, m in moments(units, "u", "g").items()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = []
            for g, u in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n, mean, products = of.get(g, (0, 0.0, 0.0))
                s.append(0.0 if u is None else float(n * (1 - np.dot(u, mean)) ** 2 + np.dot(u, np.dot(products, u))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], ["key", "g", "s"])

    return units.mapInArrow(sums, f"key {kind}, g string, s double").checkpoint()


def permdisp(rows: DataFrame, key: str, group: str, vector: str, metric: str = "euclidean", permutations: int = 999, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """One row: n, groups, F, p and permutations: do the groups spread alike? Labels are dealt anew over all distances."""
    z = dispersions(rows, key, group, vector, metric, block).checkpoint()
    seen = anova(z.select("g", F.lit("dist").alias("feature"), F.col("dist").alias("v"))).first()
    if seen is None:
        return z.sparkSession.createDataFrame([], "n long, groups long, F double, p double, permutations int")
    null = permuted_F(z.select("key", "g", F.array("dist").alias("v")), "key", "g", "v", permutations, seed, block)
    hits = null.where(F.col("pseudo_F") >= (seen["anova_F"] or 0.0) * (1 - 1e-12)).count()
    return z.sparkSession.createDataFrame([(seen["n"], seen["groups"], seen["anova_F"], permutation_p(hits, permutations), permutations)], "n long, groups long, F double, p double, permutations int")


# --- permutations ----------------------------------------------------------------------------------------------------


def dealt(sizes: np.ndarray, counts: np.ndarray, block: int, seed: int) -> np.ndarray:
    """How many of each label fall to one block when labels of these counts are dealt at random over blocks of these sizes.
    Every block finds its own share: halves of the blocks share by a hypergeometric draw that the half's number seeds."""
    lo, hi, node, ends = 0, len(sizes), 1, np.r_[0, np.cumsum(sizes)]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, node]).multivariate_hypergeometric(counts, int(ends[mid] - ends[lo]), method="marginals")
        if block < mid:
            hi, node, counts = mid, 2 * node, left
        else:
            lo, node, counts = mid, 2 * node + 1, counts - left
    return counts


def permuted_F(rows: DataFrame, key: str, group: str, vector: str, permutations: int = 999, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(seed, pseudo_F, R2): of each permutation of the labels over all rows, Euclidean pseudo F and R2.

    One pass for all permutations: a block deals its share of the labels over its rows and returns the groups' sums, whose
    totals give the statistic. A draw is a uniform permutation; it depends on seed, keys and block size alone. Under 1e9 rows.
    """
    rows, sizes = packed(rows, key, group, vector, block)
    counts = rows.select(F.explode("g").alias("g")).groupBy("g").agg(F.count("*").alias("n")).orderBy("g").collect()
    n, parts = np.array([r["n"] for r in counts], np.int64), np.array(sizes)
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = array(x, sizes[k])
                total = np.zeros((permutations, len(n) * x.shape[1] + 1)) if total is None else total
                total[:, -1] += (x * x).sum()
                for s in range(permutations):
                    at = np.random.default_rng([seed + s, 0, k]).permutation(np.repeat(np.arange(len(n)), dealt(parts, n, k, seed + s)))
                    total[s, :-1] += (np.eye(len(n))[at].T @ x).ravel()
        if total is not None:
            yield pa.RecordBatch.from_pydict({"seed": pa.array(range(seed, seed + permutations), pa.int64()), "w": pa.array([t.tobytes() for t in total], pa.binary())})

    def statistic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, r2 = [], []
            for w in b.column(1).to_pylist():
                flat = np.frombuffer(w, float)
                s, q = flat[:-1].reshape(len(n), -1), flat[-1]
                between = ((s * s).sum(1) / n).sum() - (s.sum(0) ** 2).sum() / n.sum()
                total = q - (s.sum(0) ** 2).sum() / n.sum()
                within = total - between
                f.append(between / (len(n) - 1) / (within / (n.sum() - len(n))) if within > 0 and len(n) > 1 and n.sum() > len(n) else None)
                r2.append(between / total if total > 0 else None)
            yield pa.RecordBatch.from_pydict({"seed": b.column(0), "pseudo_F": pa.array(f, pa.float64()), "R2": pa.array(r2, pa.float64())})

    if not len(n):
        return spark.createDataFrame([], "seed long, pseudo_F double, R2 double")
    return summed(rows.select("block", "x").mapInArrow(run, "seed long, w binary"), "seed").mapInArrow(statistic, "seed long, pseudo_F double, R2 double")


# --- Shepard ---------------------------------------------------------------------------------------------------------


def as_products(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose product holds the squared distances of a's rows from b's."""
    return np.c_[-2 * a, (a * a).sum(1), np.ones(len(a))], np.c_[b, np.ones(len(b)), (b * b).sum(1)].T.copy()


def shepard(rows: DataFrame, key: str, vector: str, layout: str, bins: int = 1 << 16, block: int | None = None) -> DataFrame:
    """One row, pairs and spearman: rank correlation of the rows' distances in vector and in layout, over all pairs.

    Two passes: one counts distances by bins of equal width, which gives each bin its mean rank; one sums products of ranks.
    Distances of one bin count as ties. Null for under two pairs or where all distances of a side are tied.
    """
    configured(rows.sparkSession)
    # read several times, and a layout may be costly to make
    both = rows.select(F.col(key).alias("key"), F.concat(F.col(vector).cast("array<double>"), F.col(layout).cast("array<double>")).alias("v"), F.size(vector).alias("wide")).checkpoint()
    wide = both.agg(F.max("wide")).first()[0]
    packs, sizes = packed(both, "key", None, "v", block or block_rows(both.count()))
    spark = packs.sparkSession

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = array(x, len(g))
                yield pa.RecordBatch.from_pydict({f"{s}{c}": pa.array([float(f(v[:, c]))]) for c in range(v.shape[1]) for s, f in (("a", np.min), ("b", np.max))})

    if sum(sizes) < 2:
        return spark.createDataFrame([(0, None)], "pairs long, spearman double")
    columns = both.agg(F.max(F.size("v"))).first()[0]
    names = [f"{s}{c}" for c in range(columns) for s in "ab"]
    got = packs.select("g", "x").mapInArrow(reach, ", ".join(f"{c} double" for c in names)).agg(*[(F.min if c[0] == "a" else F.max)(c).alias(c) for c in names]).first()
    span = [float(np.sqrt(sum((got[f"b{c}"] - got[f"a{c}"]) ** 2 for c in part))) or 1.0 for part in (range(wide), range(wide, columns))]

    def pairs(b: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        """Bins of the pairs, some rows' at a time; of rows of one block each pair once."""
        for i, x, j, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            x, y = array(x, sizes[i]), array(y, sizes[j])
            parts = [(*as_products(x[:, c], y[:, c]), (bins - 1) / s) for c, s in zip((slice(0, wide), slice(wide, None)), span, strict=True)]
            step = max(16, (1 << 17) // len(y))
            d, found = np.empty((min(step, len(x)), len(y))), [np.empty((min(step, len(x)), len(y)), np.int64) for _ in parts]
            for s in range(0, len(x), step):
                m = len(x[s : s + step])
                for (left, right, scale), at in zip(parts, found, strict=True):
                    np.matmul(left[s : s + step], right, out=d[:m])
                    np.maximum(d[:m], 0, out=d[:m])
                    np.sqrt(d[:m], out=d[:m])
                    np.multiply(d[:m], scale, out=at[:m], casting="unsafe")  # a distance is the span at most
                pick = slice(None) if i != j else np.arange(len(y)) > s + np.arange(m)[:, None]
                yield [at[:m][pick].ravel() for at in found]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, bins), np.int64)
        for b in batches:
            for found in pairs(b):
                for k in (0, 1):
                    n[k] += np.bincount(np.minimum(found[k], bins - 1, out=found[k]), minlength=bins)
        at = np.flatnonzero(n.ravel())
        yield pa.RecordBatch.from_pydict({"at": at, "n": n.ravel()[at]})

    left = packs.select(F.col("block").alias("i"), "x").withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(len(sizes) - 1))))  # a pair of blocks once
    met = left.join(packs.select(F.col("block").alias("j"), F.col("x").alias("y")).hint("merge"), "j").select("i", "x", "j", "y")
    n = np.zeros(2 * bins, np.int64)
    for r in met.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        n[r["at"]] = r["n"]
    n = n.reshape(2, bins)
    total = int(n[0].sum())
    ranks = np.cumsum(n, 1) - (n - 1) / 2 - (total + 1) / 2  # about their mean

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = 0.0
        for b in batches:
            for found in pairs(b):
                s += float(ranks[0].take(found[0], mode="clip") @ ranks[1].take(found[1], mode="clip"))
        yield pa.RecordBatch.from_pydict({"s": [s]})

    s = met.mapInArrow(products, "s double").agg(F.sum("s")).first()[0]
    norm = float(np.sqrt((n[0] * ranks[0] ** 2).sum() * (n[1] * ranks[1] ** 2).sum()))
    return spark.createDataFrame([(total, s / norm if norm > 0 else None)], "pairs long, spearman double")
