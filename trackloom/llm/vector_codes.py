"""Compression of vectors to short codes: each part of a vector becomes the index of its nearest codebook entry.

A part position's entries stand in a vantage-point tree. A node holds one entry and splits the others by their distance
to it, with the least and greatest distance on either side. A batch of parts goes through the tree twice: straight down to
near entries, then by branch and bound through every node that may hold a nearer or equally near entry. Distances from
roots are integers rounded to the safe side, a node whose bound equals the best distance is visited, and what decides are
exact squared distances of integers, so codes, ties included, are those of a comparison with all entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configured, of_classes, schema, stored, trimming, turn

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Entries of a leaf, which are compared one after another.
LEAF = 4
#: Vectors that are coded together.
TOGETHER = 8192


@dataclass
class Node:
    """One entry, and the nodes of those that are nearer to it and those that are farther; or the entries of a leaf."""

    at: int = -1
    leaf: tuple[int, ...] = ()
    near: Node | None = None
    far: Node | None = None
    #: Of both sides: least distance to this entry, rounded down, and greatest, rounded up.
    low: tuple[int, int] = (0, 0)
    high: tuple[int, int] = (0, 0)


def root(squares: np.ndarray) -> np.ndarray:
    """Square roots of integers under 2**62, rounded down."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def root_up(squares: np.ndarray) -> np.ndarray:
    r = root(squares)
    return r + (r * r < squares)


def squares(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = points - entry
    return np.einsum("ij,ij->i", d, d)


def tree(entries: np.ndarray, members: np.ndarray | None = None) -> Node:
    """A vantage-point tree over rows of integers; members: the rows that it holds, all by default."""
    members = np.arange(len(entries)) if members is None else members
    if len(members) <= LEAF:
        return Node(leaf=tuple(members.tolist()))
    at, others = int(members[0]), members[1:]
    d = squares(entries[others], entries[at])
    order = np.argsort(d, kind="stable")
    half = len(order) // 2
    sides = [others[order[:half]], others[order[half:]]]
    reach = [np.sort(d)[:half], np.sort(d)[half:]]
    return Node(at, (), tree(entries, np.sort(sides[0])), tree(entries, np.sort(sides[1])), tuple(int(root(x[:1])[0]) for x in reach), tuple(int(root_up(x[-1:])[0]) for x in reach))


class Search:
    """Nearest entries of many points: their indices, lowest first on ties, and squared distances."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.top = entries, tree(entries)
        #: Distances computed so far.
        self.compared = 0

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.points = points
        self.best = np.full(len(points), np.iinfo(np.int64).max)
        self.index = np.full(len(points), len(self.entries))
        everyone = np.arange(len(points))
        self._descend(self.top, everyone)
        self._bound(self.top, everyone)
        return self.index, self.best

    def _compare(self, who: np.ndarray, entry: int) -> np.ndarray:
        self.compared += len(who)
        d = squares(self.points[who], self.entries[entry])
        best = self.best[who]
        better = (d < best) | ((d == best) & (entry < self.index[who]))
        self.best[who[better]], self.index[who[better]] = d[better], entry
        return d

    def _descend(self, node: Node, who: np.ndarray) -> None:
        """Each point takes the side in whose range its distance lies, so that it begins with a good bound."""
        if node.near is None or not len(who):
            for entry in node.leaf if len(who) else ():
                self._compare(who, entry)
            return
        d = root(self._compare(who, node.at))
        inside = d <= (node.high[0] + node.low[1]) // 2
        self._descend(node.near, who[inside])
        self._descend(node.far, who[~inside])

    def _bound(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.near is None:
            for entry in node.leaf:
                self._compare(who, entry)
            return
        d = self._compare(who, node.at)
        down, up = root(d), root_up(d)
        for side, low, high in ((node.near, node.low[0], node.high[0]), (node.far, node.low[1], node.high[1])):
            least = np.maximum(np.maximum(low - up, down - high), 0)
            self._bound(side, who[least * least <= self.best[who]])


def kept(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v array<double>) of the rows whose vector is not null and holds finite components only; v is scaled
    (and rounded down where it becomes a matrix)."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    # a product with a power of two is exact; matrix() rounds it down
    return rows.where(fine).select("vec_id", "label", F.transform(v, lambda x: x * SCALE).alias("v"))


def checked(vectors: DataFrame, parts: int = PARTS) -> int:
    """The length of all vectors, 0 if there are none. Raises if it varies, is no multiple of parts, or components are so
    large that squared distances would not fit 62 bits."""
    got = vectors.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")).first()
    if got["low"] is None:
        return 0
    if got["low"] != got["high"] or got["high"] % parts or not got["high"]:
        raise ValueError(f"vectors have {got['low']} to {got['high']} components; one length is asked for, in {parts} equal parts")
    if got["high"] * (2 * (got["most"] + 1)) ** 2 >= 2**62:
        raise ValueError("components are too large for exact distances in 64 bits")
    return got["high"]


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A column of lists of one length, as whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat).astype(np.int64).reshape(len(column), length)


def searches(books: np.ndarray) -> list[Search]:
    return [Search(book) for book in books]


def trained(vectors: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) after the rounds, from the vectors of the smallest vec_ids; among equal or null
    ids (null: last) the smaller vector comes first. Fewer rows make fewer entries.

    A round is one pass: a task returns counts and sums by part and entry, a table of fixed size.
    """
    # least first: orderBy with a limit keeps no more than so many rows a task
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.floor(np.array([r["v"] for r in first])).astype(np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2).copy()
    wide = books.shape[2]
    names = [f"s{i}" for i in range(wide)]
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            turn("vector_codes")
            find = searches(books)
            n, s = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for points, _ in cut(batches, length):
                for k, search in enumerate(find):
                    part = points[:, k * wide : (k + 1) * wide]
                    index, _ = search.nearest(part)
                    n[k] += np.bincount(index, minlength=len(n[k]))
                    np.add.at(s[k], index, part)
            there = n.ravel() > 0
            flat = s.reshape(-1, wide)[there]
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.flatnonzero(there), pa.int32()), "n": n.ravel()[there], **{c: flat[:, i] for i, c in enumerate(names)}})

        got = vectors.select("v").mapInArrow(trimming(sums), schema("at int, n long, " + ", ".join(f"{c} long" for c in names)))
        got = got.groupBy("at").agg(*(F.sum(c).alias(c) for c in ("n", *names))).collect()
        books = books.copy()
        for r in got:
            books[divmod(r["at"], books.shape[1])] = [r[c] // r["n"] for c in names]
    return books


def cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Slices of TOGETHER rows, and their vectors; the vectors are the last column."""
    for batch in batches:
        for k in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(k, TOGETHER)
            yield matrix(part.column(part.num_columns - 1), length), part


def encoded(vectors: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """(vec_id, label, code binary, error long) of every row: a code is a byte a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("vector_codes")
        find, wide = searches(books), books.shape[2]
        for points, part in cut(batches, length):
            codes, error = np.empty((len(points), len(find)), np.uint8), np.zeros(len(points), np.int64)
            for k, search in enumerate(find):
                index, d = search.nearest(points[:, k * wide : (k + 1) * wide])
                codes[:, k] = index
                error += d
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.mapInArrow(trimming(run), schema(f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long"))


def decoded(code: bytes, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for, in the scale of the input."""
    return np.concatenate([books[k, i] for k, i in enumerate(code)]) / SCALE


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of every kept row.

    Rows whose vector is null or holds null, NaN or infinite components are dropped; a null id or label is a value like
    any other. Rows that repeat count each. An empty table gives no rows; other columns are ignored. Vectors of several
    lengths, or of one that parts do not divide, raise ValueError. entries may be 256 at most.

    What is kept is coded once and stored; the errors of a label are summed before they meet its rows, and a label with
    very many rows goes to the tasks instead of its rows to one.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    vectors = kept(rows)
    length = checked(vectors, parts)
    if not length:
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = trained(vectors, length, parts, entries, rounds)
    coded = stored(encoded(vectors, books, length).select("vec_id", F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string"))).alias("of"), F.lower(F.hex("code")).alias("code"), "error"), "codes")
    totals = coded.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows_of")).withColumnRenamed("of", "whose")
    return of_classes(coded, totals, {"of": "whose"}, "rows_of").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector of the table embeddings."""
    return compressed(configured(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
