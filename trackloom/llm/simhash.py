"""Near-duplicates by SimHash fingerprints that differ in few bits.

A fingerprint's segment-popcount embedding is the vector of its 32 segments' bit counts (segments of two bits, so it fits
in a long as 32 fields of two bits). The Manhattan distance of two vectors never exceeds their fingerprints' Hamming
distance. The range join under that bound uses a grid: the 32 dimensions are dealt into six groups; vectors within
distance 3 differ in three groups at most, so they agree in three whole groups, and each of the 20 ways to choose three
groups gives a grid whose cells hold the vectors that agree there. Candidates of a cell pass the Manhattan bound, then
the exact Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, of_classes, parallelism, put, schema, stored, texts_of, trimming, turn
from .components import Forest, components

SEED, SHINGLE, BITS = 42, 3, 3
_FIELDS = 0x5555555555555555
_TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _masks(groups: int, together: int) -> list[int]:
    """Of each choice of `together` of `groups` groups of the 32 segments: the bits of their fields."""
    part = [sum(3 << 2 * s for s in range(g, 32, groups)) for g in range(groups)]
    return [sum(c) for c in combinations(part, together)]


MASKS = _masks(2 * BITS, BITS)


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """Unsigned 64-bit fingerprints; bit b is set if it is in over half of the shingles' hashes."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= SHINGLE:
            hashes.append(digest(joined, SEED))
            counts[k] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-SHINGLE] + 1).tolist()]
        hashes += [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
        counts[k] = len(starts)
    h = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    row = np.repeat(np.arange(len(texts)) << 8, counts)
    out = np.zeros(len(texts), np.uint64)
    for byte in range(8):
        votes = np.bincount(row + h[:, byte], minlength=len(texts) << 8).reshape(-1, 256) @ _TABLE
        bits = (2 * votes > counts[:, None]).astype(np.uint64)
        out |= (bits << np.arange(8, dtype=np.uint64)).sum(1, dtype=np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row of docs. Text null is empty; the fingerprint of no words is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("simhash")
        for batch in batches:
            yield put(batch, ["doc_id"], fp=pa.array(fingerprints_of(texts_of(batch.column(1))).view(np.int64)))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(trimming(run), schema("doc_id long, fp long"))


def embedded(fp: Column) -> Column:
    """The 32 counts as fields of two bits."""
    low, high = fp.bitwiseAND(F.lit(_FIELDS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_FIELDS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def _counts(x: np.ndarray) -> np.ndarray:
    m = np.uint64(_FIELDS)
    return (x & m) + (x >> np.uint64(1) & m)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs differ in few bits: the Manhattan distance of their counts first, then exactly."""
    a, b = np.broadcast_arrays(a, b)
    ca, cb = _counts(a), _counts(b)
    low, one = np.uint64(_FIELDS), np.uint64(1)
    # fields of 0, 1 or 2: those that differ by one have an odd difference in the low bit, by two in the high bit alone
    differ = ca ^ cb
    odd = differ & low
    ok = np.bitwise_count(odd) + 2 * np.bitwise_count(differ >> one & low & ~odd) <= BITS
    ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= BITS
    return ok


def tree_of(x: np.ndarray) -> np.ndarray:
    """Pairs of positions (k, 2) that span the components of the links among distinct fingerprints."""
    forest = Forest(len(x))
    out = [_tree(x, np.arange(len(x)), forest, _masks_of_bits(), True)]
    return np.concatenate(out)


def _masks_of_bits() -> list[int]:
    part = [sum(1 << b for b in range(g, 64, 2 * BITS)) for g in range(2 * BITS)]
    return [sum(c) for c in combinations(part, BITS)]


def _tree(x: np.ndarray, at: np.ndarray, forest: Forest, masks: list[int], split: bool) -> np.ndarray:
    found = [np.zeros((0, 2), np.int64)]
    if len(at) > 2048 and split:  # the same argument once more, on single bits
        for mask in masks:
            key = x[at] & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            ends = np.flatnonzero(np.r_[key[order][1:] != key[order][:-1], True]) + 1
            for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                if b - a > 1:
                    found.append(_tree(x, at[order[a:b]], forest, masks, False))
        return np.concatenate(found)
    for i in range(0, len(at), 256):
        rows = at[i : i + 256]
        roots = {forest.root(r) for r in at[i:].tolist()}
        if len(roots) == 1:
            break  # the rest is connected already
        for j in range(i, len(at), 4096):
            columns = at[j : j + 4096]
            p, q = np.nonzero(_near(x[rows][:, None], x[columns][None]))
            found.append(forest.join(np.stack([rows[p], columns[q]], 1)))
    return np.concatenate(found)


def links(classes: DataFrame, small: int = 32) -> DataFrame:
    """(a, b): links that connect what links of at most three bits connect, among the distinct fingerprints (fp).

    A cell's members meet in one task, in order; of each cell only a spanning forest is passed on, never all pairs.
    """
    n = parallelism(classes.sparkSession)
    counts = embedded(F.col("fp"))
    cells = classes.select("fp", F.posexplode(F.array([counts.bitwiseAND(F.lit(_signed(m))) for m in MASKS])).alias("grid", "cell"))
    cells = cells.repartition(n, "grid", "cell").sortWithinPartitions("grid", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("simhash")
        rest = np.zeros((3, 0), np.int64)
        for batch in _ending(batches):
            new = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]) if batch is not None else np.zeros((3, 0), np.int64)
            rows = np.concatenate([rest, new], 1)
            edge = np.flatnonzero((rows[1:, 1:] != rows[1:, :-1]).any(0)) + 1
            cut = rows.shape[1] if batch is None else int(edge[-1]) if len(edge) else 0
            rest = rows[:, cut:]
            starts = np.r_[0, edge[edge < cut]] if cut else np.zeros(0, int)
            pairs = _cells(rows[0, :cut].view(np.uint64), starts, np.r_[starts[1:], cut].astype(int), small)
            if len(pairs):
                yield pa.RecordBatch.from_pydict({"a": rows[0][pairs[:, 0]], "b": rows[0][pairs[:, 1]]})

    return cells.select("fp", "grid", "cell").mapInArrow(trimming(run), schema("a long, b long"))


def _ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cells(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, small: int) -> np.ndarray:
    size = ends - starts
    forest, found = Forest(len(x)), [np.zeros((0, 2), np.int64)]
    for a, b in zip(starts[size > small].tolist(), ends[size > small].tolist(), strict=True):
        found.append(_tree(x, np.arange(a, b), forest, _masks_of_bits(), True))
    few = (size > 1) & (size <= small)
    end_of = np.repeat(np.where(few, ends, 0), size)
    if few.any():
        at = np.arange(len(x))
        for lag in range(1, int(size[few].max())):
            i = at[at + lag < end_of]
            found.append(forest.join((p := np.stack([i, i + lag], 1))[_near(x[p[:, 0]], x[p[:, 1]])]))
    return np.concatenate(found)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp long, component_id of every row of docs.

    component_id is the smallest doc_id reachable by links of at most three differing bits, the row's own included. Equal
    fingerprints count once in the search (copies are never paired); rows that repeat get the same component. Text null
    is empty; texts without words share fingerprint zero. A null doc_id takes part but is never a component_id; where a
    component has no other, it is null. An empty table gives no rows; other columns are ignored.
    """
    fps = stored(fingerprints(docs), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    roots = components(links(classes.select("fp")))
    linked = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("first"))
    of = classes.join(roots.join(least, "root").select("node", "first"), F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of_fp"), F.coalesce("first", "least").alias("component_id"), "n")
    return of_classes(fps, stored(of, "classes"), {"fp": "of_fp"}).select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
