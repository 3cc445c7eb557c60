"""Packing documents into windows by non-negative least squares.

Documents are cut into pieces of at most a window. Pieces are binned by length in units; a strategy is a combination of
few bins that fills a window: up to three pieces, or one length repeated and one other. Non-negative least squares finds
how often to repeat each strategy so that together they use up the histogram of bins. The counts are rounded down to
what the histogram holds; what is left is packed greedily: first in combinations that fill a window without a cut, then
end to end, cut at the windows' borders.

Only the histogram reaches the driver; its size is that of the window. A piece's place follows from its rank in its bin.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, parallelism, schema, stored, trimming
from .encoding import default_path, tokens, width

WINDOW, UNIT = 4096, 16
#: A greedy combination must fill a window but for so many units, else its pieces are cut.
SLACK = 4

Strategy = tuple[tuple[int, int], ...]


def strategies(units: int) -> list[Strategy]:
    """(bin, times) of the shallow combinations that sum to units."""
    found = set()
    for a in range(1, units + 1):
        for b in range(1, a + 1):
            if 1 <= units - a - b <= b:
                found.add(tuple(sorted(Counter((a, b, units - a - b)).items())))
        for times in range(1, units // a + 1):
            rest = units - times * a
            found.add(tuple(sorted((Counter({a: times}) + Counter([rest] if rest else [])).items())))
    return sorted(found)


def nonnegative_least_squares(a: np.ndarray, h: np.ndarray, most: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - h|, by active sets; only the active columns' normal equations are formed."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    least = 1e-9 * max(1.0, float(np.abs(a.T @ h).max(initial=0)))
    for _ in range(most or 3 * a.shape[0]):
        slope = a.T @ (h - a @ x)
        slope[passive] = -np.inf
        k = int(slope.argmax())
        if slope[k] <= least:
            break
        passive[k] = True
        while True:
            at = np.flatnonzero(passive)
            part = a[:, at]
            try:
                z = np.linalg.solve(part.T @ part, part.T @ h)
            except np.linalg.LinAlgError:  # columns that depend on each other
                z = np.linalg.lstsq(part, h, rcond=1e-12)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            old = x[at]
            step = float(np.min(old[low] / np.maximum(old[low] - z[low], 1e-300)))
            x[at] = np.maximum(old + step * (z - old), 0)
            passive[at[(x[at] <= 1e-12) & low]] = False
            if not passive.any():
                break
    return x


def planned(histogram: np.ndarray) -> list[tuple[Strategy, int]]:
    """Strategies with their repeat counts; together they use no bin more often than the histogram (index: bin) has it."""
    units = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[Strategy, int]] = []

    def use(s: Strategy, times: int) -> None:
        for b, m in s:
            left[b] -= m * times
        out.append((s, times))

    fitting = [s for s in strategies(units) if all(left[b] >= m for b, m in s)]
    if fitting:
        a = np.zeros((units + 1, len(fitting)))
        for k, s in enumerate(fitting):
            for b, m in s:
                a[b, k] = m
        scale = float(left.max())
        x = nonnegative_least_squares(a, left / scale) * scale
        for k in np.argsort(-x, kind="stable").tolist():
            times = min(int(x[k] + 1e-6), *(int(left[b]) // m for b, m in fitting[k]))
            if times > 0:
                use(fitting[k], times)
    skipped: set[int] = set()
    while bins := [b for b in range(units, 0, -1) if left[b] and b not in skipped]:
        room, got = units, Counter()
        for b in bins:
            if take := min(room // b, int(left[b])):
                got[b] += take
                room -= take * b
        if room > SLACK:
            skipped.add(bins[0])
            continue
        use(s := tuple(sorted(got.items())), min(int(left[b]) // m for b, m in s))
    return out


class Places:
    """Sequence and slot of a piece, by its bin and its rank there."""

    def __init__(self, plan: list[tuple[Strategy, int]], units: int):
        by: list[list[tuple[int, int, int, int]]] = [[] for _ in range(units + 1)]  # first rank, times, slot, sequence
        used, self.sequences = [0] * (units + 1), 0
        for s, times in plan:
            slot = 0
            for b, m in s:
                by[b].append((used[b], m, slot, self.sequences))
                used[b] += m * times
                slot += m
            self.sequences += times
        self.by, self.used = [np.array(x, np.int64).reshape(-1, 4) for x in by], np.array(used)

    def of(self, bins: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """-1 and -1 for what the plan leaves."""
        sequence, slot = np.full(len(bins), -1, np.int64), np.full(len(bins), -1, np.int64)
        for b in np.unique(bins).tolist():
            at = np.flatnonzero((bins == b) & (ranks < self.used[b]))
            if len(at):
                x = self.by[b][np.searchsorted(self.by[b][:, 0], ranks[at], "right") - 1]
                r = ranks[at] - x[:, 0]
                sequence[at], slot[at] = x[:, 3] + r // x[:, 1], x[:, 2] + r % x[:, 1]
        return sequence, slot


def placed(sizes: DataFrame, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """(k, start, length, sequence_id, offset) of every piece of the rows (k long, n_tokens long) of sizes.

    Rows without tokens have no piece. The pieces of a sequence lie gapless from offset 0; sequences count from 0. Equal
    lengths are told apart by k. Ranks in a bin are counted in parts, so a bin that holds most pieces is no hot group.
    """
    spark, units = sizes.sparkSession, window // unit
    parts = parallelism(spark)
    pieces = sizes.where("n_tokens > 0").select("k", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_tokens - 1) div {window}"))).alias("p"))
    pieces = pieces.select("k", (F.col("p") * window).alias("start"), F.least(F.lit(window), F.col("n_tokens") - F.col("p") * window).alias("length"))
    pieces = pieces.withColumn("bin", F.expr(f"cast((length + {unit - 1}) div {unit} as int)")).withColumn("part", F.pmod(F.xxhash64("k", "start"), F.lit(parts)).cast("int"))
    counts = pieces.groupBy("bin", "part").agg(F.count("*").alias("n"))
    histogram = np.zeros(units + 1, np.int64)
    for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        histogram[r["bin"]] = r["n"]
    places = Places(planned(histogram), units)
    before = counts.select(F.col("bin").alias("bin_"), F.col("part").alias("part_"), F.coalesce(F.sum("n").over(Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("bin", "part").orderBy("k", "start")))
    ranked = ranked.join(before, (F.col("bin") == F.col("bin_")) & (F.col("part") == F.col("part_"))).select("k", "start", "length", "bin", (F.col("rank") - 1 + F.col("before")).cast("long").alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, slot = places.of(batch.column(3).to_numpy(), batch.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(slot)], [*batch.schema.names, "sequence_id", "slot"])

    where = stored(ranked.mapInArrow(trimming(run), schema("k long, start long, length long, bin int, rank long, sequence_id long, slot long")), "pieces")
    order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    fitted = where.where("sequence_id >= 0").select("k", "start", "length", "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))
    rest = where.where("sequence_id < 0").withColumn("group", F.expr("rank div 65536"))
    groups = rest.groupBy("bin", "group").agg(F.sum("length").alias("n"))
    base = groups.select(F.col("bin").alias("bin_"), F.col("group").alias("group_"), F.coalesce(F.sum("n").over(Window.orderBy(F.desc("bin"), "group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rest = rest.withColumn("own", F.sum("length").over(Window.partitionBy("bin", "group").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    rest = rest.join(base, (F.col("bin") == F.col("bin_")) & (F.col("group") == F.col("group_"))).withColumn("c", F.col("own") + F.col("base"))
    rest = rest.withColumn("w", F.explode(F.expr(f"sequence(c div {window}, (c + length - 1) div {window})")))
    begin, end = F.greatest("c", F.col("w") * window), F.least(F.col("c") + F.col("length"), (F.col("w") + 1) * window)
    cut = rest.select("k", (F.col("start") + begin - F.col("c")).alias("start"), (end - begin).alias("length"), (F.col("w") + places.sequences).alias("sequence_id"), (begin - F.col("w") * window).alias("offset"))
    return fitted.unionByName(cut)


def packed(docs: DataFrame, path: str | None = None, end: int | None = 2, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset of every
    piece of every row of docs.

    Text null is empty and gives one piece with the end id alone. Rows that repeat are packed each; doc_id may be null or
    repeat; an empty table gives no rows; other columns are ignored. A sequence is padded to the window by its reader.
    """
    path = path or default_path()
    dtype = width(path)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = stored(tokens(docs, path, end).withColumn("k", F.monotonically_increasing_id()), "ids", "zstd")
    of = placed(coded.select("k", "n_tokens"), window, unit).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for d, n, data, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(data, dtype).astype("<u4")
                for p in pieces:
                    for c, v in (p | {"doc_id": d, "doc_tokens": n, "ids": ids[p["start"] : p["start"] + p["length"]].tobytes()}).items():
                        rows[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in rows.items()], list(rows))

    joined = coded.join(of.withColumnRenamed("k", "of_k"), F.col("k") == F.col("of_k")).select("doc_id", "n_tokens", "ids", "pieces")
    return joined.mapInArrow(trimming(run), schema("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and checksum of every piece of the documents."""
    return digests(packed(documents(spark, sf_dir)))
