"""Token ids as binary files, coded by a static range asymmetric numeral system.

One frequency table, from the counts of all documents, is shared by all blocks. A block holds whole consecutive
documents and can be read alone. Its ids are coded in segments; each has LANES interleaved coders whose states stand at
its beginning, a checkpoint from which the segment can be decoded without the others. All segments of a batch are coded
together, a numpy step at a time. A block ends with checksums of its ids and of its bytes.

A set of files is a folder of Parquet files with rows (part, first, block): the block's bytes, by the part of the corpus
and the number of ids before it, and of one row with part -1, the table. Parquet is the container only, so that any store
that Spark reads and writes will do.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, parallelism, schema, shared_dir, stored, trimming
from .encoding import default_path, tokens, width

MAGIC, LANES, STEPS = b"RANS1\0\0\0", 32, 512
SEGMENT = LANES * STEPS
#: Ids of a block, and ids coded together by a task.
BLOCK, TOGETHER = 8 * SEGMENT, 128 * SEGMENT
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_HEAD = struct.Struct("<8sIIIQQII")


class Table:
    """Frequencies that sum to 2**bits; every counted symbol has at least one."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.cum = np.cumsum(self.freq) - self.freq
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    @classmethod
    def of_counts(cls, counts: np.ndarray, bits: int = 20) -> Table:
        """counts: of each symbol from 0; a table of no symbols codes nothing."""
        present = int(np.count_nonzero(counts))
        bits = max(bits, (2 * present).bit_length())
        total, size = int(counts.sum()), 1 << bits
        if not present:
            return cls(np.zeros(len(counts), np.int64), bits)
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts.astype(np.float64) / total * size)), 0).astype(np.int64)
        order = np.argsort(-counts, kind="stable")[:present]
        while (rest := size - int(freq.sum())) != 0:
            if rest > 0:
                freq[order[: min(rest, present)]] += 1
            else:
                freq[order[freq[order] > 1][:-rest]] -= 1
        return cls(freq, bits)

    def to_bytes(self) -> bytes:
        return struct.pack("<II", self.bits, len(self.freq)) + self.freq.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        bits, n = struct.unpack_from("<II", data)
        return cls(np.frombuffer(data, "<u4", n, 8).astype(np.int64), bits)


def encode_segments(ids: np.ndarray, counts: np.ndarray, table: Table) -> tuple[np.ndarray, list[bytes]]:
    """ids (s, SEGMENT), of which the first counts[k] of row k are coded: the states (s, LANES), and each row's words."""
    s = len(ids)
    ids = ids.reshape(s, STEPS, LANES)
    live = counts.reshape(s, 1) - np.arange(LANES)  # of each lane: the ids from its first on
    x = np.full((s, LANES), _LOW)
    words, told = np.zeros((s, STEPS, LANES), "<u4"), np.zeros((s, STEPS, LANES), bool)
    shift, bits = np.uint64(63 - table.bits), np.uint64(table.bits)
    whole = bool((counts == SEGMENT).all())
    for t in range(STEPS - 1, -1, -1):
        sym = ids[:, t]
        f = table.freq[sym]
        on = None if whole else live > t * LANES
        if on is not None:
            f = np.where(on, f, np.uint64(1))
        full = x >= f << shift
        if on is not None:
            full &= on
        words[:, t] = x.astype(np.uint32)
        told[:, t] = full
        y = np.where(full, x >> _32, x)
        q = y // f
        y = (q << bits) + (y - q * f) + table.cum[sym]
        x = y if on is None else np.where(on, y, x)
    return x, [words[k][told[k]].tobytes() for k in range(s)]


def decode_segments(states: np.ndarray, words: np.ndarray, begin: np.ndarray, counts: np.ndarray, table: Table) -> np.ndarray:
    """The ids (s, SEGMENT); row k's words begin at begin[k]."""
    s = len(states)
    out = np.zeros((s, STEPS, LANES), np.uint32)
    x, at = states.copy(), begin.astype(np.int64)
    words = np.r_[words, np.zeros(LANES, "<u4")].astype(np.uint64)
    mask, bits = np.uint64((1 << table.bits) - 1), np.uint64(table.bits)
    live = counts.reshape(s, 1) - np.arange(LANES)
    whole = bool((counts == SEGMENT).all())
    for t in range(STEPS if s and counts.max() else 0):
        slot = x & mask
        sym = table.slot[slot.astype(np.int64)]
        y = table.freq[sym] * (x >> bits) + slot - table.cum[sym]
        short = y < _LOW
        if not whole:
            on = live > t * LANES
            short &= on
            sym = np.where(on, sym, 0)
        n = short.sum(1)
        if n.any():
            where = at[:, None] + np.cumsum(short, 1) - 1
            y = np.where(short, y << _32 | words[np.where(short, where, 0)], y)
            at += n
        x = y if whole else np.where(on, y, x)
        out[:, t] = sym
    return out.reshape(s, SEGMENT)


Document = tuple[int | None, np.ndarray]


def encode_blocks(blocks: list[tuple[int, list[Document]]], table: Table) -> list[bytes]:
    """Bytes of each block (ids before it, its documents)."""
    flat = [np.concatenate([ids for _, ids in docs]) if docs else np.zeros(0, np.uint32) for _, docs in blocks]
    pieces = [(len(x) + SEGMENT - 1) // SEGMENT for x in flat]
    ids, counts = np.zeros((sum(pieces), SEGMENT), np.int64), np.zeros(sum(pieces), np.int64)
    row = 0
    for x, n in zip(flat, pieces, strict=True):
        ids.reshape(-1)[row * SEGMENT : row * SEGMENT + len(x)] = x
        counts[row : row + n] = SEGMENT
        if n:
            counts[row + n - 1] = len(x) - (n - 1) * SEGMENT
        row += n
    states, words = np.zeros((len(ids), LANES), np.uint64), [b""] * len(ids)
    for group in (np.flatnonzero(counts == SEGMENT), np.flatnonzero(counts < SEGMENT)):
        for i in range(0, len(group), TOGETHER // SEGMENT):
            part = group[i : i + TOGETHER // SEGMENT]
            got, w = encode_segments(ids[part], counts[part], table)
            states[part] = got
            for k, x in zip(part.tolist(), w, strict=True):
                words[k] = x
    out, row = [], 0
    for (first, docs), x, n in zip(blocks, flat, pieces, strict=True):
        known = np.array([d is not None for d, _ in docs], np.uint8)
        head = _HEAD.pack(MAGIC, LANES, SEGMENT, len(docs), first, len(x), n, zlib.crc32(x.astype("<u4").tobytes()))
        index = np.array([d or 0 for d, _ in docs], "<i8").tobytes() + known.tobytes() + np.array([len(ids) for _, ids in docs], "<i8").tobytes()
        marks = np.array([len(w) // 4 for w in words[row : row + n]], "<u4").tobytes() + states[row : row + n].astype("<u8").tobytes()
        body = head + index + marks + b"".join(words[row : row + n])
        out.append(body + struct.pack("<I", zlib.crc32(body)))
        row += n
    return out


def decode_blocks(blocks: list[bytes], table: Table) -> list[tuple[int, list[Document]]]:
    """What encode_blocks() was given; raises ValueError where a checksum is wrong."""
    heads, states, words, lengths = [], [], [], []
    for data in blocks:
        magic, lanes, segment, n_docs, first, n_ids, n, crc = _HEAD.unpack_from(data)
        if magic != MAGIC or (lanes, segment) != (LANES, SEGMENT) or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block of token ids is damaged")
        at = _HEAD.size
        doc_ids, known = np.frombuffer(data, "<i8", n_docs, at), np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
        sizes = np.frombuffer(data, "<i8", n_docs, at + 9 * n_docs)
        at += 17 * n_docs
        lengths.append(np.frombuffer(data, "<u4", n, at).astype(np.int64))
        states.append(np.frombuffer(data, "<u8", n * LANES, at + 4 * n).reshape(n, LANES))
        at += 4 * n + 8 * n * LANES
        words.append(np.frombuffer(data, "<u4", int(lengths[-1].sum()), at))
        heads.append((first, n_ids, n, crc, doc_ids, known, sizes))
    if not blocks:
        return []
    counts = np.concatenate([np.r_[np.full(max(n - 1, 0), SEGMENT), n_ids - (n - 1) * SEGMENT][: n or 0] for _, n_ids, n, *_ in heads]).astype(np.int64)
    x, w, size = np.concatenate(states).astype(np.uint64), np.concatenate(words), np.concatenate(lengths)
    begin = np.cumsum(size) - size
    ids = np.zeros((len(x), SEGMENT), np.uint32)
    for group in (np.flatnonzero(counts == SEGMENT), np.flatnonzero(counts < SEGMENT)):
        for i in range(0, len(group), 2 * TOGETHER // SEGMENT):
            part = group[i : i + 2 * TOGETHER // SEGMENT]
            ids[part] = decode_segments(x[part], w, begin[part], counts[part], table)
    out, row = [], 0
    for first, n_ids, n, crc, doc_ids, known, sizes in heads:
        flat = ids[row : row + n].reshape(-1)[:n_ids]
        row += n
        if zlib.crc32(flat.astype("<u4").tobytes()) != crc:
            raise ValueError("a block of token ids is damaged")
        ends = np.cumsum(sizes)
        out.append((first, [(int(d) if k else None, flat[e - s : e]) for d, k, s, e in zip(doc_ids, known, sizes.tolist(), ends.tolist(), strict=True)]))
    return out


def write_tokens(docs: DataFrame, path: str | None = None, end: int | None = 2, to: str | None = None) -> str:
    """Writes the ids of all rows of docs, in ascending doc_id order, and returns the folder (a new one in the shared
    folder unless `to` names it).

    Text null is empty and codes the end id alone. Rows of one doc_id stand together in the order of their ids; null
    doc_ids come first. An empty table gives a table row and no blocks. Other columns are ignored.
    """
    path = path or default_path()
    spark = docs.sparkSession
    n = parallelism(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    borders = docs.select(F.percentile_approx("doc_id", F.array([F.lit(k / n) for k in range(1, n)]), F.lit(10_000))).first()[0] if n > 1 else None
    part = F.lit(0)
    if borders:
        marks = F.array([F.lit(b) for b in sorted(set(borders))])
        part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(marks, lambda b: b <= F.col("doc_id"))))
    dealt = tokens(docs.withColumn("part", part), path, end, ("part", "doc_id"))
    dealt = dealt.repartitionById(n, F.col("part")).sortWithinPartitions(F.col("part"), F.col("doc_id").asc_nulls_first(), "ids")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            ends = before + np.cumsum(sizes)
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends - sizes), batch.column(2), batch.column(3)], ["part", "doc_id", "before", "n_tokens", "ids"])

    coded = stored(dealt.mapInArrow(trimming(numbered), schema("part int, doc_id long, before long, n_tokens long, ids binary")), "ids", "zstd")
    sizes = {r["part"]: r["n"] for r in coded.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base = {p: sum(v for q, v in sizes.items() if q < p) for p in sizes}
    table = Table.of_counts(counted(coded, width(path)))
    dtype = width(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple[int, int, list[Document]]] = []  # part, ids before the block, documents
        size = total = 0

        def done() -> pa.RecordBatch:
            data = encode_blocks([(first, docs) for _, first, docs in blocks], table)
            out = pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in blocks], pa.int32()), pa.array([f for _, f, _ in blocks], pa.int64()), pa.array(data, pa.binary())], ["part", "first", "block"])
            blocks.clear()
            return out

        for batch in batches:
            for p, d, before, m, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = base[p] + before
                if not blocks or size + m > BLOCK or blocks[-1][0] != p or blocks[-1][1] + size != start:
                    if total >= TOGETHER:
                        yield done()
                        total = 0
                    blocks.append((p, start, []))
                    size = 0
                blocks[-1][2].append((d, np.frombuffer(ids, dtype)))
                size += m
                total += m
        if blocks:
            yield done()

    to = to or f"{shared_dir(spark)}/trackloom/tokens-{uuid.uuid4().hex}"
    coded.mapInArrow(trimming(run), schema("part int, first long, block binary")).write.option("compression", "none").parquet(to)
    spark.createDataFrame([(-1, 0, table.to_bytes())], "part int, first long, block binary").coalesce(1).write.mode("append").option("compression", "none").parquet(to)
    return to


def counted(coded: DataFrame, dtype: str) -> np.ndarray:
    """How often each id is in the column ids; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            c = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype))
            if len(c) > len(total):
                c, total = total, c
            total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    rows = coded.select("ids").mapInArrow(trimming(run), schema("id long, n long")).groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers) of every document in the folder's blocks."""
    files = spark.read.schema("part int, first long, block binary").parquet(folder)
    table = files.where("part = -1").first()["block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Table.from_bytes(table)
        for batch in batches:
            data = batch.column(0).to_pylist()
            for i in range(0, len(data), 16):
                ids, start, n, out = [], [], [], []
                for first, docs in decode_blocks(data[i : i + 16], shared):
                    for d, x in docs:
                        ids.append(d)
                        start.append(first)
                        n.append(len(x))
                        out.append(x.astype("<u4").tobytes())
                        first += len(x)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return files.where("part >= 0").select("block").mapInArrow(trimming(run), schema("doc_id long, start long, n_tokens long, ids binary"))


def op1_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of the ids of every document, from the files."""
    folder = write_tokens(documents(spark, sf_dir))
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
