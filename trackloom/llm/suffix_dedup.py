"""Removes passages that occur earlier in the corpus.

Every byte goes that a string of WINDOW bytes covers which also starts earlier: in a document of smaller id, or earlier in
the same one. Strings are judged on the input.

1. Each window gets the least of the hashes of the GRAM-byte strings in it: equal windows get equal keys. A run of window
   starts with one key is a segment. A window that repeats lies in segments of one key.
2. Segments meet by key. Of segments with equal bytes the earliest stays, the others go whole. A key whose segments all
   have the same bytes is done.
3. The different segments of a key go, with their bytes, to one task, which merges Burrows-Wheeler transforms of shards of
   them (bwt.py) and reads off the intervals of suffixes that share WINDOW bytes. Of each the earliest start stays.

Copies within a task are found there and then, so a group of copies sends at most one segment from each task. A key with
very many different segments (a common passage in different surroundings) is split before: each of its windows becomes a
segment of its own, whose key is the whole window, and step 2 settles it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import repeated
from .common import documents, keyed, parallelism, schema, stored, texts_of, trimming, turn

WINDOW, GRAM, FINE = 100, 32, 64
#: Window starts of a segment at most; segments and bytes that a task gathers before it goes on.
RUN, GATHERED, CHUNK = 4096, 500_000, 1 << 20
SELF = 1 << 20
#: Different segments of a key from which it is split, and how many keys may be split at most (their list is broadcast).
#: They are estimated from one document in SAMPLE, which decides how the work is dealt and never what goes.
SPLIT, MOST_SPLIT, SAMPLE = 512, 1 << 22, 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each string of `gram` bytes, a power of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(29)
    step, mix = 1, 0xBF58476D1CE4E5B9
    while step < gram:
        h = h[:-step] * np.uint64(mix) + h[step:]
        h ^= h >> np.uint64(31)
        step, mix = 2 * step, (mix * mix + 2) % (1 << 64)
    return h


def slid(x: np.ndarray, wide: int, best: np.ufunc) -> np.ndarray:
    """best (minimum or maximum) of each `wide` neighbours."""
    n = 1
    while 2 * n <= wide:
        x, n = best(x[:-n], x[n:]), 2 * n
    return best(x[: -(wide - n)], x[wide - n :]) if n < wide else x


def window_keys(data: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """The least gram hash in each window."""
    return slid(gram_hashes(data, gram), window - gram + 1, np.minimum)


def segments(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows) of each segment; SELF is added to the windows if the segment may repeat itself."""
    if len(text) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = WINDOW - GRAM + 1
    grams = gram_hashes(np.frombuffer(text, np.uint8), GRAM)
    keys = slid(grams, wide, np.minimum)
    lo = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    n = np.diff(np.r_[lo, len(keys)])
    if n.max() > RUN:  # of text that repeats itself
        lo = np.concatenate([np.arange(a, a + m, RUN) for a, m in zip(lo.tolist(), n.tolist(), strict=True)])
        n = np.diff(np.r_[lo, len(keys)])
    # where a gram is the least of some window: the largest of its windows' keys is its own hash
    around = slid(np.r_[np.zeros(wide - 1, np.uint64), keys, np.zeros(wide - 1, np.uint64)], wide, np.maximum)
    at = np.flatnonzero(around == grams)
    twice = np.flatnonzero((grams[at[1:]] == grams[at[:-1]]) & (at[1:] - at[:-1] <= wide))
    if len(twice):
        own = np.zeros(len(lo), bool)
        for p, q in zip(at[twice].tolist(), at[twice + 1].tolist(), strict=True):
            a, b = np.searchsorted(lo, max(0, p - wide + 1), "right") - 1, np.searchsorted(lo, q, "right")
            own[a:b] |= keys[lo[a:b]] == grams[p]
        n = np.where(own, n + SELF, n)
    return keys[lo], lo, n


def _found(batches: Iterator[pa.RecordBatch], split: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (key, hash of the bytes, document, first window, windows), by key, hash and place, of a task's segments."""
    digest, both = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_intdigest
    got: list[tuple[np.ndarray, ...]] = []
    size = 0

    def ordered() -> tuple[np.ndarray, ...]:
        key, h, doc, lo, n = (np.concatenate(x) for x in zip(*got, strict=True))
        by = np.lexsort((lo, doc, h, key))
        return key[by], h[by], doc[by], lo[by], n[by]

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            key, lo, n = segments(text)
            if len(split) and len(key):
                hot = split[np.minimum(np.searchsorted(split, key), len(split) - 1)] == key
                if hot.any():
                    at = np.concatenate([np.arange(a, a + m % SELF) for a, m in zip(lo[hot].tolist(), n[hot].tolist(), strict=True)])
                    wide = [both(text[a : a + WINDOW]) for a in at.tolist()]
                    got.append((np.array([x >> 64 for x in wide], np.uint64), np.array([x & (1 << 64) - 1 for x in wide], np.uint64), np.full(len(at), doc), at, np.ones(len(at), np.int64)))
                    size += len(at)
                    key, lo, n = key[~hot], lo[~hot], n[~hot]
            h = [digest(text[a:b]) for a, b in zip(lo.tolist(), (lo + n % SELF + WINDOW - 1).tolist(), strict=True)]
            got.append((key, np.array(h, np.uint64), np.full(len(key), doc), lo, n))
            size += len(key)
        if size >= GATHERED:
            yield ordered()
            got, size = [], 0
    if size:
        yield ordered()


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    return np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])] if len(columns[0]) else np.zeros(0, bool)


def common_keys(docs: DataFrame) -> np.ndarray:
    """Keys, in order, of about so many different segments that no task should get them all. Only keys with several in a
    task's sample are counted, so a key may have some SAMPLE times as many as there are tasks and not be named."""
    docs = docs.where(F.pmod(F.xxhash64("_k"), F.lit(SAMPLE)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("suffix_dedup")
        total = 0
        for key, h, *_ in _found(batches, np.zeros(0, np.uint64)):
            total += len(key)
            keys, n = np.unique(key[_changes(key, h)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view(np.int64)), pa.array(n[n > 1])], ["key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["key", "n"])

    counts = stored(docs.mapInArrow(trimming(run), schema("key long, n long")).groupBy("key").agg(F.sum("n").alias("n")).where(F.col("key").isNull() | (F.col("n") >= SPLIT // SAMPLE)), "keys")
    total = counts.where("key is null").agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("key").isNotNull() & (F.col("n") >= max(SPLIT // SAMPLE, total // MOST_SPLIT))).collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))


def met(docs: DataFrame) -> DataFrame:
    """(gone boolean, key, _k, lo, n): segments that go whole, and those that must be compared with others of their key."""
    split = common_keys(docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("suffix_dedup")
        for key, h, doc, lo, n in _found(batches, split):
            copy = ~_changes(key, h)
            # known to go: they meet nothing, so they are dealt evenly
            key = np.where(copy, (doc.astype(np.uint64) + lo.astype(np.uint64)) * _MIX, key)
            for i in range(0, len(key), 50_000):
                p = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[p].view(np.int64)), pa.array(h[p].view(np.int64)), pa.array(doc[p]), pa.array(lo[p]), pa.array(np.where(copy[p], -n[p], n[p]).astype(np.int32))], ["key", "h", "_k", "lo", "n"])

    rows = docs.mapInArrow(trimming(send), schema("key long, h long, _k long, lo long, n int"))
    rows = rows.repartition(parallelism(docs.sparkSession), "key").sortWithinPartitions("key", "h", "_k", "lo")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        size = 0

        def settled(last: bool) -> pa.RecordBatch:
            nonlocal size
            key, h, doc, lo, n = (np.concatenate(x) for x in zip(*waiting, strict=True))
            cut = len(key) if last else int(np.flatnonzero(_changes(key))[-1])  # the last key may go on
            waiting[:] = [[x[cut:] for x in (key, h, doc, lo, n)]]
            size = len(key) - cut
            key, h, doc, lo, n = (x[:cut] for x in (key, h, doc, lo, n))
            known = n < 0
            first = _changes(key, h) | known
            group = np.cumsum(_changes(key)) - 1
            several = (np.bincount(group, first & ~known) > 1)[group] if cut else known
            out = ~first | known | several | (n >= SELF)
            return pa.RecordBatch.from_arrays([pa.array((~first | known)[out]), pa.array(key[out]), pa.array(doc[out]), pa.array(lo[out]), pa.array(np.abs(n[out]))], ["gone", "key", "_k", "lo", "n"])

        for batch in batches:
            waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= 200_000:
                yield settled(False)
        if waiting:
            yield settled(True)

    return stored(rows.mapInArrow(trimming(meet), schema("gone boolean, key long, _k long, lo long, n int")), "segments")


def narrowed(keys: np.ndarray, lo: np.ndarray, own: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(segment, first window, text) of the parts whose windows share a longer gram with another part of their key, or of
    segments that may repeat themselves (own)."""
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size)
    least = window_keys(np.frombuffer(b"".join(texts), np.uint8), FINE)
    of = np.repeat(np.arange(len(texts)), size)[: len(least)]
    inside = np.arange(len(least)) <= (end - WINDOW)[of]
    key = least ^ keys[of]
    s = np.flatnonzero(inside & np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
    stop = np.flatnonzero(inside & np.r_[(key[1:] != key[:-1]) | (of[1:] != of[:-1]) | ~inside[1:], True]) + 1
    _, at, count = np.unique(key[s], return_inverse=True, return_counts=True)
    w = of[s]
    keep = (count[at] > 1) | own[w]
    s, stop, w = s[keep], stop[keep], w[keep]
    begin = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (s[1:] != stop[:-1])]) if len(w) else np.zeros(0, int)
    last = np.r_[begin[1:] - 1, len(w) - 1][: len(begin)]
    a, b, w = s[begin] - (end - size)[w[begin]], stop[last] - (end - size)[w[begin]] + WINDOW - 1, w[begin]
    return w, lo[w] + a, [texts[i][x:y] for i, x, y in zip(w.tolist(), a.tolist(), b.tolist(), strict=True)]


def later(keys: np.ndarray, docs: np.ndarray, lo: np.ndarray, own: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows) of the runs of windows that repeat an earlier one, by document and place."""
    of, first, parts = narrowed(keys, lo, own, texts)
    if not len(of):
        return of, of, of
    string, offset, block = repeated(parts, WINDOW)
    doc, at = docs[of[string]], first[string] + offset
    by = np.lexsort((at, doc, block))
    again = ~_changes(block[by])
    doc, at = doc[by][again], at[by][again]
    by = np.lexsort((at, doc))
    doc, at = doc[by], at[by]
    begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)]) if len(at) else np.zeros(0, int)
    return doc[begin], at[begin], at[np.r_[begin[1:] - 1, len(at) - 1][: len(begin)]] - at[begin] + 1


def removed(docs: DataFrame) -> DataFrame:
    """_k, doc_id, n_bytes, n_removed, spans array of (start, end), kept binary of every row of docs.

    spans are the maximal runs of bytes that go; kept are the others, and may begin or end within a character. Text null
    is empty. Where doc_id repeats or is null, rows count as documents of their own, in the order of (doc_id, text), and
    of rows that repeat the first stays. An empty table gives no rows; other columns are ignored.
    """
    docs = keyed(docs)
    n = parallelism(docs.sparkSession)
    segs = met(docs.select("_k", "text"))
    dealt = docs.repartition(n, "_k")  # once: both joins read this exchange
    wanted = segs.where("not gone").groupBy(F.col("_k").alias("of_k")).agg(F.collect_list(F.struct("key", "lo", "n")).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("suffix_dedup")
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text, parts in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for p in parts:
                    for column, v in zip(rows, (p["key"], doc, p["lo"], p["n"] >= SELF, text[p["lo"] : p["lo"] + p["n"] % SELF + WINDOW - 1]), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in rows[:3]), pa.array(rows[3], pa.bool_()), pa.array(rows[4], pa.binary())], ["key", "_k", "lo", "own", "data"])

    bytes_of = dealt.join(wanted.hint("shuffle_hash"), F.col("_k") == F.col("of_k")).select("_k", "text", "parts").mapInArrow(trimming(cut), schema("key long, _k long, lo long, own boolean, data binary"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("suffix_dedup")
        key, doc, lo, own = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        data: list[bytes] = []
        size = 0

        def done(m: int) -> pa.RecordBatch:
            d, a, runs = later(key[:m].view(np.uint64), doc[:m], lo[:m], own[:m], data[:m])
            return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int64()), pa.array(runs, pa.int32())], ["_k", "lo", "n"])

        for batch in batches:
            key, doc, lo, own = (np.r_[x, c.to_numpy(zero_copy_only=False)] for x, c in zip((key, doc, lo, own), batch.columns[:4], strict=True))
            new = batch.column(4).to_pylist()
            data += new
            size += sum(map(len, new))
            if size >= CHUNK and (m := int(np.flatnonzero(_changes(key))[-1])):  # the last key may go on
                yield done(m)
                key, doc, lo, own, data = key[m:], doc[m:], lo[m:], own[m:], data[m:]
                size = sum(map(len, data))
        if data:
            yield done(len(data))

    compared = bytes_of.repartition(n, "key").sortWithinPartitions("key").mapInArrow(trimming(compare), schema("_k long, lo long, n int"))
    gone = segs.where("gone").select("_k", "lo", (F.col("n") % SELF).alias("n")).unionByName(compared)
    runs = gone.groupBy(F.col("_k").alias("of_k")).agg(F.sort_array(F.collect_list(F.struct("lo", "n"))).alias("runs"))

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("suffix_dedup")
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, less, spans, kept = [], [], [], []
            for text, found in zip(texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                joined: list[list[int]] = []
                for r in found or ():
                    a, b = r["lo"], r["lo"] + r["n"] + WINDOW - 1
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b])
                sizes.append(len(text))
                less.append(sum(b - a for a, b in joined))
                spans.append([{"start": a, "end": b} for a, b in joined])
                marks = [0, *(x for ab in joined for x in ab), len(text)]
                kept.append(b"".join([text[a:b] for a, b in zip(marks[::2], marks[1::2], strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(less, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["_k", "doc_id", "n_bytes", "n_removed", "spans", "kept"])

    joined = dealt.join(runs.hint("shuffle_hash"), F.col("_k") == F.col("of_k"), "left").select("_k", "doc_id", "text", "runs")
    return joined.mapInArrow(trimming(without), schema("_k long, doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, kept_text of every row of docs: what stays, without the bytes of characters that were cut apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("suffix_dedup")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode("utf-8", "ignore") for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "kept_text"])

    return removed(docs).select("doc_id", "kept").mapInArrow(trimming(run), schema("doc_id long, kept_text string"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes and what stays of every document."""
    found = removed(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
