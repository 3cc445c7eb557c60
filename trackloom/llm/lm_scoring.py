"""Scores of whole documents by word counts and by a gated recurrent language model (gru.py).

The counts cover every training document. They are gathered by blocks: documents are stored in blocks of bounded bytes, a
block sends each distinct word's hash and count once to the word's bucket, and the bucket answers each block with the
totals. So no task and no broadcast holds the vocabulary, and a frequent word costs one row a block.

The recurrent model's frequent words and its classes come from these totals. A task trains on its training documents, all
of them, beginning from weights fitted on FIRST documents; the tasks' weights are averaged by their tokens.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gru
from .common import discard, documents, parallelism, reuse_freed, schema, stored, texts_of, trimming, turn

BLOCK_BYTES, SHARE, FIRST, RATE = 16 << 20, 1, 300, 0.02
#: Codes that a task trains on or scores together.
TOGETHER = 1_000_000
#: Blocks whose counts a bucket gathers, or that a task codes, on average: some 50 MB.
BLOCKS = 4
SHAPE = gru.Shape()
#: The end of a document; no word holds a space.
END = b" "
LN10 = np.log(10)


def words_of(text: bytes) -> list[bytes]:
    """The words, A-Z in lower case, and the end."""
    out = text.lower().split()
    out.append(END)
    return out


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rest_class(counts: np.ndarray) -> np.ndarray:
    """Class of a word that is not a frequent one: by the power of two of its count; once or never: 0."""
    return np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), SHAPE.rest - 1)


def blocked(docs: DataFrame) -> DataFrame:
    """(block, doc_id, held_out, text), stored: neighbours share a block of at most BLOCK_BYTES or one document."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("lm_scoring")
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            blocks = []
            for n in pc.binary_length(batch.column(2)).fill_null(0).to_pylist():
                if size and size + n > BLOCK_BYTES:
                    block, size = block + 1, 0
                size += n
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *batch.columns], ["block", "doc_id", "held_out", "text"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(trimming(run), schema("block long, doc_id long, held_out boolean, text string")), "blocks")


def spread(blocks: DataFrame) -> int:
    """Partitions by which the blocks' counts and texts are dealt: more where there are more blocks."""
    return max(parallelism(blocks.sparkSession), -(-blocks.select("block").distinct().count() // BLOCKS))


def totals(blocks: DataFrame, width: int) -> DataFrame:
    """(block, hashes, counts), stored: of each block, parts of its words' hashes with their counts in all training
    documents. Rows of block -1 hold, of a bucket, its most frequent words; of block -2, by rest_class: words and tokens.
    width: the shuffle's partitions; a bucket is part of one, so that a task's memory doesn't grow with the corpus."""
    buckets = 2 * width
    borders = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("lm_scoring")
        block, number, seen, trained = None, None, [], []

        def done() -> pa.RecordBatch:
            names = list(number)
            n = np.bincount(np.concatenate(trained), minlength=len(names)) if trained else np.zeros(len(names), np.int64)
            h = hashed(names)
            by = np.argsort(h)
            h, n = h[by], n[by]
            ends = np.r_[np.searchsorted(h, borders[1:]), len(h)]
            parts = [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([h[a:b].tobytes() for _, a, b in parts], pa.binary()), pa.array([n[a:b].astype(np.int64).tobytes() for _, a, b in parts], pa.binary())], ["bucket", "block", "hashes", "counts"])

        for batch in batches:
            for b, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                if b != block:
                    if block is not None:
                        yield done()
                    block, number, seen, trained = b, defaultdict(count().__next__), [], []
                words = words_of(text)
                ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                if not held:
                    trained.append(ids)
        if block is not None:
            yield done()

    def answer(t: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in t["hashes"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in t["counts"].to_pylist()])
        known, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, counts, len(known)).astype(np.int64)
        all_of = total[at]
        ends = np.cumsum([len(x) for x in hashes])
        rows = [(b, h.tobytes(), all_of[e - len(h) : e].tobytes()) for b, h, e in zip(t["block"].to_pylist(), hashes, ends.tolist(), strict=True)]
        real = total > 0
        top = np.argsort(-total, kind="stable")[: SHAPE.words]
        top = top[real[top]]
        which = rest_class(total[real])
        rows.append((-1, known[top].tobytes(), total[top].tobytes()))
        rows.append((-2, np.bincount(which, minlength=SHAPE.rest).astype(np.int64).tobytes(), np.bincount(which, total[real], SHAPE.rest).astype(np.int64).tobytes()))
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "hashes": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    sent = blocks.select("block", "held_out", "text").mapInArrow(trimming(send), schema("bucket int, block long, hashes binary, counts binary"))
    return stored(sent.repartition(width, "bucket").groupBy("bucket").applyInArrow(answer, schema("block long, hashes binary, counts binary")), "totals", "zstd")


class Vocabulary:
    """What the driver knows of the counts: sums, the frequent words, and sums by class of the others."""

    def __init__(self, answers: DataFrame):
        def pairs(least: int):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                turn("lm_scoring")
                for batch in batches:
                    for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        n = np.frombuffer(c, np.int64)
                        on = n >= least
                        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, np.int64)[on]), pa.array(n[on])], ["h", "n"])

            return run

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHAPE.rest)), pa.array(np.frombuffer(w, np.int64)), pa.array(np.frombuffer(c, np.int64))], ["k", "words", "tokens"])

        sums = answers.where("block = -2").select("hashes", "counts").mapInArrow(trimming(places), schema("k long, words long, tokens long")).groupBy("k").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).collect()
        self.rest_words, self.rest_tokens = np.zeros(SHAPE.rest, np.int64), np.zeros(SHAPE.rest, np.int64)
        for r in sums:
            self.rest_words[r["k"]], self.rest_tokens[r["k"]] = r["words"], r["tokens"]
        # the most frequent words are among those of the classes that hold enough words together
        enough = np.flatnonzero(np.cumsum(self.rest_words[::-1])[::-1] >= SHAPE.words)
        least = 1 << int(enough[-1]) if len(enough) else 1
        top = answers.where("block = -1").select("hashes", "counts").mapInArrow(trimming(pairs(least)), schema("h long, n long")).orderBy(F.desc("n"), "h").limit(SHAPE.words).collect()
        self.distinct, self.tokens = int(self.rest_words.sum()), int(self.rest_tokens.sum())
        self.frequent, self.counts = np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.int64)
        for k, n in zip(rest_class(self.counts).tolist(), self.counts.tolist(), strict=True):
            self.rest_words[k] -= 1
            self.rest_tokens[k] -= n

    def codes(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code of each word, and the natural log of its share of its class (0 for frequent words).

        Half of class 0 belongs to the words that occur once, the other half to words that never do.
        """
        order = np.argsort(self.frequent)
        at = np.minimum(np.searchsorted(self.frequent[order], hashes), max(len(order) - 1, 0))
        head = self.frequent[order][at] == hashes if len(order) else np.zeros(len(hashes), bool)
        k = rest_class(counts)
        share = np.where(k > 0, counts / np.maximum(self.rest_tokens[k], 1), np.where(counts > 0, 0.5 / max(self.rest_words[0], 1), 0.5 / (self.distinct + 1)))
        code = np.where(head, order[at] if len(order) else 0, SHAPE.words + k)
        return code.astype(np.uint16), np.where(head, 0.0, np.log(np.minimum(share, 1.0)))

    def weights(self) -> gru.Weights:
        words = np.zeros(SHAPE.words)
        words[: len(self.counts)] = self.counts
        return gru.with_counts(gru.initial(SHAPE), SHAPE, words, self.rest_tokens)


def coded(blocks: DataFrame, answers: DataFrame, vocabulary: Vocabulary, width: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, rest_score, codes), stored, of every document; a block and its
    counts meet in one task."""
    each = np.log10(vocabulary.tokens + 0.1 * (vocabulary.distinct + 1))

    def run(docs: pa.Table, totals_: pa.Table) -> pa.Table:
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        ids, sizes = [], []
        for text in texts_of(docs["text"].combine_chunks() if docs.num_rows else pa.array([], pa.string())):
            words = words_of(text)
            ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            sizes.append(len(words))
        h = hashed(list(number))
        known, total = np.frombuffer(b"".join(totals_["hashes"].to_pylist()), np.uint64), np.frombuffer(b"".join(totals_["counts"].to_pylist()), np.int64)
        by = np.argsort(known)
        c = total[by][np.searchsorted(known[by], h)] if len(h) else np.zeros(0, np.int64)
        code, share = vocabulary.codes(h, c)
        logs = np.log10(c + 0.1)
        base = [float(logs[x].sum() - len(x) * each) for x in ids]
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array([int(np.count_nonzero(c[x])) for x in ids], pa.int64()),
            "base_score": pa.array(base, pa.float64()), "rest_score": pa.array([float(share[x].sum()) for x in ids], pa.float64()), "codes": pa.array([code[x].astype("<u2").tobytes() for x in ids], pa.binary()),
        })

    both = blocks.repartition(width, "block").groupBy("block").cogroup(answers.where("block >= 0").repartition(width, "block").groupBy("block"))
    return stored(both.applyInArrow(run, schema("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rest_score double, codes binary")), "codes", "zstd")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Documents' codes (of a batch's last column), about TOGETHER in a chunk."""
    docs, size = [], 0
    for batch in batches:
        for x in batch.column(batch.num_columns - 1).to_pylist():
            docs.append(np.frombuffer(x, "<u2").astype(np.int64))
            size += len(docs[-1])
            if size >= TOGETHER:
                yield docs
                docs, size = [], 0
    if docs:
        yield docs


def fitted(codes: DataFrame, vocabulary: Vocabulary, share: int = SHARE, first: int = FIRST) -> gru.Weights:
    """The averaged weights of the tasks' training; the counts' biases alone where there is nothing to train on."""
    like = vocabulary.weights()
    data = codes.where("not held_out").select("doc_id", "codes")

    def training(begin: gru.Weights, rate: float, passes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn("lm_scoring")
            reuse_freed()
            w, n = begin, 0
            for docs in chunks(batches):
                w = gru.trained(w, SHAPE, docs, rate, passes=passes)
                n += sum(map(len, docs))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([gru.to_bytes(w)], pa.binary())], ["part", "n", "w"])

        return run

    kind = schema("part long, n long, w binary")
    drawn = data.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64)) == 0).limit(first)
    begun = drawn.coalesce(1).mapInArrow(trimming(training(like, 0.02, 2)), kind).collect()
    begin = gru.from_bytes(begun[0]["w"], like) if begun else like
    parts = stored(data.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).mapInArrow(trimming(training(begin, RATE, 1)), kind), "weights")

    def mean(t: pa.Table) -> pa.Table:
        n = t["n"].to_numpy()
        total = sum(k * np.frombuffer(w, "<f4").astype(np.float64) for k, w in zip(n.tolist(), t["w"].to_pylist(), strict=True))
        return pa.table({"part": pa.array([int(t["part"][0].as_py()) // 32], pa.int64()), "n": pa.array([int(n.sum())], pa.int64()), "w": pa.array([(total / n.sum()).astype("<f4").tobytes()], pa.binary())})

    while parts.count() > 1:  # 32 by 32, so that no task or driver holds them all
        before = parts
        parts = stored(parts.groupBy(F.expr("part div 32").alias("group")).applyInArrow(mean, kind), "weights")
        discard(before)
    row = parts.first()
    return gru.from_bytes(row["w"], like) if row else begin


def scored(docs: DataFrame, share: int = SHARE, first: int = FIRST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Text null is empty: its end alone is scored. A null doc_id is a training document; rows that repeat count as often as
    they are there. An empty table gives no rows; other columns are ignored. Words are told apart by 64-bit hashes.
    score is the model's log10 probability of the whole text, with its state carried through. share: the recurrent model
    trains on one training document in so many, all by default. The weights are means over tasks, so that score (alone)
    depends somewhat on how the table's files are dealt to tasks; the same files and settings give the same scores.
    """
    blocks = blocked(docs)
    width = spread(blocks)
    answers = totals(blocks, width)
    vocabulary = Vocabulary(answers)
    codes = coded(blocks, answers, vocabulary, width)
    weights = fitted(codes, vocabulary, share, first)
    train = vocabulary.tokens
    keep = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "rest_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("lm_scoring")
        reuse_freed()
        for batch in batches:
            ends = np.cumsum(batch.column(2).to_numpy())
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + TOGETHER, "right")))
                part = batch.slice(begin, end - begin)
                got = gru.scores(weights, SHAPE, [np.frombuffer(x, "<u2").astype(np.int64) for x in part.column(6).to_pylist()])
                score = (got + part.column(5).to_numpy()) / LN10
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(np.full(part.num_rows, train)), part.column(4), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                begin = end

    return codes.select(*keep, "codes").mapInArrow(trimming(run), schema("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def op9_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and scores of every document."""
    return scored(documents(spark, sf_dir))
