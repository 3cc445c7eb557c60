"""Which tokens of two tokenizers cover the same bytes.

Two byte-owner arrays give, for every byte of a text, the number of the token of A and of B that holds it (np.repeat of
token numbers by token lengths). A change of owner on either side begins a new pair of overlapping tokens; a change on both
sides at once is a cut, which ends a group.

Texts are cut at single spaces between other characters. Neither vocabulary holds a token across such a place, so a text's
tokens are those of its chunks, and both sides change owner there. Each distinct chunk is encoded and aligned once in a
worker's bounded memory; numpy puts the texts together. A pair is a code, A's id times B's number of ids plus B's id.
"""

from __future__ import annotations

import functools
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, documents, schema, stored, texts_of, trim, trimming, turn, without_cycles
from .encoding import byte_symbols, is_plain

#: Chunks and bytes of chunks that a worker remembers; codes whose counts are kept by it until they are passed on.
CHUNKS, CHUNK_BYTES = 400_000, 24 << 20
#: Bytes that have their owners in memory at a time, and bytes of text encoded together.
WINDOW, TOGETHER = 1 << 20, 2 << 20
#: Pairs whose counts every task knows: the most frequent ones, at most so many. All others meet their counts by a shuffle.
HOT = 1 << 18
_MARK = "▁".encode()


def owners(a: np.ndarray, b: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A's token, B's token, whether both begin here) of each run of bytes with the same two owners, in order.

    a, b: the tokens' lengths in bytes, over zero, with equal sums. Owners of `window` bytes are in memory at a time.
    """
    ends = [np.cumsum(x) for x in (a, b)]
    total = int(ends[0][-1]) if len(a) else 0
    out, last = [], (-1, -1)
    for lo in range(0, total, window):
        hi = min(lo + window, total)
        owner = []
        for x, e in zip((a, b), ends, strict=True):
            i, j = np.searchsorted(e, lo, "right"), np.searchsorted(e, hi, "left") + 1
            size = np.minimum(e[i:j], hi) - np.maximum(e[i:j] - x[i:j], lo)
            owner.append(np.repeat(np.arange(i, j), size))
        moved = [np.diff(o, prepend=p) != 0 for o, p in zip(owner, last, strict=True)]
        at = np.flatnonzero(moved[0] | moved[1])
        out.append((owner[0][at], owner[1][at], (moved[0] & moved[1])[at]))
        last = (owner[0][-1], owner[1][-1])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, its added tokens included."""
    from tokenizers import Tokenizer

    of = {c: b for b, c in enumerate(byte_symbols())}
    t = Tokenizer.from_file(path)
    names = {i: s for s, i in t.get_vocab(with_added_tokens=True).items()}
    return [bytes(of.get(c, 0) for c in names[i]) if all(c in of for c in names.get(i, " ")) else names.get(i, "").encode() for i in range(max(names) + 1)]


def piece_tokens(model: object) -> list[bytes]:
    """The bytes of each piece."""
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]


class Aligner:
    """Two tokenizers, and what is known of the chunks met so far."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.bytes_a, self.bytes_b = byte_tokens(a), piece_tokens(self.b)
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.many_b = len(self.bytes_b)
        self.dtype = np.dtype("<u4" if len(self.bytes_a) * self.many_b < 1 << 32 else "<u8")
        #: The ids as text, and what follows one: a comma, or a bar (A) or semicolon (B) at the end of a group.
        self.shown = [f"{i},".encode() for i in range(len(self.bytes_a))] + [f"{i}|".encode() for i in range(len(self.bytes_a))] + [f"{i},".encode() for i in range(self.many_b)] + [f"{i};".encode() for i in range(self.many_b)]
        self.symbols = dict(enumerate(byte_symbols()))
        self.stops = {c: self.a.encode(c.decode(), add_special_tokens=False).ids for c in (b".", b",")}
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        #: Of each chunk: tokens of A, of B, groups and links, and whether both sides gave its bytes.
        self.sizes, self.fine = np.zeros((4, 0), np.int64), np.zeros(0, bool)
        self.begin, self.codes, self.texts = np.zeros(0, np.int64), np.zeros(0, self.dtype), []
        self.held = 0
        #: How often each chunk was met in texts that have tokens, and at all.
        self.met, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def thin_out(self, most: int = CHUNKS // 2) -> None:
        """Forgets all but the chunks that were met twice or more, `most` of them and half the bytes at most, the most
        frequent first. Counts that were not passed on are lost."""
        names = list(self.number)
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        order = np.argsort(-self.seen, kind="stable")
        order = order[(self.seen[order] > 1) & (np.cumsum(lengths[order]) <= CHUNK_BYTES // 2)][:most]
        sizes, fine, begin, codes, texts, seen = self.sizes[:, order], self.fine[order], self.begin[order], self.codes, self.texts, self.seen[order]
        self.forget()
        self.number = defaultdict(count(len(order)).__next__, {names[i]: k for k, i in enumerate(order.tolist())})
        after = np.cumsum(sizes[3])
        self.codes = codes[np.repeat(begin - after + sizes[3], sizes[3]) + np.arange(int(sizes[3].sum()))]
        self.sizes, self.fine, self.begin, self.texts, self.held = sizes, fine, after - sizes[3], [texts[i] for i in order.tolist()], int(lengths[order].sum())
        self.met, self.seen = np.zeros(len(order), np.int64), seen // 2

    def learn(self, chunks: list[bytes]) -> None:
        """Encodes and aligns chunks that follow those already known."""
        sizes, fine, codes, texts = [self.sizes], [self.fine], [self.codes], []
        for part in pieces(chunks):
            ids_a, per_a = self._encoded_a(part)
            got = self.b.encode([c.decode("utf-8", "replace") for c in part], num_threads=1)
            per_b = np.fromiter(map(len, got), np.int64, len(got))
            ids_b = np.fromiter(chain.from_iterable(got), np.int64, int(per_b.sum()))
            s, f, c, t = self._aligned(part, ids_a, per_a, ids_b, per_b)
            sizes.append(s)
            fine.append(f)
            codes.append(c)
            texts += t
        self.sizes, self.fine, self.codes = np.concatenate(sizes, 1), np.concatenate(fine), np.concatenate(codes)
        self.texts += texts
        self.begin = np.cumsum(self.sizes[3]) - self.sizes[3]
        self.held += sum(map(len, chunks))
        self.met, self.seen = (np.concatenate([x, np.zeros(len(self.fine) - len(x), np.int64)]) for x in (self.met, self.seen))

    def _encoded_a(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, a space before each, and how many each has.

        A chunk of Latin letters is one word of A's pattern, and so is each of a full stop or comma after it: the library's
        model is asked at once. All others go through the library whole.
        """
        model, shown, space, out, rest = self.a.model.tokenize, self.symbols, self.symbols[32], [], []
        for c in chunks:
            stop = self.stops.get(c[-1:])
            stem = c if stop is None else c[:-1]
            if is_plain(stem):
                ids = [t.id for t in model(space + stem.decode("latin-1").translate(shown))]
                out.append(ids if stop is None else ids + stop)
            else:
                rest.append(len(out))
                out.append([])
        if rest:
            got = self.a.encode([" " + chunks[k].decode("utf-8", "replace") for k in rest], is_pretokenized=True, add_special_tokens=False)
            for k, i in zip(got.word_ids, got.ids, strict=True):
                out[rest[k]].append(i)
        per = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int64, int(per.sum())), per

    def _aligned(self, chunks: list[bytes], ids_a: np.ndarray, per_a: np.ndarray, ids_b: np.ndarray, per_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        first_a, first_b = np.r_[0, np.cumsum(per_a)], np.r_[0, np.cumsum(per_b)]
        joined = [b"".join(map(of.__getitem__, ids.tolist())) for of, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))]
        wanted = b" " + b" ".join(chunks)
        fine = np.ones(len(chunks), bool)
        if joined[0] != wanted or joined[1] != wanted:  # some chunk is not given back
            for k, c in enumerate(chunks):
                fine[k] = all(b"".join(map(of.__getitem__, ids[f[k] : f[k + 1]].tolist())) == b" " + c for of, ids, f in ((self.bytes_a, ids_a, first_a), (self.bytes_b, ids_b, first_b)))
            ids_a, ids_b = ids_a[np.repeat(fine, per_a)], ids_b[np.repeat(fine, per_b)]
            per_a, per_b = per_a * fine, per_b * fine
            first_a, first_b = np.r_[0, np.cumsum(per_a)], np.r_[0, np.cumsum(per_b)]
        of_a, of_b, cuts = owners(self.size_a[ids_a], self.size_b[ids_b])
        chunk = np.repeat(np.arange(len(chunks)), per_a)[of_a]
        links, groups = np.bincount(chunk, minlength=len(chunks)), np.bincount(chunk[cuts], minlength=len(chunks))
        # the text: tokens by group, A's before B's; the last of a side in a group ends it
        group = np.cumsum(cuts) - 1
        group_a, group_b = np.empty(len(ids_a), np.int64), np.empty(len(ids_b), np.int64)
        group_a[of_a], group_b[of_b] = group, group
        shown_a = ids_a + len(self.bytes_a) * (np.diff(group_a, append=-1) != 0)
        shown_b = ids_b + 2 * len(self.bytes_a) + self.many_b * (np.diff(group_b, append=-1) != 0)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        parts = list(map(self.shown.__getitem__, np.concatenate([shown_a, shown_b])[order].tolist()))
        ends = (first_a + first_b).tolist()
        texts = [b"".join(parts[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
        return np.stack([per_a, per_b, groups, links]), fine, (ids_a[of_a] * self.many_b + ids_b[of_b]).astype(self.dtype), texts

    def align(self, texts: list[bytes]) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """Of each text: (n_a, n_b, n_groups, n_links), the groups as text, and the codes of its links."""
        number, per = self.number, []
        found = []
        for t in texts:
            ids = list(map(number.__getitem__, chunks_of(t))) if t else []
            per.append(len(ids))
            found += ids
        new = list(number)[len(self.fine) :] if len(number) > len(self.fine) else []
        if new:
            self.learn(new)
        ids, per = np.array(found, np.int64), np.array(per, np.int64)
        text = np.repeat(np.arange(len(texts)), per)
        bad = np.bincount(text[~self.fine[ids]], minlength=len(texts)) > 0
        good = ~bad[text]
        self.met += np.bincount(ids[good], minlength=len(self.met))
        self.seen += np.bincount(ids, minlength=len(self.seen))
        sizes = np.stack([np.bincount(text[good], s[ids[good]], len(texts)) for s in self.sizes]).astype(np.int64) if len(ids) else np.zeros((4, len(texts)), np.int64)
        groups, links, ends, shown = [], [], np.r_[0, np.cumsum(per)].tolist(), self.texts
        for k, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if bad[k] or x == y:
                groups.append(b"")
                links.append(b"")
                continue
            groups.append(b"".join(map(shown.__getitem__, found[x:y]))[:-1])
            which = ids[x:y]
            size = self.sizes[3][which]
            after = np.cumsum(size)
            links.append(self.codes[np.repeat(self.begin[which] - after + size, size) + np.arange(after[-1])].tobytes())
        return sizes, groups, links

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes and how often they were linked since the chunks were last forgotten or counted."""
        weight = np.repeat(self.met, self.sizes[3])
        self.met[:] = 0
        codes, which = np.unique(self.codes[weight > 0], return_inverse=True)
        return codes, np.bincount(which, weight[weight > 0], len(codes)).astype(np.int64)


def pieces(chunks: list[bytes]) -> Iterator[list[bytes]]:
    """Neighbours of about TOGETHER / 4 bytes, or one longer chunk."""
    begin = size = 0
    for i, c in enumerate(chunks):
        if i > begin and size + len(c) > TOGETHER // 4:
            yield chunks[begin:i]
            begin, size = i, 0
        size += len(c) + 1
    if begin < len(chunks):
        yield chunks[begin:]


def chunks_of(text: bytes) -> list[bytes]:
    """The text, cut at each space that has no space, U+2581 (as which one tokenizer sees a space) or other white space
    beside it; joined by spaces, the chunks are the text."""
    parts = text.split(b" ")
    if not _ODD(text) and _MARK not in text and parts[0] and parts[-1]:
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        before = out[-1]
        if not p or not before or before.endswith((b" ", _MARK)) or _odd_start(p):
            out[-1] = before + b" " + p
        else:
            out.append(p)
    return out


#: First bytes of a part that may be white space or U+2581: ASCII controls, and what begins U+0085, U+00A0, U+1680, U+2000
#: to U+2FFF and U+3000.
_STARTS = frozenset([*range(33), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3])
_ODD = re.compile(rb" [\x00-\x20\x7F\xC2\xE1\xE2\xE3]").search


def _odd_start(part: bytes) -> bool:
    return part[0] in _STARTS if part else True


@functools.lru_cache(1)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


CACHES["alignment"] = aligner.cache_clear


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None, counts: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links (long), groups string and links binary of every row of docs, and with counts a
    row key and more rows: their column counts is not null, and links and counts hold codes and how often they were linked.

    groups is `a1,a2|b1;a3|b2,b3`, the ids of A and of B in each group; links holds the code of each overlap in order,
    little-endian, of 32 bits where all codes fit. a and b: files of a byte-level tokenizers vocabulary without a prefix
    space and of a sentencepiece one that adds it. A text that is null or empty, or that one of the two doesn't give back
    byte by byte (such as one that holds U+2581), has no tokens: zeros and ''. Rows that repeat are aligned each; doc_id
    may be null; an empty table gives no rows; other columns are ignored. No shuffle.
    """
    a, b = a or paths()[0], b or paths()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("alignment")
        tool = aligner(a, b)
        row = TaskContext.get().partitionId() << 40

        def passed_on() -> Iterator[pa.RecordBatch]:
            codes, n = tool.counted()
            for k in range(0, len(codes), 1 << 20):
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([None], pa.int64()), **{c: pa.array([0], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}, "groups": pa.array([""]), "links": pa.array([codes[k : k + (1 << 20)].tobytes()], pa.binary()), "row_key": pa.array([None], pa.int64()), "counts": pa.array([n[k : k + (1 << 20)].tobytes()], pa.binary())})

        tool.met[:] = 0  # a task that failed may have left something
        for batch in batches:
            for part in slices(batch):
                with without_cycles():
                    sizes, groups, links = tool.align(texts_of(part.column(1)))
                out = {"doc_id": part.column(0), **{c: pa.array(sizes[k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, "groups": pa.array(groups, pa.binary()).cast(pa.string()), "links": pa.array(links, pa.binary())}
                if counts:
                    out |= {"row_key": pa.array(np.arange(row, row + part.num_rows)), "counts": pa.nulls(part.num_rows, pa.binary())}
                row += part.num_rows
                del groups, links
                yield pa.RecordBatch.from_pydict(out)
                if len(tool.number) > CHUNKS or tool.held > CHUNK_BYTES:
                    if counts:
                        yield from passed_on()
                    tool.thin_out()
                    trim()
        if counts:
            yield from passed_on()

    more = ", row_key long, counts binary" if counts else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimming(run), schema("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary" + more))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about TOGETHER bytes of text (column 1) together, or one longer text."""
    begin = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
        if i > begin and size + n > TOGETHER:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    yield batch.slice(begin)


def pair_counts(rows: DataFrame, dtype: str) -> DataFrame:
    """(code long, n long): how often each pair is linked, from the rows of aligned() that hold counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"code": np.frombuffer(codes, dtype).astype(np.int64), "n": np.frombuffer(n, np.int64)})

    return rows.where("counts is not null").select("links", "counts").mapInArrow(run, schema("code long, n long")).groupBy("code").agg(F.sum("n").alias("n"))


def ranked(found: DataFrame, total: DataFrame, many_b: int, dtype: str, hot: int = HOT) -> DataFrame:
    """(row_key, n_best, count_sum) of the rows of found, from aligned(), that have links.

    total: pair_counts(), stored. The highest count of each B id is a table of the vocabulary's size. The pairs of at least
    some power of two of links, `hot` at most, are known to every task; the links of others are counted by row and pair
    and meet the rest of the totals in a join, in which no pair is frequent.
    """
    top = total.groupBy((F.col("code") % many_b).alias("id")).agg(F.max("n").alias("top"))
    best, highest = np.zeros(many_b, np.int64), top.toArrow()
    best[highest.column("id").to_numpy()] = highest.column("top").to_numpy()
    steps = {r["k"]: r["c"] for r in total.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("c")).collect()}
    low, room = max(steps, default=0) + 1, hot
    while low and room >= steps.get(low - 1, 0):
        low -= 1
        room -= steps.get(low, 0)
    known = total.where(F.floor(F.log2("n")) >= low).toArrow()
    codes, n = (known.column(c).to_numpy() for c in ("code", "n"))
    order = np.argsort(codes)
    codes, n = codes[order].astype(dtype), n[order]
    first = n == best[codes.astype(np.int64) % many_b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("alignment_counts")
        for batch in batches:
            keys, links = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            ends = np.cumsum([len(x) for x in links]) // np.dtype(dtype).itemsize
            flat = np.frombuffer(b"".join(links), dtype)
            del links
            for lo in range(0, len(flat), 1 << 21):
                part = flat[lo : lo + (1 << 21)]
                row = np.searchsorted(ends, np.arange(lo, lo + len(part)), "right")
                at = np.minimum(np.searchsorted(codes, part), max(0, len(codes) - 1))
                hit = codes[at] == part if len(codes) else np.zeros(len(part), bool)
                rows, where = np.unique(row, return_inverse=True)
                yield pa.RecordBatch.from_pydict({"row_key": keys[rows], "code": pa.nulls(len(rows), pa.int64()), "m": pa.nulls(len(rows), pa.int64()), "b": np.bincount(where[hit], first[at[hit]], len(rows)).astype(np.int64), "s": summed(where[hit], n[at[hit]], len(rows))})
                pairs, m = np.unique(np.stack([row[~hit], part[~hit].astype(np.int64)]), axis=1, return_counts=True) if not hit.all() else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_pydict({"row_key": keys[pairs[0]], "code": pairs[1], "m": m, "b": np.zeros(len(m), np.int64), "s": np.zeros(len(m), np.int64)})

    rows = found.where("counts is null and n_links > 0").select("row_key", "links").mapInArrow(trimming(run), schema("row_key long, code long, m long, b long, s long"))
    rows = stored(rows, "links")
    rare = total.where(F.floor(F.log2("n")) < low)
    rare = rare.join(F.broadcast(top), F.col("code") % many_b == F.col("id")).select("code", "n", (F.col("n") == F.col("top")).cast("long").alias("is_best"))
    cold = rows.where("code is not null").join(rare, "code").select("row_key", (F.col("m") * F.col("is_best")).alias("b"), (F.col("m") * F.col("n")).alias("s"))
    return rows.where("code is null").select("row_key", "b", "s").unionByName(cold).groupBy("row_key").agg(F.sum("b").alias("n_best"), F.sum("s").alias("count_sum"))


def summed(which: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of integers by number; which ascends."""
    out = np.zeros(size, np.int64)
    if len(which):
        at = np.flatnonzero(np.diff(which, prepend=-1))
        out[which[at]] = np.add.reduceat(values, at)
    return out


def digests(docs: DataFrame, a: str | None = None, b: str | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256 of every row of docs; see aligned()
    for texts without tokens (zeros and '') and odd rows."""
    a, b = a or paths()[0], b or paths()[1]
    tool = Aligner(a, b)
    found = aligned(docs, a, b, counts=True).withColumn("groups_sha256", F.when(F.col("n_links") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    found = stored(found, "aligned", "zstd")
    total = stored(pair_counts(found, tool.dtype.str), "pairs")
    sums = ranked(found, total, tool.many_b, tool.dtype.str, hot)
    rows = found.where("counts is null").select("row_key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(sums, "row_key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op12_byte_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the piece vocabulary over every document."""
    return digests(documents(spark, sf_dir))
