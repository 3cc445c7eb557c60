"""Token ids by the tokenizers library.

Texts are cut at ASCII white space. The vocabulary files with word ends drop white space before their merges and no
pattern of theirs crosses it, so a text's ids are those of its chunks, one after another. Each distinct chunk of a batch
is encoded once by the library, or found in a bounded cache; numpy puts the texts together. Other tokenizers encode
whole texts.
"""

from __future__ import annotations

import functools
import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import CACHES, put, schema, texts_of, trim, trimming, turn, without_cycles


class Encoder:
    """Ids as little-endian bytes of `dtype`: 16 bits if the vocabulary fits, else 32."""

    def __init__(self, path: str, kept: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype(width(path))
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.shown = dict(enumerate(byte_symbols()))
        self.chunked = cut_at_space(parts)
        #: What follows an ASCII letter as a word of its own.
        self.stops = {c: np.array(self.tokenizer.encode(c.decode(), add_special_tokens=False).ids, self.dtype).tobytes() for c in (b".", b",")}
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.cache = Cache(kept, self.dtype)

    def encode(self, texts: list[bytes], last: bytes = b"") -> tuple[np.ndarray, bytes]:
        """How many bytes of ids each text has, and all of them; `last` is added to each text's."""
        if not self.chunked:
            got = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            ids = [np.array(e.ids, self.dtype).tobytes() + last for e in got]
            return np.array([len(x) for x in ids], np.int64), b"".join(ids)
        data = b"\n".join([*texts, bytes(8)])
        starts, ends = chunks_of(np.frombuffer(data, np.uint8)[:-8])
        keys, which, first = kinds(data, starts, ends)
        size, flat = self._ids(data, keys, starts[first], ends[first])
        begin = np.cumsum(size) - size
        # each text's chunks, then its end
        borders = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
        which = np.insert(which, borders, len(size))
        wide = self.dtype.itemsize
        size, begin, flat = np.r_[size, len(last) // wide], np.r_[begin, len(flat)], np.r_[flat, np.frombuffer(last, self.dtype)]
        length = size[which]
        after = np.cumsum(length)
        at = np.repeat(begin[which] - after + length, length)
        at += np.arange(len(at))
        total = np.r_[0, after][borders + np.arange(1, len(texts) + 1)]
        return np.diff(np.r_[0, total]) * wide, flat[at].tobytes()

    def _ids(self, data: bytes, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each kind of chunk has, and all of them."""
        at, known = self.cache.find(keys)
        size, part = np.zeros(len(starts), np.int64), self.cache.part
        size[known] = self.cache.size[at[known]]
        asked = np.flatnonzero(~known)
        new = self._by_library([data[a:b] for a, b in zip(starts[asked].tolist(), ends[asked].tolist(), strict=True)])
        size[asked] = np.fromiter(map(len, new), np.int64, len(new)) // self.dtype.itemsize
        added = np.frombuffer(b"".join(new), self.dtype)
        source = np.empty(len(starts), np.int64)
        source[known] = self.cache.begin[at[known]]
        source[asked] = len(part) + np.cumsum(size[asked]) - size[asked]
        after = np.cumsum(size)
        where = np.repeat(source - after + size, size)
        where += np.arange(len(where))
        out = np.concatenate([part, added])[where]
        self.cache.add(keys[:, asked], size[asked], added)
        return size, out

    def _by_library(self, chunks: list[bytes]) -> list[bytes]:
        out: dict[bytes, bytes] = {}
        model, shown, kind, stops = self.tokenizer.model.tokenize, self.shown, self.kind, self.stops
        whole, stopped, lowered = [], [], {}
        for c in chunks:
            stem = c
            if c[-1:] in stops and c[-2:-1].isalpha():
                stopped.append(c)
                stem = c[:-1]
                if stem in out:
                    continue
            if stem.isalpha():
                low = stem.lower()  # the model is asked once for words that differ in case alone
                ids = lowered.get(low)
                if ids is None:
                    ids = lowered[low] = array(kind, [t.id for t in model(low.decode())]).tobytes()
                out[stem] = ids
            elif is_plain(stem):
                out[stem] = array(kind, [t.id for t in model(stem.decode().lower().encode().decode("latin-1").translate(shown))]).tobytes()
            else:
                out[stem] = b""
                whole.append(stem)
        for k in range(0, len(whole), 20_000):
            part = whole[k : k + 20_000]
            got = self.tokenizer.encode([c.decode("utf-8", "replace") for c in part], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, self.dtype).tobytes()
            ends = np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part))) * self.dtype.itemsize
            out.update(zip(part, [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], strict=True))
        for c in stopped:
            out[c] = out[c[:-1]] + stops[c[-1:]]
        return [out[c] for c in chunks]


class Cache:
    """Ids of chunks by their keys (see kinds()), in order; it starts anew when it would hold more than `most`."""

    def __init__(self, most: int, dtype: np.dtype):
        self.most, self.dtype = most, dtype
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros((5, 0), np.uint64)
        self.begin, self.size, self.part = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is there."""
        at = np.minimum(np.searchsorted(self.keys[0], keys[0]), max(0, self.keys.shape[1] - 1))
        return at, (self.keys[:, at] == keys).all(0) if self.keys.shape[1] else np.zeros(keys.shape[1], bool)

    def add(self, keys: np.ndarray, size: np.ndarray, part: np.ndarray) -> None:
        begin = np.cumsum(size) - size
        short = keys[4] <= LONG  # only those are told apart by their keys
        keys, size, begin = keys[:, short], size[short], begin[short]
        if self.keys.shape[1] + keys.shape[1] > self.most:
            self._empty()
        keys, begin, size = np.concatenate([self.keys, keys], 1), np.r_[self.begin, begin + len(self.part)], np.r_[self.size, size]
        order = np.argsort(keys[0], kind="stable")
        self.keys, self.begin, self.size = keys[:, order], begin[order], size[order]
        self.part = np.concatenate([self.part, part])


#: Bytes of text that are encoded together; numpy needs some thirty times as many for a moment.
TOGETHER = 4 << 20
_SPACES = np.zeros(256, bool)
_SPACES[list(b" \t\n\r\v\f")] = True
#: Bytes of a chunk that its key holds.
LONG = 24
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def chunks_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes without ASCII white space begin and end."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACES[data], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def kinds(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, which, first): of each chunk the number of its kind, and of each kind its key and first chunk, by key.

    A key is a hash, three times eight bytes (the first, the next and the last ones) and the length; up to LONG bytes it
    tells chunks apart. A longer chunk's middle bytes are a 64-bit digest. data ends with eight more bytes.
    """
    length = ends - starts
    eight = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint64, 1), (len(data) - 7,), (1,))
    parts = [eight[starts] & _KEPT[np.minimum(length, 8)], np.where(length > 8, eight[np.minimum(starts + 8, len(eight) - 1)] & _KEPT[np.clip(length - 8, 0, 8)], np.uint64(0)), np.where(length > 16, eight[np.maximum(ends - 8, 0)], np.uint64(0))]
    for i in np.flatnonzero(length > LONG).tolist():
        parts[1][i] = xxh3_64_intdigest(data[starts[i] : ends[i]])
    h = length.astype(np.uint64)
    for x, mix in zip(parts, _MIX, strict=True):
        h = (h ^ x) * mix
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    by = h[order]
    new = np.r_[True, by[1:] != by[:-1]][: len(by)]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    keys = np.stack([h, *parts, length.astype(np.uint64)])
    if not all((k == k[first][which]).all() for k in keys[1:]):  # two kinds with one hash
        _, first, which = np.unique(keys, axis=1, return_index=True, return_inverse=True)
    return keys[:, first], which, first


def is_plain(chunk: bytes) -> bool:
    """Whether a chunk is of Latin letters whose lower case is one letter: the normalizer would only lower it, and the
    split leave it whole, so the library's model can be asked at once."""
    if chunk.isalpha():
        return True
    text = chunk.decode("utf-8", "replace")
    return text.isalpha() and max(text) < "\u0250" and "\u0130" not in text


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def cut_at_space(parts: dict) -> bool:
    """Whether a tokenizer file drops white space, treats what it divides apart, and ends words between letters and others."""
    pre = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    kinds = {n.get("type") for n in (parts.get("normalizer") or {}).get("normalizers", [])}
    added = [t["content"] for t in parts.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or t["content"].isalpha() or len(t["content"].split()) != 1]
    split = pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and (pre[0].get("pattern") or {}).get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    return kinds <= {"NFC", "Replace", "Lowercase"} and split and not added and parts["model"].get("end_of_word_suffix") == "</w>"


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process and file, so that the cache lasts from task to task."""
    return Encoder(path)


def sliced(texts: list[bytes], most: int = TOGETHER) -> Iterator[list[bytes]]:
    """Neighbours of about `most` bytes together, or one longer text; one empty slice if there are none."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[begin:i]
            begin, size = i, 0
        size += len(t)
    yield texts[begin:]


CACHES["tokens"] = encoder.cache_clear


def tokens(docs: DataFrame, path: str | None = None, end: int | None = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, n_tokens long and ids of every row of docs: its token ids and then the id `end`, if one is given.

    ids is binary, little-endian, of 16-bit integers where the vocabulary fits, else of 32-bit ones (see width()).
    Text null is empty.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("tokens")
        coder = encoder(path)
        last = b"" if end is None else np.array([end], coder.dtype).tobytes()
        for batch in batches:
            texts = texts_of(batch.column(len(keep)))
            with without_cycles():
                parts = [coder.encode(part, last) for part in sliced(texts)]
            sizes, ids = np.concatenate([s for s, _ in parts]), b"".join([x for _, x in parts])
            del parts
            trim()
            borders = pa.py_buffer(np.cumsum(np.r_[0, sizes]).astype(np.int32))
            yield put(batch, list(keep), n_tokens=pa.array(sizes // coder.dtype.itemsize), ids=pa.Array.from_buffers(pa.binary(), len(sizes), [None, borders, pa.py_buffer(ids)]))

    docs = docs.select(*keep, "text")
    return docs.mapInArrow(trimming(run), T.StructType([*docs.schema.fields[:-1], *schema("n_tokens long, ids binary").fields]))


@functools.lru_cache(4)
def width(path: str) -> str:
    """The type of ids: 16 bits where all fit. Read from the file, without loading the tokenizer."""
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    vocabulary = parts["model"]["vocab"]
    size = max([*(vocabulary.values() if isinstance(vocabulary, dict) else range(len(vocabulary))), *(t["id"] for t in parts.get("added_tokens", []))], default=0)
    return "<u2" if size < 1 << 16 else "<u4"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
