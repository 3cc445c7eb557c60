"""BPE encoding and decoding by prefix-sharing trie traversal.

A word's encoding is fixed by the last token of each of its prefixes: token t ends prefix p if t is a suffix of p, and
BPE leaves the pair (last token of p without t, t) as it is. The distinct words of a batch, in order, are the paths of a
trie: words that begin alike are neighbours, and a node is the run of words that share its prefix. The walk goes down
from the root, all nodes of a depth at once in numpy, and carries the last tokens along the paths, so that what words share
at their beginning is encoded once. Words of over LEVELS bytes are walked one after another, each from the node where it
leaves the one before it.

The symbols are the 256 bytes inside a word and the 256 bytes at its end (with the end-of-word suffix).
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, documents, put, schema, texts_of, trimming, turn, without_cycles
from .encoding import byte_symbols, default_path, sliced

END = "</w>"
#: Bytes of text whose new words share a trie.
TOGETHER = 2 << 20
#: Bytes of the longest word that is walked with all others, and the pairs of tokens that a worker remembers.
LEVELS, PAIRS = 48, 1 << 20
#: Unicode's White_Space, as the vocabulary's normalizer has it.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class TrieBPE:
    """Encodes and decodes with a tokenizer file of byte-level BPE with word ends and dropped white space."""

    def __init__(self, path: str, kept: int = 200_000):
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model = parts["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or model.get("continuing_subword_prefix"):
            raise ValueError("a BPE vocabulary with word ends is needed")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.text_of = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        symbols = byte_symbols()
        #: Of each token: its symbols (a byte b inside is chr(b), at the end chr(256 + b)), and how it is merged.
        self.string = {vocab[s]: chr(b) for b, s in enumerate(symbols)} | {vocab[s + END]: chr(256 + b) for b, s in enumerate(symbols)}
        self.made: dict[int, tuple[int, int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, new = vocab[a], vocab[b], vocab[a + b]
            self.merges[left, right] = rank
            self.made[new] = (rank, left, right)
            self.string[new] = self.string[left] + self.string[right]
        self.token = {}
        for t, s in self.string.items():
            if t not in self.made or self._stays(self.made[t][1], self.made[t][2], self.made[t][0]):
                self.token[s] = t
        shown = [f" {self.text_of[i]}".encode() if i in self.text_of else b"" for i in range(max(self.text_of) + 1)]
        self.shown, self.shown_size = np.frombuffer(b"".join(shown), np.uint8), np.array([len(x) for x in shown])
        self.shown_begin = np.cumsum(self.shown_size) - self.shown_size
        self._automaton()
        ranks = sorted((a << 20 | b, r) for (a, b), r in self.merges.items())
        self.pair, self.rank = np.array([p for p, _ in ranks], np.int64), np.array([r for _, r in ranks], np.float64)
        #: Of each token: the rank of the merge that makes it (-1: a symbol) and its two parts.
        self.parts = np.full((3, max(self.string) + 1), -1, np.int64)
        for t, x in self.made.items():
            self.parts[:, t] = x
        #: Pairs of tokens asked about before, by a hash, and whether they stay apart; single words' answers.
        self.asked, self.apart, self.fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool), {}
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.plain_words = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kept, self.young, self.old = kept, {}, {}

    def _stays(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether BPE, run on the two tokens' symbols, never merges across their border by a merge ranked under `before`.

        Merges are undone from the last to the first; at each point the two tokens at the border must not have been
        mergeable earlier than what was done next. At equal ranks the left one of two places is merged first.
        """
        limit = before
        while True:
            rank = self.merges.get((left, right))
            if rank is not None and rank < limit:
                return False
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 0.5, b[1]

    def _automaton(self) -> None:
        """States: the beginnings of tokens. Of each: the state of its longest proper end that is one (fall), its token or
        -1, the symbols that it has, and the longest proper end that is a token (up, -1: none)."""
        self.goto: dict[int, int] = {}
        token, size, path = [-1], [0], [("", 0)]
        for s, t in self.token.items():
            at = 0
            for k, c in enumerate(s):
                key = at << 9 | ord(c)
                at = self.goto.get(key, -1)
                if at < 0:
                    at = self.goto[key] = len(token)
                    token.append(-1)
                    size.append(k + 1)
                    path.append((c, key >> 9))
            token[at] = t
        fall, up, goto = [0] * len(token), [-1] * len(token), self.goto
        for s in sorted(range(1, len(token)), key=size.__getitem__):
            c, parent = path[s]
            if parent:
                at = fall[parent]
                while (found := goto.get(at << 9 | ord(c))) is None and at:
                    at = fall[at]
                fall[s] = found or 0
            up[s] = fall[s] if token[fall[s]] >= 0 else up[fall[s]]
        self.token_of, self.size_of, self.fall, self.up = (np.array(x, np.int32) for x in (token, size, fall, up))
        keys = np.array(sorted(goto), np.int64)
        self.goto_keys, self.goto_states = keys, np.array([goto[k] for k in keys.tolist()], np.int32)

    def _steps(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states: the longest end of the path that begins a token."""
        out, todo = np.zeros(len(state), np.int32), np.arange(len(state))
        while len(todo):
            key = state.astype(np.int64) << 9 | symbol
            at = np.minimum(np.searchsorted(self.goto_keys, key), len(self.goto_keys) - 1)
            found = self.goto_keys[at] == key
            out[todo[found]] = self.goto_states[at[found]]
            more = ~found & (state > 0)
            todo, symbol, state = todo[more], symbol[more], self.fall[state[more]]
        return out

    def _stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_stays() of many pairs, remembered."""
        key = left.astype(np.int64) << 20 | right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) & (PAIRS - 1)
        out, new = self.apart[slot], self.asked[slot] != key
        if new.any():
            asked, back = np.unique(key[new], return_inverse=True)
            ok = np.zeros(len(asked), bool)
            todo, a, b, limit = np.arange(len(asked)), asked >> 20, asked & ((1 << 20) - 1), np.full(len(asked), np.inf)
            while len(todo):
                both = a << 20 | b
                at = np.minimum(np.searchsorted(self.pair, both), len(self.pair) - 1)
                merged = (self.pair[at] == both) & (self.rank[at] < limit)
                ra, rb = self.parts[0, a], self.parts[0, b]
                ok[todo[~merged & (ra < 0) & (rb < 0)]] = True
                on = ~merged & ((ra >= 0) | (rb >= 0))
                todo, a, b, ra, rb = todo[on], a[on], b[on], ra[on], rb[on]
                first = ra > rb
                limit = np.where(first, ra, rb + 0.5)
                a, b = np.where(first, self.parts[2, a], a), np.where(first, b, self.parts[1, b])
            ok = ok[back.reshape(-1)]
            self.asked[slot[new]], self.apart[slot[new]] = key[new], ok
            # two new pairs of one slot: the last one stays there, and each has its own answer here
            out[new] = ok
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the words has (distinct, not empty, in ascending order), and all ids."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero(length <= LEVELS)
        got = [self._walk([words[i] for i in short.tolist()], length[short])] if len(short) else []
        size = np.zeros(len(words), np.int64)
        if len(short):
            size[short] = got[0][0]
        if len(short) == len(words):
            return size, got[0][1] if got else np.zeros(0, np.uint32)
        long = np.flatnonzero(length > LEVELS).tolist()
        ids = dict(zip(long, self._walk_long([words[i] for i in long]), strict=True))
        ends = np.cumsum(size)
        parts, at = [], 0
        for i in long:
            end = int(ends[i])
            parts += [got[0][1][at:end] if got else np.zeros(0, np.uint32), ids[i]]
            at = end
            size[i] = len(ids[i])
        return size, np.concatenate([*parts, got[0][1][at:] if got else np.zeros(0, np.uint32)])

    def _walk(self, words: list[bytes], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode_words() of words that are not long: a level of the trie at a time."""
        n, levels = len(words), int(length.max())
        begin = np.cumsum(length) - length
        data = np.frombuffer(b"".join(words), np.uint8)
        node, state = np.zeros(n, np.int64), np.zeros(n, np.int32)  # of each word: its node of the level before
        last, size = np.zeros((levels, n), np.int32), np.zeros((levels, n), np.int32)
        on = np.arange(n)
        for d in range(levels):
            on = on[length[on] > d] if d else on
            symbol = data[begin[on] + d].astype(np.int64)
            symbol += (length[on] == d + 1) << 8
            new = np.r_[True, (symbol[1:] != symbol[:-1]) | (node[on[1:]] != node[on[:-1]])]
            of = np.cumsum(new) - 1
            first = on[new]
            states = self._steps(state[first], symbol[new])
            at = np.where(self.token_of[states] >= 0, states, self.up[states])
            tokens, sizes = np.empty(len(first), np.int32), np.empty(len(first), np.int32)
            todo = np.arange(len(first))
            while len(todo):
                t, m = self.token_of[at], self.size_of[at]
                ok = (m == d + 1) | (self.up[at] < 0)
                ask = np.flatnonzero(~ok)
                ok[ask] = self._stay(last[d - m[ask], first[todo[ask]]], t[ask])
                tokens[todo[ok]], sizes[todo[ok]] = t[ok], m[ok]
                todo, at = todo[~ok], self.up[at[~ok]]
            last[d, on], size[d, on] = tokens[of], sizes[of]
            node[on], state[on] = of, states[of]
        # from each word's end to its beginning
        at, on, found = length - 1, np.arange(n), []
        total = np.zeros(n, np.int64)
        while len(on):
            found.append((on, last[at, on]))
            total[on] += 1
            at = at - size[at, on]
            more = at >= 0
            on, at = on[more], at[more]
        out, ends = np.empty(int(total.sum()), np.uint32), np.cumsum(total)
        for k, (on, t) in enumerate(found):
            out[ends[on] - 1 - k] = t
        return total, out

    def _walk_long(self, words: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each word, in order; what a word shares with the one before it is not walked again."""
        last, size, states = array("i", [-1]), array("i", [0]), array("i", [0])  # of the prefixes along the path
        before = b""
        goto, fall, up, token_of, size_of, fits = self.goto, self.fall, self.up, self.token_of, self.size_of, self.fits
        for word in words:
            most = min(len(before), len(word)) - 1  # a word's last symbol is its own
            a, b = np.frombuffer(before, np.uint8)[: max(most, 0)], np.frombuffer(word, np.uint8)[: max(most, 0)]
            apart = np.flatnonzero(a != b)
            depth = int(apart[0]) if len(apart) else max(most, 0)
            del last[depth + 1 :], size[depth + 1 :], states[depth + 1 :]
            state = states[-1]
            for d in range(depth, len(word)):
                symbol = word[d] if d + 1 < len(word) else word[d] + 256
                while (new := goto.get(state << 9 | symbol)) is None and state:
                    state = int(fall[state])
                state = new or 0
                at = state if token_of[state] >= 0 else int(up[state])
                while True:
                    t, n, more = int(token_of[at]), int(size_of[at]), int(up[at])
                    if n == d + 1 or more < 0:
                        break
                    pair = (last[d + 1 - n], t)
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) > 100_000:
                            fits.clear()
                        ok = fits[pair] = self._stays(*pair)
                    if ok:
                        break
                    at = more
                last.append(t)
                size.append(n)
                states.append(state)
            ids, at = array("I"), len(word)
            while at:
                ids.append(last[at])
                at -= size[at]
            yield np.frombuffer(ids, np.uint32)[::-1]
            before = word

    def _pieces(self, chunk: str) -> Iterator[int | bytes]:
        """Special tokens' ids and words of a chunk without ASCII white space."""
        for i, part in enumerate(self.specials.split(chunk) if self.specials else [chunk]):
            if i % 2:
                yield self.special[part]
            elif part.isascii():
                yield from self.plain_words.findall(part.lower().encode())
            else:
                part = "".join([c.lower() for c in unicodedata.normalize("NFC", part)])
                for word in self.words.findall(part):
                    yield word.encode()

    def _encode_chunks(self, chunks: list[bytes]) -> Iterator[tuple[bytes, tuple[bytes, bytes]]]:
        """Of each chunk: its ids' bytes, and what they decode to with a space before each token."""
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        pieces, several = [], []
        stops = {b".", b","} - {s.encode() for s in self.special}
        for c in chunks:
            if c.isalpha():
                pieces.append(number[c.lower()])
            elif c[-1:] in stops and c[:-1].isalpha():
                several.append((len(pieces), 2))
                pieces += (number[c[:-1].lower()], number[c[-1:]])
            else:
                cut = list(self._pieces(c.decode("utf-8", "replace")))
                several.append((len(pieces), len(cut)))
                pieces += [~p if isinstance(p, int) else number[p] for p in cut]
        words = list(number)
        order = sorted(range(len(words)), key=words.__getitem__)
        count_, ids = self.encode_words([words[i] for i in order])
        place = np.empty(len(words) + 1, np.int64)
        place[order] = np.arange(len(words))
        piece = np.array(pieces, np.int64)
        special = piece < 0
        # a special token is one more word of one id, behind the others
        starts = np.r_[np.cumsum(count_) - count_, len(ids) + np.arange(int(special.sum()))]
        flat = np.r_[ids, (~piece[special]).astype(np.uint32)]
        at = np.where(special, len(words) + np.cumsum(special) - 1, place[np.where(special, -1, piece)])
        sizes = np.r_[count_, np.ones(int(special.sum()), np.int64)][at]
        flat = flat[_ranges(starts[at], sizes)]
        after = np.r_[0, np.cumsum(sizes)]
        # chunks' borders among the pieces: one piece each, but for those of several or none
        per = np.ones(len(chunks), np.int64)
        if several:
            where, n = np.array(several).T
            extra = np.cumsum(n - 1) - (n - 1)
            per[where - extra] = n
        border = after[np.r_[0, np.cumsum(per)]]
        wide = self.shown_size[flat]
        decoded = self.shown[_ranges(self.shown_begin[flat], wide)].tobytes()
        shown = np.r_[0, np.cumsum(wide)][border].tolist()
        data, border = flat.astype("<u4").tobytes(), (4 * border).tolist()
        for k, c in enumerate(chunks):
            yield c, (data[border[k] : border[k + 1]], decoded[shown[k] : shown[k + 1]])

    def encode(self, texts: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Of each text: its ids as little-endian unsigned 32-bit integers, and the text that these decode to."""
        split = [t.split() for t in texts]
        wanted: set[bytes] = set()
        for chunks in split:
            wanted.update(chunks)
        young = self.young
        missing = [c for c in wanted if c not in young]
        if missing:
            if len(young) + len(missing) > self.kept:
                self.old, self.young = young, {c: young[c] for c in wanted if c in young}
                young = self.young
            old = self.old
            new = [c for c in missing if c not in old]
            young.update((c, old[c]) for c in missing if c in old)
            new.sort()
            for i in range(0, len(new), 20_000):
                young.update(self._encode_chunks(new[i : i + 20_000]))
        ids, decoded = [], []
        for chunks in split:
            got = [young[c] for c in chunks]
            ids.append(b"".join([x for x, _ in got]))
            decoded.append(b"".join([x for _, x in got])[1:])
        return ids, decoded

    def decode(self, ids: Iterable[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False) of a file without decoder: tokens joined by spaces."""
        return " ".join([self.text_of[i] for i in ids if i in self.text_of])


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin .. begin + size - 1 of each, one after another."""
    after = np.cumsum(size)
    out = np.repeat(begin - after + size, size)
    out += np.arange(len(out))
    return out


@functools.lru_cache(1)
def trie_bpe(path: str) -> TrieBPE:
    with without_cycles(keep=True):
        return TrieBPE(path)


CACHES["trie"] = trie_bpe.cache_clear


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit integers), decoded (string) of every row of docs.

    Text null is empty: no ids, decoded to the empty text. Rows that repeat are encoded each; doc_id may be null or
    repeat; other columns are ignored. A long text without white space is one path, walked in memory in
    proportion to it. No shuffle: a batch's
    distinct words share a trie, and a bounded cache keeps frequent chunks from batch to batch.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("trie")
        coder = trie_bpe(path)
        for batch in batches:
            ids, decoded = [], []
            for part in sliced(texts_of(batch.column(1)), TOGETHER):
                with without_cycles(keep=True):
                    new = coder.encode(part)
                ids += new[0]
                decoded += new[1]
            yield put(batch, ["doc_id"], ids=pa.array(ids, pa.binary()), decoded=pa.array([d.decode("utf-8", "replace") for d in decoded], pa.string()))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(trimming(run), schema("doc_id long, ids binary, decoded string"))


def op10_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each document."""
    coded = encode_documents(documents(spark, sf_dir))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
