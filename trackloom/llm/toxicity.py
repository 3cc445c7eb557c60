"""Toxicity of texts whose words may be disguised.

A noisy channel: a writer means a word, and writes letters as digits or signs that look like them, hides letters behind
stars, puts signs or spaces between letters, and repeats letters. A character lattice holds what each written character may
stand for; Viterbi decoding under a trigram model of characters, counted over all documents, restores the word. Restored
words are scored: a word's weight is the greatest log ratio of its features (the word and its beginnings of 4 to 6
characters) among toxic and other labelled documents, and a logistic model turns a document's greatest weights into a
probability.

A word that the channel can't have made from another one is itself and is not decoded: one of letters only, without three
equal ones in a row or two doubled ones. Spaced letters are three or more words of one character in a row; where words begin
in them is unknown, so each place in their restored text counts as a beginning.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, configured, documents, schema, stored, texts_of, trimming, turn

#: What a written character may stand for, besides itself.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Signs that may stand between letters, and those that may hide one.
BETWEEN, HIDES = " .-_,~'`·", "*#"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Costs in natural logarithms: a look-alike, a hidden letter, a sign left out, a repeated letter, a sign that is meant.
LIKE, HIDDEN, LEFT_OUT, AGAIN, MEANT = 2.0, 3.5, 1.0, 1.0, 6.0
#: Codes of the character model: 0 for a border, 26 letters, 27 for signs and digits, 32 for other letters.
CODES = 60
PREFIXES = (4, 5, 6)
#: Labels to learn from at most, a bounded sample of the labelled rows, as a table that every task holds (some 10 MB).
LABELS = 500_000
#: Toxic groups of texts that a feature needs; features known to every task at most; labelled rows the logistic model is
#: fitted on at most (the least hashes of doc_id); greatest weights it sees.
LEAST, FEATURES, ROWS, TOP = 5, 1 << 17, 20_000, 3
THRESHOLD = 0.7

_TABLE = np.full(0x250, 27, np.uint8)
for _c in range(0x250):
    if chr(_c).isalpha():
        _TABLE[_c] = 28 + _c % 32 if _c > 127 else 1 + (ord(chr(_c).lower()) - 97)
    elif chr(_c).isspace():
        _TABLE[_c] = 0


def code_of(c: str) -> int:
    return int(_TABLE[ord(c)]) if ord(c) < 0x250 else 28 + ord(c) % 32 if c.isalpha() else 27


def trigrams(texts: list[str]) -> np.ndarray:
    """Counts of the codes of three characters in a row, (CODES,) * 3; two borders stand before a text, one after it."""
    points = np.frombuffer(("  " + " \n ".join(texts) + " ").encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(points < 0x250, _TABLE[np.minimum(points, 0x24F)], 28 + points % 32).astype(np.int64)
    codes = codes[~((codes == 0) & (np.r_[1, codes[:-1]] == 0) & (np.r_[1, 1, codes[:-2]] == 0))] if len(codes) > 2 else codes  # a longer gap is two
    at = (codes[:-2] * CODES + codes[1:-1]) * CODES + codes[2:]
    return np.bincount(at, minlength=CODES**3)


def log_model(n: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probability of a code after two others: mixed from three, two and one codes."""
    n = n.reshape((CODES,) * 3).astype(np.float64)
    one, two = n.sum((0, 1)) + 1, n.sum(0)
    p1 = one / one.sum()
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    return np.log((n + 5 * p2[None]) / (n.sum(2, keepdims=True) + 5))


def character_counts(docs: DataFrame) -> np.ndarray:
    """trigrams() over all texts of docs, lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("toxicity")
        n = np.zeros(CODES**3, np.int64)
        for batch in batches:
            for part in neighbours([t.decode("utf-8", "replace").lower() for t in texts_of(batch.column(0))]):
                n += trigrams(part)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"at": at, "n": n[at]})

    got = docs.select("text").mapInArrow(trimming(run), schema("at long, n long")).groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(CODES**3, np.int64)
    n[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return n


def neighbours(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts of about `most` characters together; a longer one is cut, two characters in common."""
    held: list[str] = []
    size = 0
    for t in texts:
        for k in range(0, max(1, len(t)), most):
            piece = t[max(0, k - 2) : k + most]
            if size + len(piece) > most and held:
                yield held
                held, size = [], 0
            held.append(piece)
            size += len(piece)
    if held:
        yield held


class Channel:
    """Restores what was meant by what was written."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def options(self, c: str) -> list[tuple[str, float]]:
        """What c may stand for, with costs; '' is a sign that is left out."""
        if c == " ":
            return [("", LEFT_OUT), (" ", 0.0)]
        if c.isalpha():
            return [(c, 0.0)]
        if c in HIDES:
            return [(x, HIDDEN) for x in LETTERS] + [("", LEFT_OUT), (c, MEANT)]
        if c in LOOKS:
            return [(x, LIKE) for x in LOOKS[c]] + [("", LIKE + LEFT_OUT), (c, MEANT)]
        return [("", LEFT_OUT if c in BETWEEN else MEANT), (c, MEANT)]

    def restored(self, written: str) -> str:
        """The most probable text; of equally probable ones the first in alphabetical order. Empty gives empty."""
        # a state is the codes of the last two characters that are meant; with it, its cost, text and last character
        states: dict[tuple[int, int], tuple[float, tuple, str]] = {(0, 0): (0.0, (), "")}
        model = self.model
        for c in written:
            found: dict[tuple[int, int], tuple[float, tuple, str]] = {}
            choices = [(x, cost, code_of(x) if x else -1) for x, cost in self.options(c)]
            for (two, one), (cost, path, last) in states.items():
                row = model[two][one]
                for x, more, code in choices:
                    ways = []
                    if not x:
                        ways.append(((two, one), (cost + more, path, last)))
                    else:
                        ways.append(((one, code), (cost + more - row[code], (path, x), x)))
                        if x == last and x != " ":
                            ways.append(((two, one), (cost + more + AGAIN, path, last)))
                    for state, way in ways:
                        old = found.get(state)
                        if old is None or way[0] < old[0] or (way[0] == old[0] and text_of(way[1]) < text_of(old[1])):
                            found[state] = way
            states = found
        ends = [(cost - model[two][one][0], text_of(path)) for (two, one), (cost, path, _) in states.items()]
        return min(ends)[1]


def text_of(path: tuple) -> str:
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


_TAIL = ".,;:?!\"')]}%&#*-_$@+|~>/\\"
_HEAD = ".,;:?\"'[{)]}%&#*-_~</\\"
_DISGUISED = re.compile(r"[^\W\d_][0-9@$!|+(€£¡*#.\-_,~'`·]+|[0-9@$!|+(€£¡*#]+[^\W\d_]|([^\W\d_])\1\1|([^\W\d_])\2.*([^\W\d_])\3").search


def core(word: str) -> str:
    """A word without the signs around it that no letter hides behind."""
    return word.rstrip(_TAIL).lstrip(_HEAD)


def features(word: str) -> list[str]:
    """A word and its beginnings, marked as such; none if it is empty."""
    return [word, *(word[:k] + "~" for k in PREFIXES if len(word) >= k)] if word else []


def spaced(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Where three or more words of one character follow one another."""
    single = np.r_[False, lengths == 1, False]
    edge = np.flatnonzero(single[1:] != single[:-1])
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= 3]


@dataclass
class Words:
    """Words met by a worker, each restored once: their features, or with weights their greatest weight."""

    channel: Channel
    weights: dict[str, float] | None = None
    number: defaultdict[str, int] = field(default_factory=lambda: defaultdict(count().__next__))
    names: list[str] = field(default_factory=list)
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    most: int = 300_000

    def meant(self, word: str) -> list[str]:
        """The restored words that a written one stands for, as it stands alone."""
        word = core(word)
        return [core(x) for x in self.channel.restored(word).split()] if _DISGUISED(word) else [word]

    def weight(self, words: list[str]) -> float:
        get = self.weights.get
        return max((get(f, 0.0) for w in words for f in features(w)), default=0.0)

    def numbered(self, text: str) -> np.ndarray:
        """Numbers of the text's words, in order."""
        words = text.lower().split()
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if (more := len(self.number) - len(self.names)) > 0:
            begin, new = len(self.names), list(islice(reversed(self.number), more))[::-1]
            self.names += new
            if len(self.names) > len(self.size):  # room for as many again
                self.size, self.value = (np.concatenate([x, np.zeros(len(self.names), x.dtype)]) for x in (self.size, self.value))
            self.size[begin : begin + more] = list(map(len, new))
            if self.weights is not None:
                self.value[begin : begin + more] = [self.weight(self.meant(w)) for w in new]
        return ids

    def joined(self, ids: np.ndarray) -> list[list[str]]:
        """Of each run of spaced letters, the words that may begin in it."""
        out = []
        for a, b in spaced(self.size[ids]):
            text = self.channel.restored(" ".join(self.names[i] for i in ids[a:b].tolist())).replace(" ", "")
            out.append(sorted({text[k : k + max(PREFIXES)] for k in range(len(text) - min(PREFIXES) + 1)}))
        return out

    def features_of(self, text: str) -> tuple[set[str], int]:
        """All features of a text, and its key: the least hash of five words in a row, which near-copies share mostly."""
        ids = self.numbered(text)
        found = {f for i in set(ids.tolist()) for w in self.meant(self.names[i]) for f in features(w)}
        found.update(f for words in self.joined(ids) for w in words for f in features(w))
        names = [self.names[i] for i in ids.tolist()]
        key = min((xxhash.xxh3_64_intdigest(" ".join(names[k : k + 5])) for k in range(max(1, len(names) - 4))), default=0)
        self.forget()
        return found, key >> 1

    def greatest(self, text: str, top: int = TOP) -> list[float]:
        """The greatest weights of different words of the text, in descending order; 0 where there are fewer."""
        ids = self.numbered(text)
        value = self.value[ids]
        at = np.flatnonzero(value > 0)
        best = {int(i): float(v) for i, v in zip(ids[at], value[at], strict=True)}
        got = sorted([*best.values(), *(w for words in self.joined(ids) if (w := self.weight(words)) > 0)], reverse=True)[:top]
        self.forget()
        return got + [0.0] * (top - len(got))

    def forget(self) -> None:
        if len(self.names) > self.most:
            self.number, self.names = defaultdict(count().__next__), []
            self.value, self.size = np.zeros(0), np.zeros(0, np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is not to be learned from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, most: int = LABELS) -> DataFrame:
    """(doc_id, text, toxic) of the rows to learn from. A label that is null or neither 0 nor 1 is none; of several labels
    of one id the greatest counts; ids that repeat among docs count each.

    The labels go to all tasks, so that no text is moved. Of more than `most` labels to learn from, those of the least
    hashes of doc_id are taken, by a bound on the hash that leaves some 19 of 20 of `most`.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    if (n := known.count()) > most:
        known = known.where(F.xxhash64("doc_id") < int(-(2**63) + 2**64 * 0.95 * most / n))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out(F.col("doc_id"))).join(F.broadcast(known), "doc_id")


def toxic_features(rows: DataFrame, model: np.ndarray, least: int = LEAST, most: int = FEATURES) -> dict[str, int]:
    """In how many groups of near-copies among the toxic rows each feature is, where that is `least` or more. If over
    `most` are, the least count rises (by powers of two) until they are no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("toxicity")
        words = Words(channel_of(model))
        for batch in batches:
            for t in texts_of(batch.column(0)):
                found, key = words.features_of(t.decode("utf-8", "replace"))
                if found:
                    yield pa.RecordBatch.from_pydict({"f": sorted(found), "g": pa.array([key] * len(found), pa.int64())})

    seen = rows.where("toxic = 1").select("text").mapInArrow(trimming(run), schema("f string, g long")).distinct().groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    seen = stored(seen, "features")
    step = F.floor(F.log2(F.col("n") / least)).cast("int")
    sizes = {r["k"]: r["c"] for r in seen.groupBy(step.alias("k")).agg(F.count("*").alias("c")).collect()}
    low, room = max(sizes, default=0) + 1, most
    while low and room >= sizes.get(low - 1, 0):
        low -= 1
        room -= sizes.get(low, 0)
    return {r["f"]: r["n"] for r in seen.where(step >= low).collect()}


def other_features(rows: DataFrame, model: np.ndarray, names: list[str]) -> np.ndarray:
    """In how many of the rows that are not toxic each named feature is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("toxicity")
        at = {f: k for k, f in enumerate(names)}
        words, n = Words(channel_of(model), {f: 1.0 for f in names}), np.zeros(len(names), np.int64)
        which: dict[str, list[int]] = {}
        for batch in batches:
            for t in texts_of(batch.column(0)):
                ids = words.numbered(t.decode("utf-8", "replace"))
                found: set[int] = set()
                for i in np.unique(ids[words.value[ids] > 0]).tolist():
                    w = words.names[i]
                    if w not in which:
                        which[w] = [at[f] for m in words.meant(w) for f in features(m) if f in at]
                    found.update(which[w])
                found.update(at[f] for run_ in words.joined(ids) for w in run_ for f in features(w) if f in at)
                n[list(found)] += 1
                words.forget()
                if len(which) > words.most:
                    which.clear()
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"k": there, "n": n[there]})

    got = rows.where("toxic = 0").select("text").mapInArrow(trimming(run), schema("k long, n long")).groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(names), np.int64)
    n[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return n


_CHANNEL: dict[bytes, Channel] = {}


def channel_of(model: np.ndarray) -> Channel:
    """One for each worker process and model."""
    key = xxhash.xxh3_64_digest(model.tobytes())
    if key not in _CHANNEL:
        _CHANNEL.clear()
        _CHANNEL[key] = Channel(model)
    return _CHANNEL[key]


CACHES["toxicity"] = _CHANNEL.clear


@dataclass
class Scorer:
    """What scores texts: the character model, the weights of features, and the logistic model."""

    model: np.ndarray
    weights: dict[str, float]
    slope: np.ndarray

    def probability(self, greatest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(inputs(greatest) @ self.slope)))


def inputs(greatest: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(greatest)), greatest])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Slopes of a logistic model by Newton steps, the first column without penalty."""
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [penalty] * (x.shape[1] - 1)) * len(x)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + keep @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, gradient)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def fitted(docs: DataFrame, labels: DataFrame, rows: int = ROWS, least: int = LEAST, most: int = FEATURES, sample: int = LABELS) -> Scorer:
    """Learns from docs (all of them, for characters) and labels (of rows that are not held out, `sample` at most, for words).

    The weight of a feature, log((a + .5) / (A + 1)) - log((b + .5) / (B + 1)), has a of A groups of toxic near-copies and
    b of B other rows; negative ones are dropped. The logistic model is fitted on the `rows` rows of the least hashes of
    doc_id at most (and others of the last one's doc_id). Without rows of both labels every text gets the share of toxic rows, 0 if there are none.
    """
    model = log_model(character_counts(docs))
    known = stored(labelled(docs, labels, sample), "labelled")
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not (n.get(0) and n.get(1)):
        share = 1 - 1e-9 if n.get(1) else 1e-9
        return Scorer(model, {}, np.r_[np.log(share / (1 - share)), np.zeros(TOP)])
    toxic = toxic_features(known, model, least, most)
    names = sorted(toxic)
    a, b = np.array([toxic[f] for f in names], np.float64), other_features(known, model, names)
    weight = np.log((a + 0.5) / (max(a.max(initial=0), 1) + 1)) - np.log((b + 0.5) / (n[0] + 1))
    weights = {f: float(w) for f, w in zip(names, weight, strict=True) if w > 0}
    few = known
    if sum(n.values()) > rows:  # by a bound, so that the rows stay where they are
        bound = known.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
        few = known.where(F.xxhash64("doc_id") <= bound)
    got = evidence(few, Scorer(model, weights, np.zeros(TOP + 1)), "toxic").toArrow()
    y, x = got.column("toxic").to_numpy(), np.stack([got.column(f"w{k}").to_numpy() for k in range(TOP)], 1)
    return Scorer(model, weights, logistic(inputs(x), y))


def evidence(docs: DataFrame, scorer: Scorer, *keep: str) -> DataFrame:
    """The columns keep and w0, w1, ... of every row of docs: the greatest weights of its text's restored words. Text null
    is empty."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    model, weights = scorer.model, scorer.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("toxicity")
        words = Words(channel_of(model), weights)
        for batch in batches:
            got = np.array([words.greatest(t.decode("utf-8", "replace")) for t in texts_of(batch.column(len(keep)))]).reshape(batch.num_rows, TOP)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(got[:, k]) for k in range(TOP))], [*keep, *(f"w{k}" for k in range(TOP))])

    return docs.select(*keep, "text").mapInArrow(trimming(run), schema(", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"w{k} double" for k in range(TOP))])))


def scored(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.7) of every row of docs.

    Text null is empty; an empty text has no words and is scored by that. Rows that repeat are scored each, a null doc_id
    is held out, an empty table gives no rows, and other columns are ignored; see labelled() for odd labels. Texts of any
    length are read whole. The character model and the features go to the tasks, both of bounded size.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scorer = fitted(docs, labels, **options)
    z = F.lit(float(scorer.slope[0]))
    for k in range(TOP):
        z = z + F.col(f"w{k}") * F.lit(float(scorer.slope[1 + k]))
    score = (1 / (1 + F.exp(-z))).alias("score")
    return evidence(docs, scorer, "doc_id").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op11_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the table labels."""
    return scored(documents(spark, sf_dir), configured(spark).read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
