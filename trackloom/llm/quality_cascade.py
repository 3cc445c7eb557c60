"""Quality rules in a short-circuit cascade.

A rule rejects a text or lets it pass. On a sample each rule's cost and share of rejections are measured; the cascade
asks the rules in descending order of rejections per cost and stops at the first that rejects. A text is kept if no rule
rejects it, so the order decides the time only, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, put, schema, texts_of, trimming, turn

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Text:
    """What the rules ask of a text; each is computed when first asked for."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.data.decode("utf-8", "replace")) - sum(map(self.data.count, (b" ", b"\t", b"\n", b"\r", b"\v", b"\f")))

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.data.count(s) for s in SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        """Those with a word."""
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def n_upper_words(self) -> int:
        return sum(map(bytes.isupper, self.words))

    @cached_property
    def n_letters(self) -> int:
        """ASCII letters and all that is not ASCII, in bytes."""
        a = np.frombuffer(self.data, np.uint8)
        low = a | 0x20
        return int(np.count_nonzero((a >= 128) | ((low >= 97) & (low <= 122))))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of eight that are found twice or more in the text, the first finding included."""
    n = len(words)
    if n <= window:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    for step, mix in zip((1, 2, 4), _MIX, strict=True):
        h = h[:-step] * mix + h[step:]
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    found = np.zeros(n + 1, np.int64)
    first = 0
    for i in np.flatnonzero(same).tolist():  # equal hashes, one after another, by position
        a, b = int(order[i]), int(order[i + 1])
        if i == 0 or not same[i - 1]:
            first = a
        if words[first : first + window] == words[b : b + window]:
            for x in (first, b):
                found[x] += 1
                found[x + window] -= 1
    return int(np.count_nonzero(np.cumsum(found)[:n] > 0))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]
    #: Of the contract's base: such a rule alone decides base_failed.
    base: bool = False


RULES = (
    Rule("few words", lambda t: t.n_words < 20, base=True),
    Rule("repeated passages", lambda t: 100 * t.n_repeat_words > 30 * t.n_words, base=True),
    Rule("symbols for words", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("shouting", lambda t: 2 * t.data.count(b"!") > t.n_words or 2 * t.n_upper_words > t.n_words),
    Rule("repeated lines", lambda t: t.n_dup_lines >= 5 and 2 * t.n_dup_lines > len(t.lines)),
    Rule("word length", lambda t: not 2 * t.n_words <= t.word_chars <= 30 * t.n_words),
    Rule("few letters", lambda t: 2 * t.n_letters < len(t.data) - t.data.count(b" ")),
)


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> list[tuple[str, float, float]]:
    """Of each rule: its name, seconds a text and share of texts rejected, over a sample of at most sample_rows rows.

    The sample decides the order of the rules and nothing else. Without rows, every rule costs and rejects the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("quality_cascade")
        spent, rejected, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for data in texts_of(batch.column(0)):
                n += 1
                for k, rule in enumerate(rules):
                    text, began = Text(data), time.perf_counter()
                    rejected[k] += rule.rejects(text)
                    spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"k": list(range(len(rules))), "s": spent, "r": rejected, "n": [n] * len(rules)})

    rows = docs.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0).select("text").limit(sample_rows).mapInArrow(trimming(run), schema("k long, s double, r long, n long")).groupBy("k").agg(F.sum("s").alias("s"), F.sum("r").alias("r"), F.sum("n").alias("n")).collect()
    of = {r["k"]: (r["s"] / r["n"], r["r"] / r["n"]) for r in rows if r["n"]}
    return [(rule.name, *of.get(k, (1.0, 1.0))) for k, rule in enumerate(rules)]


def ordered(rules: tuple[Rule, ...], of: list[tuple[str, float, float]]) -> tuple[Rule, ...]:
    """By rejections per cost, most first; ties as listed."""
    worth = {name: share / max(cost, 1e-9) for name, cost, share in of}
    return tuple(sorted(rules, key=lambda r: -worth[r.name]))


def first_rejection(text: Text, cascade: tuple[Rule, ...]) -> Rule | None:
    return next((rule for rule in cascade if rule.rejects(text)), None)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row of docs.

    Text null is empty: no words, so it fails the base. Rows that repeat are judged each; doc_id may be null or repeat;
    an empty table gives no rows; other columns are ignored. Whole texts of any length; no shuffle.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cascade = ordered(rules, measured(docs, rules, sample_rows))
    base, more = [r for r in rules if r.base], tuple(r for r in cascade if not r.base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("quality_cascade")
        for batch in batches:
            counts: dict[str, list] = {c: [] for c in BASE}
            failed, kept = [], []
            for text in map(Text, texts_of(batch.column(1))):
                for c in BASE:
                    counts[c].append(getattr(text, c))
                failed.append(any(r.rejects(text) for r in base))
                kept.append(not failed[-1] and first_rejection(text, more) is None)
            yield put(batch, ["doc_id"], **{c: pa.array(v, pa.int64()) for c, v in counts.items()}, base_failed=pa.array(failed, pa.bool_()), kept=pa.array(kept, pa.bool_()))

    return docs.mapInArrow(trimming(run), schema("doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean"))


def filtered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns; the cascade stops at the first rejection."""
    cascade = ordered(rules, measured(docs, rules, sample_rows))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("quality_cascade")
        for batch in batches:
            yield batch.filter(pa.array([first_rejection(Text(t), cascade) is None for t in texts_of(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(trimming(run), docs.schema)


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return judge(documents(spark, sf_dir))
