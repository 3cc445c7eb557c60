"""Personal data: fixed patterns, and a linear-chain conditional random field that adds spans.

The field runs over words near a digit or one of `@ = +` (no entity lacks all of them, so other words stay outside by
construction). Its features are word shapes; it is trained from a small labelled table and decoded by Viterbi in numpy
batches. What it finds is added where it is plausible for its kind and overlaps no span of the patterns.
"""

from __future__ import annotations

import bisect
import functools
import random
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, put, schema, texts_of, trimming, turn

BASE_KINDS = ("email", "ip", "card", "phone")
#: In the order in which spans are listed; secret is the field's alone.
KINDS = (*BASE_KINDS, "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}
#: States: outside, then begin and inside of each kind.
STATES = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NEAR = re.compile(r"[0-9@=+]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each @ has one start, the beginning of the run of local characters before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        after = at + 1
        if at > end and text[at - 1] in _LOCAL and (m := _DOMAIN.match(text, at + 1)):
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            end = after = m.end()
            yield start, end
        at = text.find("@", after)


def plausible(kind: str, s: str) -> bool:
    digits = _DIGITS.sub("", s)
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "email":
        return "@" in s and "." in s
    return len(s) >= 20 and bool(digits)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed patterns, by kind and start; a match that fails its rule is dropped."""
    out = [("email", *x) for x in _emails(text)] if "@" in text else []
    for kind, pattern, sign in (("ip", _IP, "."), ("card", _CARD, ""), ("phone", _PHONE, "+")):
        if sign in text:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if plausible(kind, m.group())]
    return out


# --- the field -------------------------------------------------------------------------------------------------------

#: Words that stand beside personal data, in the four languages of the labelled table. Fixed values.
CUES = frozenset("token key password secret api tel phone fon telefon mobile call card visa carte karte tarjeta ip host server email mail correo courriel".split())


def _bucket(n: int) -> str:
    return next(str(b) for b in (0, 1, 2, 4, 8, 12, 19, 39, 10**9) if n <= b)


def attributes(word: str) -> tuple[str, ...]:
    """Word-shape features; those of words of up to 100 characters are remembered."""
    return _remembered(word) if len(word) <= 100 else _attributes(word)


def _attributes(word: str) -> tuple[str, ...]:
    bare = word.strip(".,;:!?\"'()[]{}<>|*#$%&")
    if word.isalpha() or bare.isalpha():
        return ("cue:" + bare.lower(),) if bare.lower() in CUES else ("plain",)
    kinds = re.sub(r"[^\W\d_]+", "x", re.sub(r"[0-9]+", "d", bare[:200]))
    digits = sum(map(str.isdigit, word))
    hexes = len(bare) >= 20 and all(c in "0123456789abcdefABCDEF" for c in bare)
    return (f"shape:{kinds[:24]}", f"digits:{_bucket(digits)}", f"length:{_bucket(len(bare))}", f"hex:{hexes}", f"at:{word.count('@')}", f"dots:{min(word.count('.'), 4)}", f"plus:{'+' in word}", f"paren:{word[:1] == '('}{word[-1:] == ')'}", f"dashes:{min(word.count('-'), 3)}", f"equals:{word == '='}", f"quoted:{word[:1] in ('\"', chr(39))}", f"mixed:{digits > 0 and any(map(str.isalpha, bare))}")


_remembered = functools.lru_cache(100_000)(_attributes)

Sentence = tuple[list[str], list[str]]


def labelled_table(n: int = 500, seed: int = 7) -> list[Sentence]:
    """A small labelled table (words, states), made from templates by a rule: entities in several forms, and numbers,
    versions, prices and dates that are none."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("the", "re", "on", "an", "th", "ei", "sch", "os", "ció", "ê", "ment", "la", "un")) for _ in range(r.randint(1, 4)))
    octet = lambda: str(r.randint(0, 255))
    code = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))

    def entity() -> tuple[str, list[str]]:
        kind = r.choice(KINDS)
        if kind == "email":
            return kind, [r.choice((f"{word()}.{d(2)}@mail{d(1)}.example.com", f"{word()}@{word()}.org", f"{word()}_{word()}@{word()}.co.uk"))]
        if kind == "ip":
            return kind, [".".join(octet() for _ in range(4))]
        if kind == "card":
            return kind, r.choice(([d(16)], [d(4), d(4), d(4), d(4)], ["-".join(d(4) for _ in range(4))], [".".join(d(4) for _ in range(4))]))
        if kind == "phone":
            return kind, r.choice((["+1", f"({d(3)})", f"{d(3)}-{d(4)}"], [f"({d(3)})", f"{d(3)}-{d(4)}"], [f"{d(3)}-{d(3)}-{d(4)}"], [f"+{d(2)}", d(3), d(3), d(3)], [f"{d(3)}.{d(3)}.{d(4)}"]))
        return kind, [r.choice((f'"{code(40)}"', code(40), f'"{code(32)}"', f"sk-{code(24)}"))]

    def other() -> list[str]:
        return r.choice(([d(r.randint(1, 7))], [f"{d(1)}.{d(1)}.{d(1)}"], [f"{d(2)}.{d(2)}"], [f"${d(3)}"], [f"{d(4)}-{d(2)}-{d(2)}"], ["x", "=", d(2)], ["v" + d(1)], [f"{d(2)}%"], [d(10)], [f"{d(4)}-{d(4)}"], [f"{word()}{d(2)}"], ["a", "+", "b"], ["@", word()], [f"({d(4)})"], [f"{d(2)}:{d(2)}"], [f"{d(1)},{d(3)},{d(3)}"]))

    out = []
    for _ in range(n):
        words, tags = [], []

        def add(ws: list[str], kind: str = "", words: list[str] = words, tags: list[str] = tags) -> None:
            words.extend(ws)
            tags.extend([("O" if not kind else f"{'BI'[i > 0]}-{kind}") for i in range(len(ws))])

        for _ in range(r.randint(1, 3)):
            add([word() + r.choice(("", "", "", ",", ".", " |".strip())) for _ in range(r.randint(1, 6))])
            if r.random() < 0.6:
                kind, ws = entity()
                if kind == "secret":
                    add([r.choice(("token", "key", "password")), "="])
                elif r.random() < 0.3:
                    add([r.choice(sorted(CUES))])
                if r.random() < 0.3:
                    ws = [*ws[:-1], ws[-1] + r.choice((".", ",", "###", "!!"))]
                add(ws, kind)
            else:
                add(other())
        add([word() for _ in range(r.randint(0, 4))])
        out.append((words, tags))
    return out


class Field:
    """A linear-chain conditional random field; fit() maximises the penalised likelihood by Adam steps in numpy."""

    def __init__(self) -> None:
        self.index: dict[tuple[int, str], int] = {}
        self.weights = np.zeros((0, len(STATES)))
        self.step = np.zeros((len(STATES), len(STATES)))
        self.scores: dict[tuple[str, ...], np.ndarray] = {}
        #: An inside state follows its own kind only.
        self.allowed = np.array([[b[0] != "I" or a[2:] == b[2:] for b in STATES] for a in STATES])
        self.first = np.array([s[0] != "I" for s in STATES])

    def fit(self, table: list[Sentence], steps: int = 80, rate: float = 0.25, penalty: float = 2e-3) -> Field:
        """table: at least one sentence; a sentence without words counts for nothing."""
        table = [s for s in table if s[0]]
        index = self.index
        rows: list[list[int]] = []
        for words, _ in table:
            for i in range(len(words)):
                rows.append([index.setdefault((o, a), len(index)) for o in (-1, 0, 1) if 0 <= i + o < len(words) for a in attributes(words[i + o])])
        n, t, long = len(table), len(STATES), max(len(w) for w, _ in table)
        at = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        feature = np.array([f for x in rows for f in x])
        lengths = np.array([len(w) for w, _ in table])
        mask = np.arange(long) < lengths[:, None]
        gold = np.zeros((n, long), int)
        gold[mask] = [STATES.index(s) for _, tags in table for s in tags]
        hot = np.zeros((n, long, t))
        hot[mask, gold[mask]] = 1
        pairs = np.einsum("nla,nlb->ab", hot[:, :-1] * mask[:, 1:, None], hot[:, 1:])
        params = [np.zeros((len(index), t)), np.zeros((t, t))]
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
        closed, shut = np.where(self.allowed, 0, -1e4), np.where(self.first, 0, -1e4)
        for k in range(1, steps + 1):
            emit = np.zeros((len(rows), t))
            np.add.at(emit, at, params[0][feature])
            e = np.zeros((n, long, t))
            e[mask] = emit
            trans = params[1] + closed
            alpha, beta = np.zeros((n, long, t)), np.zeros((n, long, t))
            alpha[:, 0] = e[:, 0] + shut
            for i in range(1, long):
                x = _logsum(alpha[:, i - 1, :, None] + trans, 1) + e[:, i]
                alpha[:, i] = np.where(mask[:, i, None], x, alpha[:, i - 1])
            for i in range(long - 2, -1, -1):
                x = _logsum(trans + (e[:, i + 1] + beta[:, i + 1])[:, None], 2)
                beta[:, i] = np.where(mask[:, i + 1, None], x, 0)
            z = _logsum(alpha[:, -1], 1)
            marginal = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
            seen = np.zeros((t, t))
            for i in range(1, long):
                seen += (np.exp(alpha[:, i - 1, :, None] + trans + (e[:, i] + beta[:, i])[:, None] - z[:, None, None]) * mask[:, i, None, None]).sum(0)
            diff = (hot - marginal)[mask]
            grads = [np.zeros_like(params[0]), pairs - seen]
            np.add.at(grads[0], feature, diff[at])
            for p, g, s in zip(params, grads, state, strict=True):
                g = g / n - penalty * p
                s[0] += 0.1 * (g - s[0])
                s[1] += 0.01 * (g * g - s[1])
                p += rate * (s[0] / (1 - 0.9**k)) / (np.sqrt(s[1] / (1 - 0.99**k)) + 1e-8)
        self.weights, self.step = params[0], params[1] + closed
        return self

    def _emission(self, word: str) -> np.ndarray:
        """Scores of a word for the states of the next word, its own and the previous one (as its features' offsets)."""
        key = attributes(word)
        got = self.scores.get(key)
        if got is None:
            got = np.zeros((3, len(STATES)))
            for k, o in enumerate((-1, 0, 1)):
                for a in key:
                    if (i := self.index.get((o, a))) is not None:
                        got[k] += self.weights[i]
            if len(self.scores) < 100_000:
                self.scores[key] = got
        return got

    def decode(self, sentences: list[list[str]]) -> list[list[int]]:
        """The best states of each sentence; sentences of like lengths share a batch."""
        out: list[list[int]] = [[] for _ in sentences]
        order = sorted((i for i, s in enumerate(sentences) if s), key=lambda i: len(sentences[i]))
        begin = 0
        while begin < len(order):
            # at most 512 sentences and 200,000 padded words together
            end = begin + 1
            while end < len(order) and end - begin < 512 and (end - begin + 1) * len(sentences[order[end]]) <= 200_000:
                end += 1
            group = order[begin:end]
            for i, path in zip(group, self._viterbi([sentences[i] for i in group]), strict=True):
                out[i] = path
            begin = end
        return out

    def _viterbi(self, sentences: list[list[str]]) -> list[list[int]]:
        n, long, t = len(sentences), len(sentences[-1]), len(STATES)
        e = np.zeros((n, long, t))
        for k, words in enumerate(sentences):
            s = np.array([self._emission(w) for w in words])
            e[k, : len(words)] = s[:, 1]
            e[k, 1 : len(words)] += s[:-1, 0]
            e[k, : len(words) - 1] += s[1:, 2]
        lengths = np.array([len(s) for s in sentences])
        best = e[:, 0] + np.where(self.first, 0, -1e4)
        back = np.zeros((n, long, t), np.int8)
        for i in range(1, long):
            x = best[:, :, None] + self.step
            back[:, i] = x.argmax(1)
            best = np.where((i < lengths)[:, None], x.max(1) + e[:, i], best)
        at = best.argmax(1)
        path = np.zeros((n, long), np.int8)
        for i in range(long - 1, -1, -1):
            inside = i < lengths
            path[:, i] = np.where(inside, at, 0)
            at = np.where(inside & (i > 0), back[np.arange(n), i, at], at)
        return [path[k, : lengths[k]].tolist() for k in range(n)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@functools.lru_cache(1)
def default_field() -> Field:
    return Field().fit(labelled_table())


#: Words of a window that are decoded together.
MOST = 2000


def windows(text: str, reach: int = 6) -> Iterator[tuple[list[tuple[int, int]], int, int]]:
    """(spans, begin, end): spans of the words within `reach` words of a word that has a digit, @, = or +; near ones join.

    A long window comes in pieces of bounded length: a piece's own words are begin .. end - 1, the others its neighbours'.
    """
    if not _NEAR.search(text):
        return
    before: list[tuple[int, int]] = []
    left = begin = 0  # left: words that the open window still takes
    open_: list[tuple[int, int]] = []
    for m in _WORD.finditer(text):
        span = m.span()
        if _NEAR.search(text, *span):
            if not open_:
                open_, before = before, []
            open_.append(span)
            left = 2 * reach
        elif left:
            open_.append(span)
            left -= 1
            if not left:
                yield open_[:-reach], begin, len(open_) - reach
                before, open_, begin = open_[-reach:], [], 0
        else:
            before = [*before[-reach + 1 :], span]
        if len(open_) >= MOST:
            yield open_, begin, len(open_) - reach
            open_, begin = open_[-2 * reach :], reach
    if open_:
        yield open_, begin, len(open_)


def find_spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """Of each text: (kind, start, end, whether by a pattern), by kind and start. Code points, end exclusive."""
    out: list[list[tuple[str, int, int, bool]]] = []
    taken = []
    for t in texts:
        base = base_spans(t)
        out.append([(*s, True) for s in base])
        taken.append(sorted((a, b) for _, a, b in base))
    waiting: list[tuple[int, list[tuple[int, int]], int, int]] = []
    size = 0
    reached = [0] * len(texts)  # where the field's last span of each text ends

    def decoded() -> None:
        states = field.decode([[texts[k][a:b] for a, b in w] for k, w, _, _ in waiting])
        for (k, spans, begin, end), path in zip(waiting, states, strict=True):
            i = 0
            while i < len(path):
                j = i + 1
                if path[i]:
                    kind = STATES[path[i]][2:]
                    while j < len(path) and STATES[path[j]] == f"I-{kind}":
                        j += 1
                    if begin <= i < end:
                        add(k, kind, spans[i][0], spans[j - 1][1])
                i = j
        waiting.clear()

    def add(k: int, kind: str, start: int, end: int) -> None:
        text = texts[k]
        while start < end and text[start] in "\"'<[{|*#$%&,;:":
            start += 1
        while end > start and text[end - 1] in "\"'>]}|*#$%&.,;:!?":
            end -= 1
        if start < reached[k] or not plausible(kind, text[start:end]):
            return
        at = bisect.bisect_left(taken[k], (end,)) - 1  # of the patterns' spans that begin before the end
        furthest = longest[k][at] if at >= 0 else 0
        if furthest <= start:
            out[k].append((kind, start, end, False))
            reached[k] = end

    longest = [list(accumulate((b for _, b in x), max)) for x in taken]
    for k, t in enumerate(texts):
        for w in windows(t):
            waiting.append((k, *w))
            size += len(w[0])
            if size >= 100_000:
                decoded()
                size = 0
    decoded()
    return [sorted(x, key=lambda s: (ORDER[s[0]], s[1])) for x in out]


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, found: array of (kind, start, end, base), by kind and start, of every row of docs.

    Text null is empty and holds nothing. Rows that repeat give the same; doc_id may be null or repeat; other columns
    are ignored. Whole texts of any length; no shuffle.
    """
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("pii_crf")
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            found = find_spans([t.decode("utf-8", "replace") for t in texts_of(batch.column(1))], field)
            yield put(batch, ["doc_id"], found=pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in x] for x in found], kind))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(trimming(run), schema("doc_id long, found array<struct<kind:string,start:int,end:int,base:boolean>>"))


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; of spans that overlap, the first counts.

    A null text stays null and an empty one empty; rows that repeat give the same; an empty table gives no rows. All other
    columns stay as they are.
    """
    field, at = field or default_field(), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("pii_crf")
        for batch in batches:
            column = batch.column(at)
            texts = [t.decode("utf-8", "replace") for t in texts_of(column)]
            new = [None if null else redact(t, s) for t, s, null in zip(texts, find_spans(texts, field), column.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, column.type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(trimming(run), docs.schema)


def redact(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    out, end = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def op3_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the patterns' spans, and all spans, of every document."""
    found = personal_data(documents(spark, sf_dir))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
