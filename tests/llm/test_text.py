"""Quality rules, personal data, SimHash and repeated passages against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import bwt, pii_crf, quality_cascade, simhash, suffix_dedup
from trackloom.llm.components import components

SPACE = r"[^\x20\x09-\x0D]+"


def brute_counts(text):
    text = text or ""
    words = re.findall(SPACE, text)
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                covered.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(docs, rows):
    got = {r["doc_id"]: r for r in quality_cascade.judge(docs).collect()}
    for i, t in rows:
        want = brute_counts(t)
        r = got[i]
        assert tuple(r[c] for c in quality_cascade.BASE) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert got[4]["kept"] and not got[28]["kept"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b"]), max_size=60))
def test_repeated_words(words):
    assert quality_cascade.repeated_words([w.encode() for w in words]) == brute_counts(" ".join(words))[4]


def test_order_does_not_change_the_verdict(docs, rows):
    kept = {r["doc_id"] for r in quality_cascade.filtered(docs).collect()}
    assert kept == {i for i, t in rows if quality_cascade.first_rejection(quality_cascade.Text((t or "").encode()), quality_cascade.RULES[::-1]) is None}


def test_quality_of_odd_and_empty_tables(odd, nothing):
    assert quality_cascade.judge(odd).count() == odd.count()
    assert quality_cascade.judge(nothing).count() == 0
    assert set(quality_cascade.filtered(odd).columns) == set(odd.columns)


def brute_spans(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(q) <= 255 for q in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and pii_crf.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab@@..12345 0-+(%_)é\n"), max_size=50))
def test_patterns(text):
    assert pii_crf.base_spans(text) == brute_spans(text)


def test_patterns_on_digits():
    r = random.Random(3)
    for _ in range(3000):
        x = "".join(r.choice("0123456789 -0123456789.+(") for _ in range(r.randint(10, 60)))
        assert pii_crf.base_spans(x) == brute_spans(x)


def test_patterns_are_linear():
    assert pii_crf.base_spans("a" * 200_000 + " @ " + "1" * 200_000) == []


def test_field_on_held_out_sentences():
    field = pii_crf.default_field()
    table = pii_crf.labelled_table(200, 123)
    pairs = [(a, pii_crf.STATES[b]) for (w, t), q in zip(table, field.decode([w for w, _ in table]), strict=True) for a, b in zip(t, q, strict=True)]
    assert np.mean([a == b for a, b in pairs]) > 0.98


def test_viterbi_is_the_best_path():
    from itertools import product

    field = pii_crf.default_field()
    words = ["call", "+1", "(555)"]
    e = np.array([field._emission(w) for w in words])

    def score(path):
        s = sum(e[i, 1, p] + (e[i - 1, 0, p] if i else 0) + (e[i + 1, 2, p] if i + 1 < len(words) else 0) for i, p in enumerate(path))
        return s + (0 if field.first[path[0]] else -1e4) + sum(field.step[a, b] for a, b in zip(path, path[1:], strict=False))

    best = max(product(range(len(pii_crf.STATES)), repeat=3), key=score)
    assert score(field.decode([words])[0]) == pytest.approx(score(best))


def test_personal_data(docs, rows):
    got = {r["doc_id"]: r["found"] for r in pii_crf.personal_data(docs).collect()}
    for i, t in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in got[i] if s["base"]] == brute_spans(t or "")
        assert [s for s in got[i] if not s["base"]] == [] or i == 24
    clean = pii_crf.redacted(docs).where("doc_id = 24").first()["text"]
    assert "<EMAIL>" in clean and "<PHONE>" in clean and "10.1.2.3" not in clean and "4111" not in clean


def test_field_adds_secrets():
    text = 'words token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and more words'
    assert [s[0] for s in pii_crf.find_spans([text], pii_crf.default_field())[0]] == ["secret"]


def test_personal_data_of_odd_and_empty_tables(odd, nothing):
    assert pii_crf.personal_data(odd).count() == odd.count()
    assert pii_crf.personal_data(nothing).count() == 0
    assert pii_crf.redacted(odd).where("text is null").count() == odd.where("text is null").count()


def brute_fingerprint(text):
    words = re.findall(SPACE, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(x):
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(x)):
        for j in range(i):
            if bin(x[i] ^ x[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


def test_near_duplicates(docs, rows):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(fps)
    for i, _ in rows:
        assert got[i]["fp"] & (1 << 64) - 1 == fps[i] and got[i]["component_id"] == root[i]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_links_in_a_dense_cluster(seed):
    r = random.Random(seed)
    x = {0x123456789ABCDEF0}
    while len(x) < 60:
        v = r.choice(sorted(x))
        for _ in range(r.randint(1, 5)):
            v ^= 1 << r.randrange(64)
        x.add(v)
    a = np.array(sorted(x), np.uint64)
    forest = simhash.Forest(len(a))
    forest.join(simhash.tree_of(a))
    assert [forest.root(i) for i in range(len(a))] == brute_components([int(v) for v in a])


def test_grid_join_finds_every_link(spark):
    r = random.Random(5)
    x = set()
    for _ in range(40):
        v = r.getrandbits(64)
        x.add(v)
        for _ in range(4):
            w = v
            for b in r.sample(range(64), 3):
                w ^= 1 << b
            x.add(w)
    x = sorted(x)
    table = spark.createDataFrame([(simhash._signed(v),) for v in x], "fp long")
    root = {r["node"]: r["root"] for r in components(simhash.links(table)).collect()}
    want = brute_components(x)
    for i, v in enumerate(x):
        for j in range(i):
            same = root.get(simhash._signed(v), v) == root.get(simhash._signed(x[j]), x[j])
            assert same == (want[i] == want[j])


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (700, 600), (600, 700)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {600: 600, 700: 600}


def test_near_duplicates_of_odd_and_empty_tables(odd, nothing):
    got = simhash.near_duplicates(odd)
    assert got.count() == odd.count() and got.where("doc_id < component_id").count() == 0
    assert simhash.near_duplicates(nothing).count() == 0


def brute_repeats(strings, depth):
    at = {}
    for i, s in enumerate(strings):
        for j in range(len(s) - depth + 1):
            at.setdefault(s[j : j + depth], set()).add((i, j))
    return sorted(sorted(v) for v in at.values() if len(v) > 1)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_transforms_merge_to_repeated_intervals(seed):
    r = random.Random(seed)
    alphabet = b"ab" if seed % 2 else b"abcdefgh "
    pool = [bytes(r.choice(alphabet) for _ in range(r.randint(5, 40))) for _ in range(5)]
    strings = [b"".join(r.choice(pool) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 25))]
    got = {}
    for s, o, b in zip(*(x.tolist() for x in bwt.repeated(strings, 20, r.randint(1, 5))), strict=True):
        got.setdefault(b, set()).add((s, o))
    assert sorted(map(sorted, got.values())) == brute_repeats(strings, 20)


def brute_removed(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 99):
            w = b[j : j + 100]
            if w in seen:
                gone[j : j + 100] = True
            seen.add(w)
        out.append((len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("split", [512, 2])
def test_repeated_passages(docs, rows, split, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1 if split == 2 else 8)
    got = {r["_k"]: r for r in suffix_dedup.removed(docs).collect()}
    for (i, _), (n, gone, kept) in zip(rows, brute_removed([t for _, t in rows]), strict=True):
        assert (got[i]["n_bytes"], got[i]["n_removed"], bytes(got[i]["kept"])) == (n, gone, kept)
        assert sum(s["end"] - s["start"] for s in got[i]["spans"]) == gone


def test_repeated_passages_of_odd_and_empty_tables(odd, nothing):
    got = suffix_dedup.removed(odd).orderBy("_k").collect()
    texts = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in odd.select("doc_id", "text").collect()))
    assert [(r["n_removed"], bytes(r["kept"])) for r in got] == [x[1:] for x in brute_removed([t for _, t in texts])]
    assert suffix_dedup.removed(nothing).count() == 0
