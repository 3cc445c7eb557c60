"""Embeddings, WARC derivatives, language-model scores and the pipeline against brute force."""

import gzip
import importlib.util
import json
import math
import os
import random
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import gru, lm_scoring, rp_forest, warc

SCHEMA = "vec_id long, embedding array<float>, label int, leaf string"


def brute_links(vectors):
    n = len(vectors)
    linked = [[False] * n for _ in range(n)]
    for i, (_, a, la) in enumerate(vectors):
        for j, (_, b, lb) in enumerate(vectors):
            if i == j or la is None or la != lb or a is None or b is None or len(a) != len(b):
                continue
            if any(x is None or not math.isfinite(x) for x in [*a, *b]) or not any(a) or not any(b):
                continue
            x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
            linked[i][j] = bool(x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98)
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if linked[i][j] and root[j] < root[i]:
                    root[i], changed = root[j], True
    return [sum(r) for r in linked], root


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    base = r.normal(size=(30, 16))
    out = [(i, base[i % 30] + r.normal(0, 0.04, 16) * (i >= 30), int(i % 3)) for i in range(150)]
    out = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in out]
    return out + [(200, out[0][1], 0), (201, out[0][1], 0), (202, out[0][1], None), (203, None, 1), (204, [0.0] * 16, 1), (205, [float("nan")] * 16, 1), (206, [None] + [1.0] * 15, 1), (207, [1.0, 2.0], 1), (208, [2.0, 4.0], 1)]


@pytest.mark.parametrize("leaf,most", [(1000, 3000), (8, 10)])
def test_near_vectors(spark, vectors, leaf, most, monkeypatch):
    monkeypatch.setattr(rp_forest, "LEAF", leaf)
    monkeypatch.setattr(rp_forest, "MOST", most)
    table = spark.createDataFrame([(*v, "z") for v in vectors], SCHEMA)
    got = {r["vec_id"]: r for r in rp_forest.near_vectors(table).collect()}
    links, root = brute_links(vectors)
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.97 * sum(links) if leaf == 8 else found == sum(links)
    for (i, *_), n, k in zip(vectors, links, root, strict=True):
        assert got[i]["n_links"] <= n
        if leaf == 1000:
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, vectors[k][0], vectors[k][0] == i)


def test_near_vectors_of_odd_and_empty_tables(spark, vectors):
    odd = spark.createDataFrame([(None, vectors[0][1], 0, "z"), (7, vectors[0][1], 0, "z"), (7, vectors[0][1], 0, "z")], SCHEMA)
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in rp_forest.near_vectors(odd).collect()) == [(-1, 2, 7), (7, 2, 7), (7, 2, 7)]
    assert rp_forest.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_copies_of_a_large_label_are_all_found(spark):
    """Beyond LEAF: a dense group that a narrow spill would cut through, and copies of scattered vectors at the threshold."""
    r = np.random.default_rng(8)
    dense = r.normal(size=16) + r.normal(0, 0.11, (3500, 16))
    far = np.repeat(r.normal(size=(1500, 16)), 2, 0)
    far[1::2] += r.normal(0, 0.2, (1500, 16))
    x = np.concatenate([dense, far]).astype(np.float32)
    u = rp_forest.unit(x.astype(float))
    linked = u @ u.T >= 0.98
    np.fill_diagonal(linked, False)
    table = spark.createDataFrame([(i, v, 1, "z") for i, v in enumerate(x.tolist())], SCHEMA)
    got = {q["vec_id"]: q["n_links"] for q in rp_forest.near_vectors(table).collect()}
    assert [got[i] for i in range(len(x))] == linked.sum(1).tolist()


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in warc.HIDDEN
        if tag in warc.BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in warc.HIDDEN
        if tag in warc.BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


HTML = '<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no --><p class="x>y">One &lt;two&gt; <b>bold</b><br>three</p><script>if (a < b) {}</script><a href="/x?a=1&amp;b=2">link</a> 5 < 6</body></html>'


def test_text_of_pages():
    p = Plain()
    p.feed(HTML)
    p.close()
    want = "\n".join(x for x in (" ".join(line.split()) for line in "".join(p.out).split("\n")) if x)
    page = warc.page_of(HTML)
    assert page.text == want and page.title == "A & B" and page.links == ["/x?a=1&b=2"]
    for odd in ("", "<", "<p", "<script>never ends", "<!-- never", "a" * 10_000, "<" * 10_000):
        warc.page_of(odd)


def test_derivatives(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", HTML, "x"), (2, None, None, "x"), (1, "http://a.example/", HTML, "x")], "page_id long, url string, html string, warc string")
    made = warc.responses(pages)
    got = warc.derived(made).orderBy("page_id").collect()
    assert [r["page_id"] for r in got] == [1, 1, 2] and got[0] == got[1] and all(r["digest_ok"] for r in got)
    source = next(warc.read_records(bytes(made.where("page_id = 1").first()["warc"])))
    meta, text = (next(warc.read_records(bytes(got[0][c]))) for c in ("metadata", "conversion"))
    for record in (meta, text):
        assert record.get("WARC-Refers-To") == source.get("WARC-Record-ID") == got[0]["response_id"]
        assert record.get("WARC-Block-Digest") == warc.digest(record.block) and record.get("WARC-Target-URI") == "http://a.example/"
    envelope = json.loads(meta.block)
    assert [tuple(h) for h in envelope["WARC-Header-Metadata"]] == source.headers and envelope["Digest-Mismatch"] == []
    assert text.block.decode() == warc.page_of(HTML).text


def test_pages_with_open_elements_and_many_titles():
    assert warc.page_of("<html><head><title>T</title><body><p>Body text here</p></body></html>").text == "Body text here"
    assert warc.page_of("<head><style>p{}</style><p>no end of the head").text == "no end of the head"
    assert warc.page_of("<title>never ends <p>x").title == "never ends <p>x"
    for odd in ("<title " * 40_000, '<a ">"' * 40_000, "<title><b>" * 40_000, "<script " * 40_000):
        begin = time.perf_counter()
        warc.page_of(odd)
        assert time.perf_counter() - begin < 2


PLAIN = "<p>café Ελλάδα</p>"


@pytest.mark.parametrize(
    ("fields", "body", "want"),
    [
        ("Content-Type: text/html; charset=iso-8859-1", b"<p>caf\xe9</p>", "café"),
        ("Content-Type: text/html", b'<meta charset="windows-1253"><p>\xc5\xeb</p>', "Ελ"),
        ("Content-Type: text/html; charset=no-such-thing", PLAIN.encode(), "café Ελλάδα"),
        ("Content-Type: text/html; charset=hex", PLAIN.encode(), "café Ελλάδα"),
        ("Content-Type: text/html;\r\n charset=latin-1", b"<p>caf\xe9</p>", "café"),
        ("Transfer-Encoding: chunked", b"5;x=1\r\n<p>hi\r\n3\r\n ho\r\n0\r\n\r\n", "hi ho"),
        ("Transfer-Encoding: chunked", b"<p>undone before</p>", "undone before"),
        ("Transfer-Encoding: chunked", b"5\r\n<p>hi\r\nzz\r\n", "hi"),
        ("Content-Encoding: gzip", gzip.compress(PLAIN.encode()) + gzip.compress(b"<p>x"), "café Ελλάδα\nx"),
        ("Content-Encoding: gzip", gzip.compress(random.Random(1).randbytes(9000).hex().encode())[:4000], None),
        ("Content-Encoding: gzip", PLAIN.encode(), "café Ελλάδα"),
        ("Content-Encoding: deflate", zlib.compress(PLAIN.encode()), "café Ελλάδα"),
        ("Content-Encoding: deflate", zlib.compress(PLAIN.encode())[2:-4], "café Ελλάδα"),
        ("Content-Encoding: br", b"\x8b\x01", ""),
    ],
)
def test_payloads_are_decoded(fields, body, want):
    record = warc.Record([("WARC-Type", "response")], b"HTTP/1.1 200 OK\r\n" + fields.encode() + b"\r\n\r\n" + body)
    got = warc.derivatives(record)[1].block.decode()
    assert got == want if want is not None else len(got) > 1000


def test_files_of_records_whole_packed_and_cut():
    good = warc.response("u", b"<p>x</p>", "d").to_bytes()
    assert [r.block for r in warc.read_records(gzip.compress(good) + gzip.compress(good))] == [next(warc.read_records(good)).block] * 2
    assert len(list(warc.read_records(good + good[:-10]))) == 1 and not list(warc.read_records(good[:60]))
    folded = good.replace(b"WARC-Target-URI: u", b"WARC-Target-URI: u\r\n\tv")
    assert next(warc.read_records(folded)).get("WARC-Target-URI") == "u v"


def test_odd_pages(spark):
    """A null id, equal addresses with other pages, and a page of some MB."""
    pages = [(None, "u", "<p>a"), (1, "u", "<p>b"), (2, "u", "<p>" + "long " * 600_000)]
    got = warc.derived(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    assert len({r["response_id"] for r in got}) == 3 and {r["page_id"] for r in got} == {None, 1, 2}
    assert max(len(r["conversion"]) for r in got) > 2_900_000


def test_records_that_are_none_or_damaged(spark):
    good = warc.response("u", b"<p>x</p>", "d").to_bytes()
    wrong = good.replace(b"<p>x", b"<p>y")
    request = good.replace(b"WARC-Type: response", b"WARC-Type: request")
    table = spark.createDataFrame([(1, good + request + good), (2, wrong), (3, b"junk"), (4, None)], "page_id long, warc binary")
    got = warc.derived(table).collect()
    assert sorted((r["page_id"], r["digest_ok"]) for r in got) == [(1, True), (1, True), (2, False)]
    assert warc.derived(table.limit(0)).count() == 0


def test_gradients_are_right():
    import types

    with open(gru.__file__) as f:
        source = f.read().replace("np.float32", "np.float64")
    m = types.ModuleType("gru64")
    import sys

    sys.modules["gru64"] = m
    exec(compile(source, "gru64", "exec"), m.__dict__)
    shape, r = m.Shape(words=8, classes=2, rest=3, hidden=4), np.random.default_rng(0)
    w = {k: v + r.normal(0, 0.3, v.shape) for k, v in m.initial(shape).items()}
    codes, begins, real = r.integers(0, 11, (6, 3)), np.zeros((6, 3), bool), np.ones((6, 3), bool)
    begins[0] = begins[3, 1] = True
    real[5, 2] = False
    h = r.normal(size=(3, 4))
    g = m.gradients(w, shape, codes, begins, real, h)[0]
    for k in w:
        for _ in range(4):
            i, e = tuple(r.integers(0, n) for n in w[k].shape), 1e-5
            up, down = ({q: v.copy() for q, v in w.items()} for _ in range(2))
            up[k][i] += e
            down[k][i] -= e
            assert abs((m.gradients(up, shape, codes, begins, real, h)[2] - m.gradients(down, shape, codes, begins, real, h)[2]) / 2 / e - g[k][i]) < 1e-8


def test_state_is_carried_and_probabilities_sum_to_one():
    shape, r = gru.Shape(words=8, classes=2, rest=3, hidden=4), np.random.default_rng(1)
    w = gru.initial(shape)
    docs = [r.integers(0, 11, r.integers(1, 40)) for _ in range(9)]
    alone = [gru.scores(w, shape, [d], lanes=1, window=3)[0] for d in docs]
    assert np.allclose(gru.scores(w, shape, docs, lanes=4, window=5), alone, atol=1e-4)
    before = r.normal(size=(1, 4)).astype(np.float32).repeat(11, 0)
    assert np.exp(gru.token_scores(w, shape, before, np.arange(11))).sum() == pytest.approx(1, abs=1e-5)


def test_training_helps():
    shape = gru.Shape(words=8, classes=2, rest=3, hidden=8)
    docs = [np.tile([0, 1, 2, 3], 50) for _ in range(40)]
    w = gru.initial(shape)
    better = gru.trained(w, shape, docs, rate=0.05, passes=5)
    assert gru.scores(better, shape, docs[:1])[0] > 0.2 * gru.scores(w, shape, docs[:1])[0]


@pytest.mark.parametrize("sizes", [[20_000, *[300] * 40], [9000], [5, 2048, 2049, 1], [4100] * 70])
def test_every_code_is_trained_once(sizes, monkeypatch):
    shape, r = gru.Shape(words=8, classes=2, rest=3, hidden=4), np.random.default_rng(2)
    docs, seen, plain = [r.integers(0, 11, n) for n in sizes], np.zeros(11, int), gru.gradients

    def counting(w, shape, codes, begins, real, h):
        np.add.at(seen, codes[real], 1)
        return plain(w, shape, codes, begins, real, h)

    monkeypatch.setattr(gru, "gradients", counting)
    w = gru.trained(gru.initial(shape), shape, docs)
    assert seen.tolist() == np.bincount(np.concatenate(docs), minlength=11).tolist()
    assert all(np.isfinite(x).all() for x in w.values())


def brute_scores(rows):
    words = {i: [*(t or "").encode().lower().split(), lm_scoring.END] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter(w for i, x in words.items() if not held[i] for w in x)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)) for i, x in words.items()}


@pytest.mark.parametrize("block", [16 << 20, 500])
def test_base_scores(docs, rows, block, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block)
    want = brute_scores(rows)
    got = lm_scoring.scored(docs, share=1).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, train, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0 and math.isfinite(r["score"])


def test_every_training_document_is_trained(docs, monkeypatch):
    taken, plain = [], lm_scoring.stored

    def keeping(df, what, *more):
        out = plain(df, what, *more)
        if what == "weights":
            taken.append(out.agg(F.sum("n")).first()[0])
        return out

    monkeypatch.setattr(lm_scoring, "stored", keeping)
    train = lm_scoring.scored(docs).first()["train_tokens"]
    assert train and set(taken) == {train}


def test_scores_of_odd_and_empty_tables(odd, nothing):
    assert lm_scoring.scored(odd).where("score < 0").count() == odd.count()
    assert lm_scoring.scored(nothing).count() == 0


def _pipeline():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", os.path.join(os.path.dirname(__file__), "..", "..", "corpus_pipeline.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_pipeline_stages_against_plain_versions(spark, docs, rows):
    from tests.llm.test_text import brute_components, brute_fingerprint, brute_removed
    from tests.llm.test_tokens import held
    from trackloom.llm import packing, pii_crf, quality_cascade

    p = _pipeline()
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "passages", "personal_data", "packed"]
    state, table = dict(rows), docs.withColumn("row_key", F.lit("clash"))
    for name, stage in p.STAGES[:-1]:
        table = stage(spark, table, "")
        got = {r["doc_id"]: r for r in table.collect()}
        assert table.columns == [*docs.columns, "row_key"]
        if name == "quality":
            state = {i: t for i, t in state.items() if t is not None and quality_cascade.first_rejection(quality_cascade.Text(t.encode()), quality_cascade.RULES) is None}
        elif name == "near_duplicates":
            ids = sorted(state)
            root = brute_components([brute_fingerprint(state[i]) for i in ids])
            state = {i: state[i] for k, i in enumerate(ids) if root[k] == k}
        elif name == "passages":
            ids = sorted(state)
            state = {i: kept.decode("utf-8", "ignore") for i, (_, _, kept) in zip(ids, brute_removed([state[i] for i in ids]), strict=True)}
        else:
            state = {i: pii_crf.redact(t, pii_crf.find_spans([t], pii_crf.default_field())[0]) for i, t in state.items()}
        assert {i: r["text"] for i, r in got.items()} == state
        assert all(r["n_chars"] == len(r["text"]) for r in got.values())
        table = spark.createDataFrame(table.collect(), table.schema)
    held(packing.packed(table).collect(), sorted(state.items()))
    assert p.STAGES[-1][1](spark, table, "").count() >= len(state)


def test_pipeline_on_odd_and_empty_tables(spark, odd, nothing):
    p = _pipeline()
    for table in (odd, nothing):
        for _, stage in p.STAGES:
            table = stage(spark, table, "")
            table = spark.createDataFrame(table.collect(), table.schema)


def test_pipeline_stages_keep_clashing_columns(spark, rows):
    names = ("row_key", "row_key_kept", "row_key_null", "kept_text", "null_text", "Kept_Text2", "component_id", "key")
    data = [(i, t, *[f"{n}{i}" for n in names]) for i, t in rows[:14]] + [(None, rows[2][1] + " more", *names), (3, rows[4][1] + " again", *names)]
    table = spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in _pipeline().STAGES[:-1]:
        before = table
        table = stage(spark, table, "")
        assert table.columns == before.columns, name
        table = spark.createDataFrame(table.collect(), table.schema)
    got = {tuple(r)[2:] for r in table.collect()}
    assert got and got <= {x[2:] for x in data}


@pytest.mark.parametrize("n,most", [(5000, 0.35), (20_000, 0.12)])
def test_the_forest_compares_a_falling_share_of_all_pairs(n, most):
    """Pairs that share a leaf, repeats across trees included, over all pairs of one label; and a bounded number of leaves a
    row."""
    x = rp_forest.unit(np.random.default_rng(1).normal(size=(n, 64)))
    depth = rp_forest.depth_of(n, rp_forest.LEAF, n)
    trees = [rp_forest.Tree.fitted(x, np.zeros(n, int), 1.0, rp_forest.LEAF, depth, rp_forest.part_of(depth, rp_forest.TREES), np.random.default_rng(k)) for k in range(2)]
    found = [t.leaves(x) for t in trees]
    pairs = sum(int((c * (c - 1) // 2).sum()) for c in (np.bincount(leaf) for _, leaf in found)) * rp_forest.TREES / len(trees)
    assert pairs < most * n * (n - 1) / 2
    assert sum(len(r) for r, _ in found) / len(found) < 5 * n


def test_a_pair_at_the_threshold_is_parted_as_seldom_as_stated():
    """Scattered pairs and a dense group: a tree parts no more of them than all trees together may."""
    r = np.random.default_rng(2)
    far = (2 - 2 * rp_forest.COSINE) ** 0.5
    base = rp_forest.unit(np.concatenate([r.normal(size=(3000, 64)), r.normal(size=64) + r.normal(0, 0.2, (3000, 64))]))
    other = r.normal(size=base.shape)
    other = rp_forest.unit(other - (other * base).sum(1)[:, None] * base)
    near = rp_forest.unit(base * (1 - far**2 / 2) + other * (1 - (1 - far**2 / 2) ** 2) ** 0.5)
    x = np.concatenate([base, near])
    depth = rp_forest.depth_of(len(x), 64, len(x))
    tree = rp_forest.Tree.fitted(x, np.zeros(len(x), int), 1.0, 64, depth, rp_forest.part_of(depth, 8), np.random.default_rng(3))
    row, leaf = tree.leaves(x)
    held = [set() for _ in x]
    for i, k in zip(row.tolist(), leaf.tolist(), strict=True):
        held[i].add(k)
    parted = np.mean([not held[i] & held[i + len(base)] for i in range(len(base))])
    assert len(set(leaf.tolist())) > 30 and parted <= rp_forest.LOSS ** (1 / 8)


def test_labels_of_any_type(spark):
    """Not-a-number is a label like others, and batches end within runs."""
    x = np.random.default_rng(4).normal(size=(40, 8)).tolist()
    table = spark.createDataFrame([(i, x[i % 40], float("nan") if i % 2 else 1.5) for i in range(120)], "vec_id long, embedding array<double>, label double")
    assert {(r["vec_id"] % 40, r["n_links"], r["component_id"]) for r in rp_forest.near_vectors(table).collect()} == {(i, 2, i) for i in range(40)}


def test_scores_do_not_depend_on_lanes_and_windows():
    import inspect

    from trackloom.llm import gru

    r, shape = np.random.default_rng(3), gru.Shape()
    docs = [r.integers(0, shape.words + shape.rest, k) for k in (1, 700, 64, 65, 3, 128)]
    want = gru.scores(gru.initial(shape), shape, docs)
    for lanes, window in ((512, 32), (2, 64), (1, 7)):
        assert np.allclose(gru.scores(gru.initial(shape), shape, docs, lanes, window), want, rtol=1e-6)
    given = inspect.signature(gru.scores).parameters
    assert (given["lanes"].default, given["window"].default) == (256, 64)  # a tenth less time than 512 lanes of 32
