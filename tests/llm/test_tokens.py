"""Encoding, token files and packing against the library and plain versions."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackloom.llm import packing, rans
from trackloom.llm.bpe_trie import encode_documents, trie_bpe
from trackloom.llm.encoding import default_path, encoder

LIBRARY = Tokenizer.from_file(default_path())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


ALPHABET = st.text(alphabet=st.sampled_from("abcdetherinsxyz'012.,!-é́ßΣİ \t\n<|>endoftext日𝒳 #"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=5))
def test_both_encoders_give_the_library_s_ids(texts):
    data = [t.encode() for t in texts]
    sizes, flat = encoder(default_path()).encode(data)
    ends = np.cumsum(sizes)
    ids, decoded = trie_bpe(default_path()).encode(data)
    for t, a, b, x, d in zip(texts, ends - sizes, ends, ids, decoded, strict=True):
        want = ids_of(t)
        assert np.frombuffer(flat[a:b], "<u2").tolist() == want
        assert np.frombuffer(x, "<u4").tolist() == want
        assert d.decode() == LIBRARY.decode(want, skip_special_tokens=False)


def test_cache_starts_anew_when_full():
    from trackloom.llm.encoding import Encoder

    small = Encoder(default_path(), kept=5)
    for text in ("stone river light over under house", "grey morning walks", "stone house"):
        assert np.frombuffer(small.encode([text.encode()])[1], "<u2").tolist() == ids_of(text)


def test_other_vocabularies_encode_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Two  spaces and\nlines"
    assert np.frombuffer(encoder(path).encode([text.encode()])[1], encoder(path).dtype).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_documents_encode_and_decode(docs, rows):
    got = {r["doc_id"]: r for r in encode_documents(docs).collect()}
    for i, t in rows:
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids_of(t)
        assert got[i]["decoded"] == LIBRARY.decode(ids_of(t), skip_special_tokens=False)


def test_encoding_of_odd_and_empty_tables(odd, nothing):
    assert encode_documents(odd).count() == odd.count()
    assert encode_documents(nothing).count() == 0


def test_rans_round_trip_and_damage():
    r = np.random.default_rng(0)
    p = 1 / np.arange(1, 2001) ** 1.2
    ids = r.choice(2000, 60_000, p=p / p.sum())
    table = rans.Table.from_bytes(rans.Table.of_counts(np.bincount(ids, minlength=2000)).to_bytes())
    assert int(table.freq.sum()) == 1 << table.bits
    blocks = [(0, [(5, ids[:1]), (None, ids[1:40_000]), (9, ids[:0])]), (40_000, [(10, ids[40_000:])]), (60_000, [])]
    data = rans.encode_blocks(blocks, table)
    for (first, want), (at, got) in zip(blocks, rans.decode_blocks(data, table), strict=True):
        assert first == at and [d for d, _ in want] == [d for d, _ in got]
        assert all(np.array_equal(a, b) for (_, a), (_, b) in zip(want, got, strict=True))
    broken = bytearray(data[1])
    broken[200] ^= 1
    with pytest.raises(ValueError):
        rans.decode_blocks([bytes(broken)], table)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=400))
def test_rans_small_alphabets(ids):
    x = np.array(ids)
    table = rans.Table.of_counts(np.bincount(x))
    assert np.array_equal(rans.decode_blocks(rans.encode_blocks([(3, [(1, x)])], table), table)[0][1][0][1], x)


def test_token_files(spark, docs, rows):
    got = rans.read_tokens(spark, rans.write_tokens(docs)).orderBy("doc_id").collect()
    start = 0
    for (i, t), r in zip(rows, got, strict=True):
        want = np.array([*ids_of(t), 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, start, len(want)) and bytes(r["ids"]) == want.tobytes()
        start += len(want)


def test_token_files_of_odd_and_empty_tables(spark, odd, nothing):
    got = rans.read_tokens(spark, rans.write_tokens(odd)).orderBy("start").collect()
    assert len(got) == odd.count()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    assert rans.read_tokens(spark, rans.write_tokens(nothing)).count() == 0


def held(pieces, rows, window=4096):
    of = {}
    for p in pieces:
        of.setdefault(p["doc_id"], []).append(p)
    for i, t in rows:
        want = np.array([*ids_of(t), 2], "<u4")
        at = 0
        for p in sorted(of[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(want)
            assert bytes(p["ids"]) == want[at : at + p["length"]].tobytes()
            at += p["length"]
        assert at == len(want)
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    return len(by)


def test_packing(docs, rows):
    held(packing.packed(docs).collect(), rows)
    n = held(packing.packed(docs, window=256, unit=4).collect(), rows, 256)
    total = sum(len(ids_of(t)) + 1 for _, t in rows)
    assert n * 256 <= 1.05 * total + 256


def test_packing_of_odd_and_empty_tables(odd, nothing):
    got = packing.packed(odd)
    assert got.agg(F.sum("length")).first()[0] == sum(len(ids_of(r["text"])) + 1 for r in odd.select("text").collect())
    assert packing.packed(nothing).count() == 0


def test_plan_uses_what_there_is():
    r = random.Random(1)
    for _ in range(20):
        h = np.array([0] + [r.choice((0, 0, 1, 5, 1000)) for _ in range(32)])
        used = np.zeros(33, int)
        for s, times in packing.planned(h):
            assert sum(b * m for b, m in s) <= 32
            for b, m in s:
                used[b] += m * times
        assert (used <= h).all()


def test_least_squares_is_optimal():
    r = np.random.default_rng(2)
    for _ in range(20):
        a, h = r.random((8, 20)), r.random(8) * 10
        x = packing.nonnegative_least_squares(a, h)
        slope = a.T @ (h - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-6 and np.abs(slope[x > 0]).max(initial=0) < 1e-6


def test_crc_column(docs, rows):
    for p in packing.digests(packing.packed(docs)).collect():
        want = np.array([*ids_of(rows[p["doc_id"]][1]), 2], "<u4")[p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(want.tobytes())


def test_model_is_asked_once_for_words_that_differ_in_case():
    from types import SimpleNamespace

    from trackloom.llm import encoding as en

    coder, asked = en.Encoder(en.default_path()), []
    real = coder.tokenizer
    coder.tokenizer = SimpleNamespace(model=SimpleNamespace(tokenize=lambda t: asked.append(t) or real.model.tokenize(t)), encode=real.encode)
    text = "Unhappily unhappily UNHAPPILY, unHappily."
    ids = np.frombuffer(coder.encode([text.encode()])[1], coder.dtype)
    assert ids.tolist() == real.encode(text, add_special_tokens=False).ids and asked == ["unhappily"]
