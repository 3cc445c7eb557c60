"""Toxicity, alignment of tokenizers and vector codes against plain versions; each registered query over sf0.001."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from trackloom.llm import alignment, queries, toxicity, vector_codes
from trackloom.llm.sql import SQL

SMALL = "/root/testdata/sf0.001"


# ---- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label) of the kept rows, and the codebooks' digest, by comparison with every entry."""
    rows = [(i, lab, v) for i, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    rows = sorted(((i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, lab, v in rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(rows[0][2]) // parts
    books = [[r[2][k * width : (k + 1) * width] for r in rows[:entries]] for k in range(parts)]

    def nearest(v, k):
        return min((sum((a - b) ** 2 for a, b in zip(v[k * width : (k + 1) * width], c, strict=True)), e) for e, c in enumerate(books[k]))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, _, v in rows:
            for k in range(parts):
                groups[k, nearest(v, k)[1]].append(v[k * width : (k + 1) * width])
        for (k, e), members in groups.items():
            books[k][e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = []
    for i, lab, v in rows:
        found = [nearest(v, k) for k in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab))
    of = collections.Counter()
    for _, _, error, lab in out:
        of[lab] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((i is None, i or 0, code, error, of[lab], digest) for i, code, error, lab in out)


def got_codes(df):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(5)
    rows = [(i, int(i % 3) if i % 7 else None, [float(np.float32(x)) for x in r.normal(size=32)]) for i in range(150)]
    rows += [(200 + i, 9, list(rows[i][2])) for i in range(20)]  # repeated vectors
    rows += [(3, 1, list(rows[9][2])), (3, 1, list(rows[8][2])), (None, 2, list(rows[7][2]))]  # ids that repeat, none
    rows += [(300 + i, 1, [float(x) for x in r.integers(-1, 2, 32) / 256]) for i in range(60)]  # ties
    bad = [float(x) for x in r.normal(size=32)]
    return rows + [(400, 1, None), (401, 1, [None, *bad[1:]]), (402, 1, [float("nan"), *bad[1:]]), (403, 1, [float("-inf"), *bad[1:]])]


def test_vector_codes_against_every_entry(spark, vectors):
    df = spark.createDataFrame([(*v, "x", "y", "z") for v in vectors], "vec_id long, label int, embedding array<float>, v string, code string, of string").repartition(3)
    assert got_codes(vector_codes.compressed(df, entries=16)) == plain_codes(vectors, entries=16)
    few = [v for v in vectors if v[0] is not None and v[0] < 9]  # fewer rows than entries
    assert got_codes(vector_codes.compressed(spark.createDataFrame(few, "vec_id long, label int, embedding array<double>"))) == plain_codes(few)


def test_vector_codes_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vector_codes.compressed(none).collect() == []
    assert vector_codes.compressed(spark.createDataFrame([(1, 1, None)], none.schema)).collect() == []
    for odd in ([1.0] * 15, [1e30] * 16):
        with pytest.raises(ValueError):
            vector_codes.compressed(spark.createDataFrame([(1, 1, odd)], none.schema))


def test_hot_label_and_decoding(spark):
    rows = [(i, 1 if i % 10 else i, [float(i % 17 + k) / 8 for k in range(16)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(8)
    assert got_codes(vector_codes.compressed(df, 4, 8)) == plain_codes(rows, 4, 8)
    v = vector_codes.kept(df)
    books = vector_codes.trained(v, 16, 4, 17, 1)
    for r in vector_codes.encoded(v, books, 16).join(df.select("vec_id", "embedding"), "vec_id").collect():
        assert np.abs(vector_codes.decoded(r["code"], books) - np.array(r["embedding"])).max() <= 1 / 256


def test_tree_search_is_exact():
    r = np.random.default_rng(1)
    for wide, span in ((4, 3), (4, 400), (1, 50), (7, 5)):  # small spans make ties
        entries, points = r.integers(-span, span, (64, wide)), r.integers(-2 * span, 2 * span, (3000, wide))
        search = vector_codes.Search(entries)
        index, d = search.nearest(points)
        every = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (d == every.min(1)).all()
    line = vector_codes.Search(np.arange(0, 64_000, 1000)[:, None])
    line.nearest(r.integers(0, 64_000, (3000, 1)))
    assert line.compared < 0.5 * 3000 * 64  # the bounds prune
    x = np.array([0, 1, 2, 3, 4, 2**52 - 1, (2**30 + 1) ** 2, (2**30 + 1) ** 2 - 1])
    assert vector_codes.root(x).tolist() == [int(v) for v in map(__import__("math").isqrt, x.tolist())]


def test_vector_codes_query_and_sql(spark):
    rows = duckdb.sql(f"select vec_id, label, embedding from '{SMALL}/embeddings.parquet'").fetchall()
    got = got_codes(queries.queries()["op13_vector_codes"](spark, SMALL))
    assert got == plain_codes(rows)
    with duckdb.connect() as c:
        c.execute(f"create view embeddings as from '{SMALL}/embeddings.parquet'")
        want = c.execute(f"select vec_id is null, coalesce(vec_id, 0), code, error, label_error, codebooks_sha256 from ({SQL['op13_vector_codes']})").fetchall()
    assert got == sorted(want)


# ---- alignment


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def plain_alignment(libraries, text):
    """(n_a, n_b, groups, links) from the whole text's tokens and their byte ranges."""
    a, b = libraries
    if not text:
        return 0, 0, "", []
    of = {c: i for i, c in enumerate(alignment.byte_symbols())}
    ea, ib = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    sides = [(ea.ids, [bytes(of[c] for c in x) for x in ea.tokens]), (ib, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib])]
    if any(b"".join(x) != (" " + text).encode() for _, x in sides):
        return 0, 0, "", []
    ranges = []
    for ids, parts in sides:
        ends = np.cumsum([len(x) for x in parts]).tolist()
        ranges.append(list(zip(ids, [0, *ends[:-1]], ends, strict=True)))
    cuts = sorted({e for _, _, e in ranges[0]} & {e for _, _, e in ranges[1]})
    links, groups, j = [], [], 0
    for i, s, e in ranges[0]:
        while ranges[1][j][2] <= s:
            j += 1
        k = j
        while k < len(ranges[1]) and ranges[1][k][1] < e:
            links.append((i, ranges[1][k][0]))
            k += 1
    for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True):
        groups.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in ranges))
    return len(ranges[0]), len(ranges[1]), ";".join(groups), links


def plain_rows(libraries, rows):
    found = [(i, plain_alignment(libraries, t)) for i, t in rows]
    n = collections.Counter(x for _, f in found for x in f[3])
    best = collections.Counter()
    for (_, b), m in n.items():
        best[b] = max(best[b], m)
    return sorted((i is None, i or 0, a, b, len(g.split(";")) if g else 0, len(x), sum(n[p] == best[p[1]] for p in x), sum(n[p] for p in x), hashlib.sha256(g.encode()).hexdigest() if x else "") for i, (a, b, g, x) in found)


def got_rows(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in df.collect())


ODD = ["a▁ b", "a ▁b", "x　y z", "x 　y", "a \tb", "<s> a </s> <0x41>", "it's 'll x 's", "a\x85b \x85c", "a\x00 b\x00", "  lead", "trail  ", " a  b \x1cd e", "é è́ á ́b", "▁"]


def test_alignment_against_whole_texts(spark, libraries, rows):
    rows = rows + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, links string, row_key string").repartition(3)
    want = plain_rows(libraries, rows)
    for hot in (0, 300, 1 << 18):  # all pairs by the join, some, all known to the tasks
        assert got_rows(alignment.digests(df, hot=hot)) == want
    for r in alignment.aligned(df).collect():
        assert r["n_groups"] == (len(r["groups"].split(";")) if r["groups"] else 0) and len(r["links"]) == 4 * r["n_links"]
    assert alignment.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert got_rows(alignment.digests(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))) == [(False, 1, *[0] * 6, ""), (False, 2, *[0] * 6, "")]


def test_alignment_of_random_texts(libraries, monkeypatch):
    r = random.Random(2)
    signs = [" ", " ", "a", "the", "'s", "\n", "▁", "　", "é", "1", "!", "  ", "🙂", "\x7f", "\r", "stone."]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 25))) for _ in range(600)]
    tool = alignment.Aligner(*alignment.paths())
    for k in range(0, len(texts), 100):
        sizes, groups, links = tool.align([t.encode() for t in texts[k : k + 100]])
        for i, t in enumerate(texts[k : k + 100]):
            a, b, g, x = plain_alignment(libraries, t)
            assert sizes[:, i].tolist() == [a, b, len(g.split(";")) if g else 0, len(x)] and groups[i].decode() == g
            assert np.frombuffer(links[i], tool.dtype).tolist() == [p * tool.many_b + q for p, q in x]
        tool.thin_out(50)
        assert len(tool.number) == len(tool.texts) == len(tool.fine) <= 50


def test_owner_windows():
    r = np.random.default_rng(3)
    b = r.integers(1, 9, 400)
    a = np.diff(np.r_[0, np.sort(r.choice(np.arange(1, b.sum()), 300, False)), b.sum()])
    whole = alignment.owners(a, b)
    for window in (1, 7, 64):
        assert all((x == y).all() for x, y in zip(alignment.owners(a, b, window), whole, strict=True))
    assert all(len(x) == 0 for x in alignment.owners(np.zeros(0, int), np.zeros(0, int)))


def test_alignment_query(spark, libraries):
    rows = duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    assert got_rows(queries.queries()["op12_byte_owners"](spark, SMALL)) == plain_rows(libraries, rows)


# ---- toxicity


def test_channel_restores_words(spark):
    texts = [(i, "the idiot said that a stupid moron is a loser and the clown had trash for the glass class " * 3) for i in range(9)]
    counts = toxicity.character_counts(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    assert (counts == sum(toxicity.trigrams([t]) for _, t in texts)).all()
    channel = toxicity.Channel(toxicity.log_model(counts))
    for written, meant in (("1d10t", "idiot"), ("st*pid", "stupid"), ("$tupid", "stupid"), ("m0r0n", "moron"), ("st.u.p.i.d", "stupid"), ("idiooooot", "idiot"), ("ssttuuppiidd", "stupid"), ("l o s e r", "loser"), ("tr4sh", "trash"), ("gla55", "glass"), ("the", "the"), ("", "")):
        assert channel.restored(written) == meant
    words = toxicity.Words(channel)
    assert words.meant('"1D10T"!!'.lower()) == ["idiot"] and words.meant("class") == ["class"] and words.meant("%%%") == [""]


def test_viterbi_against_every_path():
    r = np.random.default_rng(4)
    channel = toxicity.Channel(toxicity.log_model(r.integers(0, 50, toxicity.CODES**3)))
    for written in ("1d0", "a11b", "s s t", "4.4a", "ooo", "$!a"):
        paths = [("", (0, 0), 0.0, "")]
        for c in written:
            new = []
            for text, (two, one), cost, last in paths:
                for x, more in channel.options(c):
                    if not x:
                        new.append((text, (two, one), cost + more, last))
                        continue
                    code = toxicity.code_of(x)
                    new.append((text + x, (one, code), cost + more - channel.model[two][one][code], x))
                    if x == last and x != " ":
                        new.append((text, (two, one), cost + more + toxicity.AGAIN, last))
            paths = new
        best = min((cost - channel.model[two][one][0], text) for text, (two, one), cost, _ in paths)
        assert channel.restored(written) == best[1]


def leet(word):
    return word.translate(str.maketrans("oieas", "01345"))


def test_toxicity_query_held_out(spark):
    where = "/root/testdata/sf0.01"
    got = queries.queries()["op11_noisy_channel"](spark, where).collect()
    text, toxic = dict(duckdb.sql(f"select doc_id, text from '{where}/documents.parquet'").fetchall()), dict(duckdb.sql(f"select doc_id, toxic from '{where}/labels.parquet'").fetchall())
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    plain = "idiot clown pathetic worthless moron trash scum loser stupid disgusting".split()
    meant = [r for r in got if r["held_out"] and toxic.get(r["doc_id"]) == 1 and any(w in text[r["doc_id"]].lower().split() for w in plain)]
    clean = [r for r in got if r["held_out"] and toxic.get(r["doc_id"]) == 0]
    assert meant and sum(r["predicted"] for r in meant) >= 0.9 * len(meant) and sum(r["predicted"] for r in clean) <= 0.01 * len(clean)


def test_disguised_texts_and_odd_rows(spark, rows):
    clean = [(10 * i, t) for i, t in rows[:12]]
    bad = [(10 * i + 1, t + " you stupid idiot and moron " + t[:50]) for i, t in rows[:12]]
    more = [(10 * i + 2, f"{t} what a worthless moron, a stupid idiot, river {i} stone") for i, t in rows[:12]]
    docs = clean + bad + more
    test = [(5001, "the river was grey and the house " + " ".join(map(leet, ("stupid", "idiot", "moron")))), (5002, "over the hill s t u p i d and under i d i o t light"), (5003, "the winter road was old and bright"), (5004, None), (5005, ""), (None, "stooopid stuuuupid idiooot morooon"), (5003, "the winter road was old and bright")]
    df = spark.createDataFrame([(*d, "x", 1.0) for d in docs + test], "doc_id long, text string, toxic string, w0 double").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 10 != 0), "q") for i, _ in docs] + [(None, 1, "q"), (0, None, "q"), (5003, 7, "q")], "doc_id long, toxic int, text string")
    got = collections.defaultdict(list)
    for r in toxicity.scored(df, labels, least=2).collect():
        got[r["doc_id"]].append(r)
    assert len(got[5003]) == 2 and got[None][0]["held_out"]
    low = got[5003][0]["score"]
    assert all(got[i][0]["score"] > max(0.5, low) for i in (5001, 5002, None)) and low < 0.5 and got[5004][0]["score"] == got[5005][0]["score"] <= low
    assert 3 <= toxicity.labelled(df, labels, 20).select("doc_id").distinct().count() <= 20
    none = toxicity.scored(df, labels.where("doc_id < 0")).collect()
    assert len(none) == len(docs + test) and all(r["score"] < 1e-6 and r["predicted"] == 0 for r in none)
    assert toxicity.scored(df.limit(0), labels).collect() == []
