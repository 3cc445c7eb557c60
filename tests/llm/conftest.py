import random

import pytest

WORDS = "the of and stone river light over under house grey morning walks silent forest old bright water hill road winter".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(("", "", "er", "ing", "s")) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages, personal data, nulls, empty and very long texts, and ties."""
    passage = prose(99, 40)
    texts = [prose(i, 60 + 7 * i) for i in range(12)]
    texts += [texts[0], texts[1].replace("stone", "rock", 1), texts[2] + " " + passage, passage + "\n" + texts[3], None, "", " \n\t", "one", "two words"]
    texts += ["x" * 5000, "ab " * 2000, prose(50, 20_000), "Mail a.b+c@mail.example.com or call +1 (017) 555-7713, host 10.1.2.3, card 4111 1111 1111 1111.", "ÄÖÜ Straße été naïve ΣΟΦΟΣ İstanbul 日本語 🙂 <|endoftext|> it's 12", texts[5].upper(), "%%% *** ### $$$ " * 30, ("same line here\n" * 12)]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """The same with a null id, repeated ids and rows, and columns that clash with the operators' own names."""
    data = [(i, t) for i, t in rows] + [(None, "no id"), (None, None), (3, rows[3][1]), (3, "another text of document three"), (0, rows[0][1])]
    names = ("ids", "n_tokens", "_k", "key", "lo", "kept", "class", "block", "fp", "label", "part")
    return spark.createDataFrame([(i, t, *["z"] * len(names)) for i, t in data], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
