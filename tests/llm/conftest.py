import random

import pytest

WORDS = "ba ce di fo gu ha je ki lo mu na pe qi ro su ta ve wi xo zu alpha beta gamma delta".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Texts of every awkward kind: null, empty, blank, short, long, repeated, odd characters."""
    rng = random.Random(3)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    return [
        None, "", "   \n\t ", "one", "one two three four", base, base, " ".join(near), prose(rng, 3000), prose(rng, 40) + "\n" + prose(rng, 40),
        "a b c d e " * 60, "é ü ñ 日本 🎉 " * 20, "mail me: joe.doe@mail.example.com or +1 (612) 555-7038 ok", "line one here\nline one here\nother\n\n\n",
        "\x00\x01 nul bytes \x7f", "x" * 5000, prose(rng, 60) + " " + base, "Licensed under the Apache License, Version 2.0. cc by nc", base.upper(),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts with a null id, a repeated id, null sources, and columns that clash with results."""
    rows = [(i if i != 4 else None, t, ["en", None, "de"][i % 3], None if i % 7 == 0 else f"s{i % 2}", len(t) if t else None, "x", 5) for i, t in enumerate(odd_texts)]
    rows += [rows[5], rows[8]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words long").repartition(3).persist()
    yield docs
    docs.unpersist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
