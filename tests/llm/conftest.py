"""Small corpora with nulls, ties, repeated rows, extra columns and very long texts."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, score double, copies string"


@pytest.fixture(scope="session")
def corpus(spark):
    """(DataFrame, [(doc_id, text)]): 140 documents; extra columns clash with names the operators use."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(900)] + ["the", "of", "And", "größe", "naïve"] * 20
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [line(9) for _ in range(6)]
    passage = line(60)
    texts: list[str | None] = [None, "", "  \n\t ", "one", "two words", "a " * 400, "x y " * 200, None, ""]
    texts.append("\n".join(line(12) for _ in range(900)))  # very long
    for i in range(50):
        ls = [line(rng.randint(3, 14)) for _ in range(rng.randint(1, 12))]
        if i % 4 == 0:
            ls[1:1] = shared[: rng.randint(2, 6)]
        if i % 5 == 0:
            ls.append(passage)
        texts.append("\n".join(ls))
    texts += ["\n".join([line(10)] * 2 + shared[:4] + [line(5)])]
    base = texts[20]
    for i in range(40):  # near copies: one word changed
        w = base.split(" ")
        w[rng.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [texts[30]] * 25 + [texts[31].upper()] * 3
    rows = [(i * 3 % 991, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", "ß", None]), 0, 1, 0.5, "c") for i, t in enumerate(texts)]
    rows += [rows[25], rows[12], (None, texts[22], "en", "s1", 0, 1, 0.5, "c"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
