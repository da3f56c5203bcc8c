"""The language stage rejects gibberish and languages never learned, whatever the number of learned ones."""

import random

import pytest

from pagesieve.llm import langid

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def language(seed):
    """Made-up languages: words of syllables of their own."""
    draw = random.Random(seed)
    syllables = ["".join(draw.choice(LETTERS) for _ in range(3)) for _ in range(25)]
    words = ["".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(200)]
    return lambda n, seed: " ".join(random.Random(seed).choices(words, k=n))


def gibberish(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(LETTERS, k=draw.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("n_langs", [2, 4, 20])
def test_unknown_languages_go(spark, n_langs):
    known, unlearned = [language(i) for i in range(n_langs)], language(99)
    rows = [(100 * i + k, make(60, k), f"l{i:02}") for i, make in enumerate(known) for k in range(20)]
    rows += [(10_000 + k, gibberish(5 + 8 * k, k), None) for k in range(20)] + [(20_000 + k, unlearned(5 + 8 * k, k), None) for k in range(20)]
    rows += [(40_000 + i, make(8, 1000), None) for i, make in enumerate(known)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"] for r in langid.keep_identified(docs).collect()}
    assert got == {d for d, _, _ in rows if d < 10_000 or d >= 40_000}
