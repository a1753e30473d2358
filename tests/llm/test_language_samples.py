"""Training samples of languages whose texts are long."""

import random

import pytest

from pulsegrid.llm import language

ALPHABETS = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu", "dd": "vwxyzäö"}


def text(rng, lang, chars):
    words = []
    while sum(map(len, words)) + len(words) < chars:
        words.append("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(2, 7))))
    return " ".join(words)[:chars]


@pytest.mark.parametrize("ids", [True, False])
def test_long_texts(spark, ids):
    """Each language gets its characters, from several texts where there are several."""
    rng = random.Random(2)
    many = {"aa": (60, 8000), "bb": (60, 8000), "cc": (60, 1000), "dd": (60, 40)}
    rows = [(lang, text(rng, lang, n)) for lang, (count, n) in many.items() for _ in range(count)]
    docs = spark.createDataFrame([(i if ids else None, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    got = language.samples(docs, 400)
    assert {k: len(v) for k, v in got.items()} == dict.fromkeys(many, 400)
    for lang in ("aa", "bb"):
        own = [t for k, t in rows if k == lang]
        assert max(sum(got[lang][i : i + 20] in t for i in range(0, 380, 20)) for t in own) < 8


def test_one_long_text(spark):
    """A single text gives all; what is no letter in it doesn't count."""
    rng = random.Random(3)
    rows = [(0, "aa", text(rng, "aa", 9000)), (4, "bb", "12345 " * 5 + text(rng, "bb", 9000))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").where(~language.is_held_out())
    got = language.samples(docs, 400)
    assert got and all(len(v) == 400 for v in got.values())
