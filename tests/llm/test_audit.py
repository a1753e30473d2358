"""The filter audit against a replay of every order."""

import random
import re
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def failures(rows):
    least = {}
    key = lambda d: (d is None, d or 0)
    for d, t, _ in rows:
        least[t or ""] = min(least.get(t or "", (True, 1 << 70)), key(d))
    out = []
    for d, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": key(d) > least[t],
        }
        out.append({c for c, x in fails.items() if x})
    return out


def replay(rows, labels):
    fails = failures(rows)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, t in labels if t == 1 and d is not None}
    out, shares = [], defaultdict(int)
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                gone = [(d, f) for d, f in left if c in f]
                here = sum(c in f for _, f in own)
                left = [(d, f) for d, f in left if c not in f]
                shares[part, c] += len(gone)
                out.append((part, order, step, len(left), len(gone), here - len(gone), sum(f == {c} for _, f in own),
                            sum(d in good for d, _ in gone), sum(d in bad for d, _ in gone)))
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 9)))
    start = " ".join(word() for _ in range(30))
    rows = []
    for i in range(n):
        text = " ".join(word() for _ in range(rng.choice([0, 1, 40, 150])))
        kind = rng.randrange(8)
        if kind == 0 and rows:
            text = rng.choice(rows)[1]
        elif kind == 1:
            text = start + text  # a long common start
        elif kind == 2:
            text = start + rng.choice("aé")
        elif kind == 3:
            text = text.upper() + rng.choice("#|x")
        elif kind == 4:
            text = "one two " * 60
        elif kind == 5:
            text = rng.choice([None, "", " \n"])
        rows.append((rng.choice([i, i, i, i // 2, None]), text, rng.choice(["en", "de", "", None])))
    return rows + rows[:5]


@pytest.mark.parametrize("limit", [8 << 20, 600])
@pytest.mark.parametrize("seed", [1, 2])
def test_audit(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(audit, "RANGE_BYTES", limit)
    monkeypatch.setattr(audit, "LOCAL_BYTES", 4 * limit)
    rows = corpus(seed, 300)
    rng = random.Random(seed)
    labels = [(rng.choice([None, *range(200)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    docs = docs.withColumns({c: F.lit("mine") for c in ("id", "part", "mask", "n", "salt", "range", "t", "quality", "cells")})
    got = audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert sorted(map(tuple, got)) == replay(rows, labels)


def test_prefixes_are_cut_until_ranges_are_small(spark, monkeypatch):
    monkeypatch.setattr(audit, "RANGE_BYTES", 4000)
    start = "a common start of more than sixty-four bytes, that thousands of documents may share; "
    rows = [(i, start + str(i), "x") for i in range(50)] + [(i, "copies of one text " * 9, "x") for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    cuts = audit.prefixes(docs)
    assert [n for n, _ in cuts] == [4, 16, 64]  # the copies are one text, and are not cut
    ranges = {audit._range_of(t.encode(), cuts) for _, t, _ in rows}
    assert len(ranges) == 51


def test_trie():
    rng = random.Random(3)
    rows = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode(), (False, rng.randint(0, 50))) for _ in range(2000)]
    trie, gone = audit.Trie(), []
    for text, name in rows:
        gone += [(name, n) for name, _, n in trie.insert(text, name, ("", 0), 1)]
    least = {t: min(x for s, x in rows if s == t) for t, _ in rows}
    assert {t: name for t, name, _ in trie.walk()} == least
    assert sum(n for _, n in gone) == sum(name > least[t] for t, name in rows)


def test_long_texts_and_empty_tables(spark):
    long = "word " * 400_000
    rows = [(1, long, "en"), (2, long, "en"), (3, long + "x", "en")]
    labels = [(2, 1, 1)]
    marked = spark.createDataFrame(labels, LABELS)
    got = audit.audit(spark.createDataFrame(rows, DOCS), marked).collect()
    assert sorted(map(tuple, got)) == replay(rows, labels)
    assert audit.audit(spark.createDataFrame([], DOCS), marked).collect() == []
    assert sorted(map(tuple, audit.audit(spark.createDataFrame(rows, DOCS), marked.where("false")).collect())) == replay(rows, [])


def test_other_filters(spark):
    rows = [(1, "x y", "a"), (2, "x", "b"), (3, "y", "a")]
    filters = {"X": lambda t, w: b"x" in w, "Y": lambda t, w: b"y" in w}
    got = audit.audit(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame([], LABELS), "source", filters)
    assert sorted(map(tuple, got.select("part", "filter_order", "step", "kept", "removed", "shapley").collect())) == [
        ("a", "XY", 1, 1, 1, 1), ("a", "XY", 2, 0, 1, 3), ("a", "YX", 1, 0, 2, 3), ("a", "YX", 2, 0, 0, 1),
        ("b", "XY", 1, 0, 1, 2), ("b", "XY", 2, 0, 0, 0), ("b", "YX", 1, 1, 0, 0), ("b", "YX", 2, 0, 1, 2),
    ]
