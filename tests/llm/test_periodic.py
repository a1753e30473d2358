"""Runs of repeated words against a search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_of(words, least_length=24, least_exponent=3):
    out = []
    a = np.array([hash(w) for w in words])
    for q in range(1, len(words) // least_exponent + 1):
        same = np.concatenate(([False], a[:-q] == a[q:], [False])).astype(int)
        for s, e in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            length = e - s + q
            if length >= max(least_length, least_exponent * q):
                whole = a[s : s + length]
                if not any((whole[:-r] == whole[r:]).all() for r in range(1, q)):
                    out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def document(rng):
    n, letters = rng.randint(0, 300), rng.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"])
    words = [rng.choice(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        at = rng.randrange(n)
        period = rng.randint(1, max(1, (n - at) // 3))
        for i in range(at + period, min(n, at + int(period * rng.uniform(2, 7)))):
            words[i] = words[i - period]
    return words


@pytest.mark.parametrize("least", [(24, 3), (6, 3), (9, 4), (50, 5), (3, 3)])
def test_many_documents(least):
    rng = random.Random(sum(least))
    for _ in range(150):
        docs = [document(rng) for _ in range(rng.randint(1, 4))]
        found = periodic.collapsed(pa.array([rng.choice(["", "\n "]) + " \t".join(d) for d in docs]), *least)
        for words, n, runs, text in zip(docs, *(x.to_pylist() for x in found)):
            want = runs_of(words, *least)
            assert n == len(words)
            assert [(r["start"], r["length"], r["period"]) for r in runs] == want
            assert text == kept(words, want)


def test_gram_thrice_within_a_period():
    """Neighbouring occurrences of short grams lie closer than the period; longer grams find it."""
    rng = random.Random(7)
    x, p, q = ([f"{c}{rng.random()}" for _ in range(n)] for c, n in (("x", 40), ("p", 30), ("q", 25)))
    words = (x + p + x + p + x + q + x + q) * 4
    found = periodic.collapsed(pa.array([" ".join(words)]), 24, 3)[1].to_pylist()[0]
    assert [(r["start"], r["length"], r["period"]) for r in found] == runs_of(words) == [(0, 1080, 270)]


def test_edges(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 24), (4, "a " * 24), (None, "a b c " * 8), (5, "A a " * 11 + "A"), (6, "é\u00a0ü " * 30), (7, "x y " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("mine") for c in ("runs", "kept", "n_words", "w", "h")})
    for size in (periodic.GROUP_BYTES, 1):
        monkeypatch.setattr(periodic, "GROUP_BYTES", size)
        got = periodic.collapse(docs).collect()
        want = []
        for d, t in rows:
            words = WORD.findall(t or "")
            want.append((d, len(words), runs_of(words), kept(words, runs_of(words))))
        assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept) for r in got), key=str) == sorted(want, key=str)
    assert periodic.collapse(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        periodic.collapse(docs, 24, 2)


def test_very_long_texts():
    """Half a million words each: one word only, a long period, words without repeats."""
    texts = ["a " * 500_000, " ".join(str(i % 9_999) for i in range(500_000)), " ".join(map(str, range(500_000)))]
    runs = periodic.collapsed(pa.array(texts), 24, 3)[1].to_pylist()
    assert [[tuple(r.values()) for r in x] for x in runs] == [[(0, 500_000, 1)], [(0, 500_000, 9_999)], []]


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query(spark, tiny):
    docs = queries.table(spark, tiny, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, tiny).collect()}
    assert len(got) == len(docs)
    found = 0
    for d in docs:
        words = planted(d.doc_id, d.text)
        runs = runs_of(words)
        best = max(runs, key=lambda r: (r[1] * 1_000_000_007 // r[2], -r[0], -r[2])) if runs else (None, None, None)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept(words, runs).encode()).hexdigest()
        found += len(runs)
    assert found > 10
