"""Repeated byte strings and word windows against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import blocks, suffixes, windows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(0, 120))]
        text = " ".join(words)
        kind = i % 6
        if kind == 1:
            at = rng.randint(0, len(text))
            cut = sorted(rng.randint(0, len(passage)) for _ in range(2))
            text = text[:at] + passage[cut[0] : cut[1]] + text[at:]
        elif kind == 2 and rows:
            text = rng.choice(rows)[1] or ""
        elif kind == 3 and rows:
            other = list(rng.choice(rows)[1] or "x")
            other[rng.randrange(len(other) or 1) if other else 0 :][:1] = "Z"
            text = "".join(other)
        elif kind == 4:
            text = "ab" * rng.randint(0, 150) + "\t" + "q q " * rng.randint(0, 60)
        rows.append((i * 3 - 7, None if i % 17 == 0 else text))
    rows += [(5, ""), (5, passage), (5, passage), (None, passage), (None, passage + " x")]
    return rows


def bytes_left(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words_left(rows, width):
    docs = [(d, WORD.findall((t or "").encode())) for d, t in rows]
    big = 1 << 70
    least = {}
    for d, w in docs:
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            least[k] = min(least.get(k, big), big if d is None else d)
    out = []
    for d, w in docs:
        gone = set()
        for p in range(len(w) - width + 1):
            if least[tuple(w[p : p + width])] < (big if d is None else d):
                gone.update(range(p, p + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.fixture(params=[1, 2])
def rows(request):
    return corpus(request.param)


@pytest.fixture(params=[1 << 20, 900])
def small_blocks(request, monkeypatch):
    pack = blocks.pack
    monkeypatch.setattr(blocks, "pack", lambda docs: pack(docs, request.param))
    monkeypatch.setattr(blocks, "shards", lambda b: 1 if request.param > 9999 else 5)


@pytest.mark.parametrize("length", [24, 37, 64, 100])
def test_bytes(spark, rows, small_blocks, length):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("blob", F.lit(1))
    assert same(suffixes.remove_repeats(docs, length).collect(), bytes_left(rows, length))


@pytest.mark.parametrize("width", [1, 3, 13])
def test_words(spark, rows, small_blocks, width):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1))
    assert same(windows.remove_windows(docs, width).collect(), words_left(rows, width))


def test_spans(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    total = sum(r.stop - r.start for r in suffixes.repeated_spans(docs, 50).collect())
    assert total == sum(r[2] for r in bytes_left(rows, 50))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")], [(1, " \n ")], [(1, "x" * 500)]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert same(suffixes.remove_repeats(docs).collect(), bytes_left(rows, 400))
    assert same(windows.remove_windows(docs).collect(), words_left(rows, 13))
