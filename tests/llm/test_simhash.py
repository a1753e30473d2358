"""Fingerprints and near-duplicate groups against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from pulsegrid.llm import graph, simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(rows, fp, radius=2):
    """doc -> smallest doc reachable, by all pairs."""
    keys = sorted(set(fp.values()))
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(b)] = find(a)
    least = {}
    for d, _ in rows:
        k = find(fp[d])
        least[k] = min(least.get(k, d), d)
    return {d: least[find(fp[d])] for d, _ in rows}


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aBcdÉ") for _ in range(rng.randint(1, 7)))
    rows = [(0, None), (1, ""), (2, " \t"), (3, "one"), (4, "One"), (5, "one two"), (6, "a b c"), (7, "a b c")]
    base = [word() for _ in range(400)]
    for i in range(8, 90):
        words = list(base) if i % 3 else [word() for _ in range(rng.randint(1, 300))]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    return rows


def test_groups(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS unit")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = {d: slow_fingerprint(t) for d, t in rows}
    assert {d: r.fp % 2**64 for d, r in got.items()} == fp
    assert {d: r.component_id for d, r in got.items()} == groups(rows, fp)


@pytest.mark.parametrize("tile", [4, 40, 2048])
def test_tiles(spark, monkeypatch, tile):
    """Clusters and chains of fingerprints, in one tile or in many."""
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "PIECE", 7)
    rng = np.random.default_rng(5)
    fps = {}
    for c in range(6):
        x = int(rng.integers(0, 1 << 62))
        for _ in range(50):
            fps[len(fps)] = x
            x ^= 1 << int(rng.integers(0, 64))
            if c % 2:
                x ^= 1 << int(rng.integers(0, 64))
    rows = [(d, "") for d in fps]
    table = spark.createDataFrame([(d, (v ^ 1 << 63) - (1 << 63)) for d, v in fps.items()], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: table)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(table).collect()}
    assert got == groups(rows, fps)


def test_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(500, 501), (501, 501), (500, 501)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n)}, 500: 500, 501: 500}


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    docs = spark.createDataFrame([(4, "x y"), (4, "x y"), (None, "x y"), (None, "q")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
