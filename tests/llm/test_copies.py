"""The pipeline's near-duplicate stage against brute force."""

import random
import re

import numpy as np
import pytest
from corpus_pipeline import drop_near_duplicates

from pulsegrid.llm import copies


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def stay(rows):
    """Ids that stay, by all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(d for d in sets if root[d] == d)


def corpus(seed=4):
    """Copies with some words replaced, up to beyond the limit, chains of them, and a passage many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    shared = [word() for _ in range(60)]
    out = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([8, 40, 200, 700]))]
        if rng.random() < 0.4:
            base = shared + base
        out.append(base)
        for rate in (0, 0.005, 0.01, 0.02, 0.03, 0.05):
            out.append([word() if rng.random() < rate else w for w in (base if rng.random() < 0.7 else out[-1])])
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("few", [0, 100_000])
def test_stage(spark, monkeypatch, few):
    monkeypatch.setattr(copies, "FEW_ROWS", few)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "en", "web") for d, t in rows], "doc_id long, text string, lang string, source string")
    got = sorted(r.doc_id for r in drop_near_duplicates(spark, docs, "").collect())
    assert got == stay(rows)


def test_pairs_beside_the_least(spark):
    """Two similar classes in a bucket whose least class is like neither are still found."""
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in copies.drop_copies(docs).collect()) == stay(rows)


def test_repeated_and_null_ids(spark):
    a, b, c = ("alpha beta gamma delta eps zeta", "one two three four five six seven", "x y z x y z u v w")
    rows = [(4, a), (4, a), (4, b), (7, b), (None, c), (None, c), (None, a), (None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in copies.drop_copies(docs).collect())
    assert got == sorted([("4", a), ("4", b), ("None", c), ("None", "q")])
    assert copies.drop_copies(docs.where("false")).collect() == []


def near_copies(size, seed=2):
    """One group: texts of 300 words, 8 of them replaced."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(300)]
    out = []
    for _ in range(size):
        text = list(base)
        for i in rng.sample(range(300), 8):
            text[i] = word()
        out.append(" ".join(text))
    return list(enumerate(out))


def test_candidates_grow_with_the_group(spark, monkeypatch):
    """Pairs that are verified, for groups of 100, 200 and 400 near copies of which few are similar to each other."""
    verify, counts = copies.verified, {}
    for size in (100, 200, 400):
        tables = []
        monkeypatch.setattr(copies, "verified", lambda pairs, sets: tables.append(pairs.count()) or verify(pairs, sets))
        rows = near_copies(size)
        kept = sorted(r.doc_id for r in copies.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        counts[size] = sum(tables)
        if size == 100:
            assert kept == stay(rows)
    assert counts[400] < 0.35 * 400 * 399 / 2  # before: 92 percent of all pairs
    print(counts)


def test_recall_of_pairs():
    """Shared keys of pairs at 0.8 to 0.85, the hardest, and of unlike ones."""
    rng = np.random.default_rng(5)
    met = {0.8: 0, 0.85: 0, 0.5: 0}
    for similarity in met:
        for _ in range(400):
            n = 600
            shared = int(round(2 * n * similarity / (1 + similarity)))
            pool = rng.integers(0, 1 << 63, 2 * n, np.uint64)
            a, b = pool[:n], np.concatenate([pool[:shared], pool[n : 2 * n - shared]])
            met[similarity] += bool(np.any(copies.band_keys(a) == copies.band_keys(b)))
    assert met[0.8] >= 0.95 * 400 and met[0.85] >= 0.99 * 400 and met[0.5] <= 0.1 * 400


def test_clashing_names(spark):
    """Columns of every name that the stages use inside."""
    names = ["row_key", "_row_key", "nth", "_row", "_nth", "row", "n", "bands", "set_id", "key"]
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (4, ""), (5, "other words that nobody else has here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'mine' AS {n}" for n in names])
    got = copies.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 5]
    assert {tuple(r)[2:] for r in got.collect()} == {("mine",) * len(names)}
    monkey = copies.FEW_ROWS
    copies.FEW_ROWS = 0
    assert sorted(r.doc_id for r in copies.drop_copies(docs).collect()) == [1, 3, 5]
    copies.FEW_ROWS = monkey


def test_fingerprints_of_similar_sets():
    """Sets at 0.8, small ones too, are within the radius; those at 0.5 are not."""
    rng = np.random.default_rng(8)

    def within(n, m, shared):
        hits = 0
        for _ in range(200):
            pool = rng.integers(0, 1 << 63, n + m - shared, np.uint64)
            a, b = (np.frombuffer(copies.simhash(x), np.uint64) for x in (pool[:n], np.concatenate([pool[:shared], pool[n:]])))
            hits += bool(copies.near(a, np.int64(n), b, np.int64(m)))
        return hits / 200

    assert min(within(*x) for x in ((4, 5, 4), (9, 9, 8), (20, 16, 16), (45, 45, 40), (600, 600, 534))) >= 0.98
    assert within(600, 600, 400) <= 0.01


@pytest.mark.parametrize("tile, shingles", [(8, 1 << 18), (1024, 2000)])
def test_tiles(spark, monkeypatch, tile, shingles):
    """Buckets and components of many tiles, by members and by shingles, and shingles that many share."""
    for name, value in (("TILE", tile), ("TILE_SHINGLES", shingles), ("BLOCK", 4), ("COMMON", 3)):
        monkeypatch.setattr(copies, name, value)
    rows = near_copies(60) + [(100 + d, t) for d, t in corpus(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in copies.drop_copies(docs).collect()) == stay(rows)


def test_rows_of_the_check_grow_with_the_members(spark, monkeypatch):
    """No row for a pair: the exact check is given each class once while a component fits a tile."""
    given, check = {}, copies.verified
    for size in (100, 200, 400):
        monkeypatch.setattr(copies, "verified", lambda rows, sets: given.update({size: rows.count()}) or check(rows, sets))
        copies.drop_copies(spark.createDataFrame(near_copies(size), "doc_id long, text string")).count()
    assert all(given[size] <= size for size in given)
