"""Token counts against the tokenizer libraries, top-k against brute force, language ID on held-out rows."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from pulsegrid.llm import language, topk
from pulsegrid.llm.unigram import SPACE, Counter, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def unigram(pieces, by_bytes=True):
    vocab = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256) if by_bytes), *pieces]
    return Tokenizer(models.Unigram(vocab, 0, by_bytes))


def test_counts_are_the_library(spark, tiny):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    whole = unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in plain])
    docs = spark.read.parquet(f"{tiny}/documents.parquet").selectExpr("*", "1 AS n_tokens")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()}
    for d, t in texts.items():
        assert got[d] == len(whole.encode(SPACE + t.replace(" ", SPACE)).ids)


@pytest.mark.parametrize("by_bytes", [True, False])
def test_ties(by_bytes):
    """Vocabularies with many equal paths, unknown characters and pieces that hold spaces."""
    rng = random.Random(4)
    for _ in range(300):
        letters = rng.choice(["ab", f"ab{SPACE}", "abc"])
        pieces = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))): float(-rng.randint(1, 4)) for _ in range(9)}
        ours, whole = Counter(list(pieces.items()), by_bytes), unigram(pieces.items(), by_bytes)
        for _ in range(10):
            text = "".join(rng.choice("aabbcé \n") for _ in range(rng.randint(1, 14)))
            want = len(whole.encode(SPACE + text.replace(" ", SPACE)).ids)
            assert ours.count(text) == want, (pieces, text)


def test_count_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " "), (3, " "), (None, "a")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(docs, PATH).collect())
    assert [g[0] for g in got] == [0, 1, 2, 3, 3] and got[1][1] == got[2][1] == 0 and got[3] == got[4]
    assert token_counts(docs.limit(0), PATH).collect() == []


@pytest.mark.parametrize("block", [7, 4096])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.02, 6), 3 if i % 2 else 2)]) for i in range(80)]
    rows += [(81, None), (82, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (83, [float("nan")] * 6), (84, [float("inf")] * 6), (85, []), (90, []),
             (86, [1.0, 2.0]), (None, [1.0] * 6), (7, rows[7][1]), (7, rows[7][1]), (20, rows[20][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS block", "2 AS v")
    got = {}
    for r in topk.top_k(table, table.where("vec_id % 10 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    fine = [(i, tuple(int(np.floor(1024 * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for qid, q in {x for x in fine if x[0] % 10 == 0}:
        best = sorted(((-sum(a * b for a, b in zip(q, v)), i) for i, v in fine if i != qid and len(v) == len(q)))[:5]
        assert got.pop(qid, {}) == {n + 1: (i, -s) for n, (s, i) in enumerate(best)}
    assert not got


def test_large_components(spark):
    rows = [(0, [1e15, 1.0]), (1, [3e15, 1.0]), (2, [1e17, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(table, table.where("vec_id = 0")).collect()]
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1)]
    assert topk.top_k(table.limit(0), table).collect() == [] == topk.top_k(table, table.limit(0)).collect()


def slow_phrases(text, sample):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


def test_phrases():
    rng = random.Random(1)
    word = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    samples = {"x": word("abc ", 300), "y": word("bcd ", 300), "z": "a"}
    model = language.Model(samples)
    texts = [word("abcdeé ", rng.randint(1, 90)) for _ in range(40)] + ["q", "a" * 50]
    points = [np.array([ord(c) for c in t], np.uint32) for t in texts]
    want = [[slow_phrases(t, samples[k]) for k in model.langs] for t in texts]
    assert model.phrases(points).tolist() == want
    many = ["".join(texts)[:600]]
    model.STRETCH = language.STRETCH
    cut = [slow_phrases(many[0][:512], samples[k]) + slow_phrases(many[0][512:], samples[k]) for k in model.langs]
    assert model.phrases([np.array([ord(c) for c in many[0]], np.uint32)]).tolist() == [cut]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("*", "'' AS score")
    rows = language.identify(docs).withColumn("held_out", language.is_held_out()).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 200
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "12 !!", "en"), (4, "the cat", "en"), (4, "the cat", "en"), (None, "le chat", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in language.identify(docs, {"en": "the cat sat", "fr": "le chat dort"}).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "fr")}
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.identify(docs.limit(0)).collect() == []
