"""Wavelet shards: exact round trips, rank and select, and the library's own ids."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pulsegrid.llm import tokens, wavelet
from pulsegrid.llm.wavelet import WaveletMatrix
from pulsegrid.workspace import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=1500) | st.lists(st.integers(0, 2**40), max_size=30))
def test_matrix(values):
    ids = np.array(values, np.uint64)
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes())
    assert matrix.decode().tolist() == values
    for i in range(0, len(values), 37):
        assert matrix.access(i) == values[i]
        where = [k for k, v in enumerate(values) if v == values[i]]
        low, high = sorted((i // 2, len(values) - i // 3))
        assert matrix.count(values[i], low, high) == sum(low <= k < high for k in where)
        assert [matrix.find(values[i], k) for k in (0, len(where) - 1, len(where))] == [where[0], where[-1], -1]
    assert matrix.count(71) == 0 or 71 in values


ODD = [None, "", " ", "don't I'LL we've x'", "<|endoftext|>yes <|startoftext|>", "café ÀÉß É x́ ﬁ İstanbul", "a\tb\x0bc d　e",
       "12 3a4 ½ ² µg ªº", "日本 語!?", "...!!,;'s's", "😀😀 a‍b", "́ ́", "x" * 3000]


def test_encoder_is_the_library():
    whole, ours = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    rng = random.Random(2)
    chars = "abcDEé É'’.,!?-<|>09½ \n\t ßÿ×÷ªµ日́ſK"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(chars) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        want = whole.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(t), ours.kind).tolist() == want, t


def test_groups_generations_and_long_texts(monkeypatch):
    """Many distinct words with a memory of few, texts together, and a text encoded in parts."""
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    whole, ours = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    rng = random.Random(5)
    chars = "abcDEé É'’.,!?-<|>09½ \n\t ßÿ日"
    texts = [None, "", " ", "\n \n", "<|endoftext|>", *["".join(rng.choice(chars) for _ in range(rng.randint(0, 200))) for _ in range(900)]]
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    for step in (7, 300, 1000):
        got = [x for i in range(0, len(texts), step) for x in ours.encode_all(pa.array(texts[i : i + step], pa.string()), b"\1\0")]
        assert [np.frombuffer(x, ours.kind).tolist() for x in got] == [w + [1] for w in want]
    monkeypatch.setattr(tokens, "GROUP_BYTES", 40)
    for t, w in zip(texts[1:200], want[1:200]):
        assert np.frombuffer(ours.encode(t), ours.kind).tolist() == w


def test_a_unit_is_looked_up_once():
    """Far more units than two hundred thousand are remembered, and then the library is not asked again."""
    ours = tokens.Encoder(PATH)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters[:14]] + ["日本", "ª¼"]
    texts = [pa.array([" ".join(words[i : i + 50_000])]) for i in range(0, len(words), 50_000)]
    first = [ours.encode_all(t, b"") for t in texts]
    ours.whole = ours.model = ours.pieces = None
    assert [ours.encode_all(t, b"") for t in texts] == first


@pytest.mark.parametrize("forget", [False, True])
def test_units_whose_ends_cannot_be_told(monkeypatch, forget):
    """The model without marked word ends, batches of a few pieces, and a memory of few characters."""
    monkeypatch.setattr(tokens, "AT_ONCE", 3)
    if forget:
        monkeypatch.setattr(tokens, "REMEMBERED_CHARS", 50)
    whole, ours, plain = Tokenizer.from_file(PATH), tokens.Encoder(PATH), tokens.Encoder(PATH)
    plain.closing[:] = False
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("abcDEé É'’.,!?-<|>09½ \n\t ßÿ日") for _ in range(rng.randint(0, 120)))
        want = whole.encode(text, add_special_tokens=False).ids
        for encoder in (ours, plain):
            assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == want, text


@pytest.mark.parametrize(("n", "stretch"), [(5000, 64), (5000, 1 << 16), (150_000, 1 << 16)])
def test_matrix_over_many_stretches(monkeypatch, n, stretch):
    monkeypatch.setattr(wavelet, "STRETCH", stretch)
    ids = np.random.default_rng(n).zipf(1.3, n) % 49408
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes())
    assert (matrix.decode() == ids).all()
    assert [matrix.access(i) for i in range(0, n, n // 97)] == ids[:: n // 97].tolist()
    assert matrix.count(1, n // 3) == (ids[n // 3 :] == 1).sum()


@pytest.mark.parametrize("small", [False, True])
def test_round_trip(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(tokens, "RANGE_BYTES", 2000)
        monkeypatch.setattr(tokens, "SHARD_TOKENS", 50)
        monkeypatch.setattr(tokens, "GROUP_BYTES", 100)
    rows = [(i * 7 % 31, t) for i, t in enumerate(ODD * 3)] + [(None, "x"), (None, None), (5, "b"), (5, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS ids").repartition(5)
    path = scratch_path(spark, "tokens")
    tokens.write(docs, path, PATH)
    got = sorted(map(tuple, tokens.digests(tokens.read(spark, path)).collect()), key=lambda r: r[1])
    whole = Tokenizer.from_file(PATH)
    ids = [(d, whole.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows]
    want, start = [], 0
    for d, x in sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes())):
        want.append((d, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert got == want
    if small:
        assert tokens.read(spark, path).count() > 5


def test_empty(spark):
    path = scratch_path(spark, "tokens")
    tokens.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert tokens.digests(tokens.read(spark, path)).collect() == []
