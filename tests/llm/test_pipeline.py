"""The stages on a whole table against brute force, and names of every kind."""

import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from test_copies import stay
from tokenizers import Tokenizer

from pulsegrid.llm import copies, tokens
from pulsegrid.session import BATCH_BYTES, small_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_run(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    texts = dict(rows)
    left = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]
    left = stay(left)
    items = [grams(r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect() if r.text]
    left = [d for d in left if not any(g and 5 * len(g & grams(texts[d])) >= 4 * len(g) for g in items)]
    got = corpus_pipeline.run(spark, tiny).collect()
    # mixing repeats documents, and may leave some out; it takes no others
    taken = {r.doc_id for r in got}
    assert taken <= set(left) and len(taken) > 0.5 * len(left)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in got[::7]:
        ids = whole.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_columns_of_the_stages_own_names(spark, tiny):
    names = ["lang_pred", "score", "row_key", "own_score", "copies", "size", "target", "nth", "part"]
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(60).selectExpr("*", *[f"'mine' AS {n}" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tiny)
        rows = docs.collect()
        assert rows and all(r[n] == "mine" for r in rows for n in names), name
        docs = spark.createDataFrame(rows, docs.schema)


def test_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    docs = spark.range(200).selectExpr("id", "repeat('x', 100000) AS text").coalesce(1)
    with small_batches(spark):
        rows = docs.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in rows) == 200 and max(r.size for r in rows) < 5e6
    assert spark.conf.get(BATCH_BYTES, None) is None
    with pytest.raises(KeyError), small_batches(spark):
        raise KeyError
    assert spark.conf.get(BATCH_BYTES, None) is None
    spark.conf.set(BATCH_BYTES, "1m")
    try:
        with small_batches(spark):
            assert spark.conf.get(BATCH_BYTES) == "1m"
        assert spark.conf.get(BATCH_BYTES) == "1m"
    finally:
        spark.conf.unset(BATCH_BYTES)


def test_stages_of_whole_texts_work_in_small_batches(spark, tiny, monkeypatch):
    seen = {}

    def watched(module, name):
        inner = getattr(module, name)

        def run(*args, **how):
            seen[name] = spark.conf.get(BATCH_BYTES, None), how.get("group_bytes")
            return inner(*args, **how)

        monkeypatch.setattr(module, name, run)

    watched(copies, "drop_copies")
    watched(tokens, "write")
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(40)
    assert corpus_pipeline.drop_near_duplicates(spark, docs, tiny).count() > 0
    assert corpus_pipeline.write_tokens(spark, docs, tiny).count() == 40
    assert seen == {"drop_copies": ("4m", None), "write": ("4m", 1 << 20)}
    assert spark.conf.get(BATCH_BYTES, None) is None
