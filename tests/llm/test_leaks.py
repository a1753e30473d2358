"""Leaks are dropped by row, not by id."""

from pulsegrid.llm import decontaminate

ITEM = "what is the largest known moon of the planet saturn"
CLEAN = [f"a clean text number {i} about nothing that the benchmark asks for" for i in range(3)]


def test_shared_ids(spark):
    rows = [(None, f"so {ITEM} then"), (None, CLEAN[0]), (7, ITEM.upper()), (7, CLEAN[1]), (7, CLEAN[1]), (8, None), (None, None), (9, CLEAN[2])]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, source string")
    benchmark = spark.createDataFrame([(1, ITEM), (None, "never found in any of these texts at all")], "item_id long, text string")
    got = decontaminate.decontaminate(docs, benchmark)
    assert got.columns == docs.columns
    want = [(None, CLEAN[0]), (7, CLEAN[1]), (7, CLEAN[1]), (8, None), (None, None), (9, CLEAN[2])]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
