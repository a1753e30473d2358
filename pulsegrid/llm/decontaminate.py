"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only.

An item of n distinct shingles is in a document if at least ``least`` of them are.
At most f = floor((1 - least) n) may then be missing, so of the item's f + 1
shingles of smallest hash (its bottom-k MinHash sketch) the document has one at least. Items are
partitioned by n, which fixes k for each partition: short items need one or two
shingles, long ones more, and no document that qualifies is missed. Documents are
hashed once, however long they are, and matched with the sketches; the few pairs
found are verified by counting the item's shingles in the document's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.copies import few, hidden, row_key
from pulsegrid.workspace import materialize, scope

SHINGLE = 5
LEAST = 0.8
#: More sketch rows (16 bytes each) than this are joined by a shuffle instead of being sent to every task.
FEW_ROWS = 1_000_000
#: More candidate pairs than this are joined with the texts by a shuffle.
FEW_PAIRS = 100_000

_WORDS = r"filter(split(lower({0}), '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def words(column: str) -> str:
    """SQL for the lower-cased words; none for a null text."""
    return f"coalesce({_WORDS.format(column)}, CAST(array() AS ARRAY<STRING>))"


def shingles(array: str, n: int = SHINGLE) -> str:
    """SQL for the shingles of a word array; fewer than ``n`` words are one shingle, no words none."""
    later = ", ".join(f"get({array}, i + {k})" for k in range(n))
    return (
        f"CASE WHEN size({array}) = 0 THEN CAST(array() AS ARRAY<STRING>) "
        f"WHEN size({array}) <= {n} THEN array(concat_ws(' ', {array})) "
        f"ELSE transform(sequence(0, size({array}) - {n}), i -> concat_ws(' ', {later})) END"
    )


def items(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``item_id, n, shingles``: the distinct shingles of every item that has words."""
    return (
        benchmark.selectExpr("item_id", f"{words('text')} AS w")
        .selectExpr("item_id", f"array_distinct({shingles('w', shingle)}) AS shingles")
        .selectExpr("item_id", "size(shingles) AS n", "shingles")
        .where("n > 0")
    )


def sketches(listed: DataFrame, least: float = LEAST) -> DataFrame:
    """``item_id, h``: the smallest hashes of each item, as many as its size partition asks for."""
    return listed.selectExpr(
        "item_id",
        f"explode(slice(array_sort(transform(shingles, s -> xxhash64(s))), 1, "
        f"CAST(floor((1 - {least}D) * n + 1e-9) AS INT) + 1)) AS h",
    )


def contained(
    docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, least: float = LEAST
) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` of all pairs with containment >= ``least``.

    ``docs``: ``doc_id, text``; ``benchmark``: ``item_id, text``. Case is ignored; words
    are ``[^\\x20\\x09-\\x0D]+``. Null, empty and blank texts on either side find nothing. Items of fewer
    than ``shingle`` words are one shingle, found only in documents that are those very words; a document's
    repeats of a shingle count once. Repeated rows give one pair. A null ``doc_id``
    or ``item_id`` is an id like any other. Empty tables give an empty result; other columns are ignored.
    """
    listed = materialize(items(benchmark, shingle), "items")
    sketch = materialize(sketches(listed, least).distinct(), "sketches")
    sketch = F.broadcast(sketch) if few(sketch, FEW_ROWS) else sketch
    # the shingle's hash is made from its text, in one pass over the word array
    hashed = docs.selectExpr("doc_id", f"{words('text')} AS w").selectExpr(
        "doc_id", f"explode(transform({shingles('w', shingle)}, s -> xxhash64(s))) AS h"
    )
    found = materialize(hashed.join(sketch, "h").select("doc_id", "item_id").distinct(), "candidates")
    return verified(docs, listed, found, shingle, least)


def verified(docs: DataFrame, listed: DataFrame, found: DataFrame, shingle: int, least: float) -> DataFrame:
    """The candidate pairs whose exact shingle containment is enough.

    While the pairs are few, they are sent to the texts, which stay where they are.
    """
    pairs = found.join(listed, found["item_id"].eqNullSafe(listed["item_id"])).select(
        F.col("doc_id").alias("pair_doc"), found["item_id"], "n", "shingles"
    )
    ids = materialize(found.select(F.col("doc_id").alias("pair_doc")).distinct(), "candidate-ids")
    small = few(found, FEW_PAIRS)
    texts = docs.join(
        F.broadcast(ids) if small else ids, F.col("doc_id").eqNullSafe(F.col("pair_doc")), "left_semi"
    ).selectExpr("doc_id", f"{words('text')} AS w").selectExpr("doc_id", f"array_distinct({shingles('w', shingle)}) AS own")
    return (
        texts.join(pairs, F.col("doc_id").eqNullSafe(F.col("pair_doc")))
        .selectExpr("doc_id", "item_id", "size(array_intersect(shingles, own)) AS n_shared", "n AS n_item")
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
        .where(F.col("containment") >= least)
        .distinct()
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item; columns, whatever their names, and repeated rows unchanged.

    Rows are told apart by id and content, so a clean text stays whatever other rows of its id, or without id, hold.
    """
    rows = docs.selectExpr(f"{row_key()} AS doc_id", "text")
    key = hidden(docs, "row_key")
    with scope(docs.sparkSession) as tables:
        bad = contained(rows, benchmark, **how).select(F.col("doc_id").alias(key)).distinct()
        bad = tables.keep(materialize(bad, "leaks"))
    kept = docs.withColumn(key, F.expr(row_key())).join(F.broadcast(bad) if few(bad, FEW_PAIRS) else bad, key, "left_anti")
    return kept.select(*docs.columns)
