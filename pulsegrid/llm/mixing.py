"""Mixing sources to target weights, with DataFrame functions only.

Words are counted per source, each source gets a target, and a document is
repeated floor(target / source size) times, plus once more where a hash of its
``doc_id`` and the seed falls below the fraction. Only (doc_id, source, size)
rows are kept between the steps; the table of targets has one row per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.workspace import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: More sources than this are joined by a shuffle instead of being sent to every task.
FEW_SOURCES = 10_000

WORDS = r"coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0)"


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``: words of every row; a null text has none."""
    return docs.selectExpr("doc_id", "source", f"CAST({WORDS} AS LONG) AS size")


def targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """``source, source_size, target`` per source.

    Sources in code point order (null last) weigh ``weights``, repeating, and share
    ``share`` of all words. No target is above ``most`` times its source: what is
    left over is shared again by weight among the others. That ends with every
    source at its limit or at one common level times its weight; sorted by limit
    per weight, the sources at their limit come first, so running sums find the level.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rise = Window.orderBy("per_weight", F.col("source").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    limited = (
        sums.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * most)
        .withColumn("per_weight", F.col("most").cast("double") / F.col("weight"))
        .withColumn("whole", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("used", F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("heavy", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("below", F.col("most") * F.col("heavy") <= (F.col("whole") - F.col("used")) * F.col("weight"))
    )
    # the first source that is not at its limit sets the level
    level = (
        limited.withColumn("free", F.min(F.when(~F.col("below"), F.col("used"))).over(everything))
        .withColumn("rest", F.max(F.when(~F.col("below"), F.col("heavy"))).over(everything))
    )
    fair = (F.col("whole") - F.col("free")) * F.col("weight") / F.col("rest")
    return level.select(
        "source", "source_size",
        F.when(F.col("below"), F.col("most").cast("double")).otherwise(fair).alias("target"),
    )


def coin(seed: str = SEED) -> str:
    """SQL for a number in [0, 1) from the document's id and the seed."""
    return f"conv(substr(md5(concat_ws(':', CAST(doc_id AS STRING), '{seed}')), 1, 13), 16, 10) / 4503599627370496D"


def copies(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for every row of ``docs``.

    ``docs`` has ``doc_id, text, source``. A source without words gets no copies.
    Repeated rows toss the same coin and are counted each; a null ``doc_id`` has a
    coin of its own. An empty table gives an empty result, other columns are ignored.
    """
    sized = materialize(sizes(docs), "sizes")
    per_source = materialize(targets(sized, **how), "targets")
    return _repeats(sized, per_source, seed).select("doc_id", "source", "size", "source_size", "target", "copies")


def _repeats(rows: DataFrame, per_source: DataFrame, seed: str) -> DataFrame:
    """``rows`` with ``source_size, target, copies``."""
    small = per_source.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES  # broadcast only a table known to be small
    plan = (F.broadcast(per_source) if small else per_source).withColumnRenamed("source", "named")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    extra = F.expr(coin(seed)) < F.col("rate") - F.floor("rate")
    return (
        rows.join(plan, F.col("source").eqNullSafe(F.col("named")))
        .withColumn("rate", rate)
        .withColumn("copies", (F.floor("rate") + extra.cast("int")).cast("int"))
    )


def mix(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as ``copies`` says, with its columns unchanged.

    The targets depend on ``source`` alone, so rows meet only the table of targets
    and whole texts are never shuffled.
    """
    sized = materialize(sizes(docs), "sizes")
    per_source = materialize(targets(sized, **how), "targets")
    names = docs.columns
    hidden = [f"_mix_{c}" for c in names]
    rows = docs.toDF(*hidden).withColumns({"doc_id": F.col("_mix_doc_id"), "source": F.col("_mix_source")})
    repeated = _repeats(rows, per_source, seed).withColumn("copy", F.explode(F.expr("array_repeat(0, copies)")))
    return repeated.select(*hidden).toDF(*names)
