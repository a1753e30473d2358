"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.workspace import materialize, scope


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (both long) of every node of ``edges`` (``a``, ``b``, long); the root is the least node.

    Each round hangs larger neighbours on the least neighbour, then the rest of a
    node's smaller neighbours too. Minima are combined before their shuffle, written and
    joined back, so the neighbours of a node never meet in one list, and the join can split the rows of the
    centre of a large star. Rounds end when the table repeats itself, after about log2 of the longest chain; every
    round is a written table, and only the last one stays.
    """
    spark = edges.sparkSession
    with scope(spark) as tables:
        # the larger node first
        found = materialize(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
        mark = _mark(found)
        while mark[0]:
            # a node without smaller neighbours is its own least neighbour
            least = materialize(found.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b"), "least")
            large = materialize(found.join(least, "b", "left").selectExpr("a", "coalesce(m, b) AS b").distinct(), "large")
            least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
            small = large.join(least, "a").selectExpr("stack(2, b, m, a, m) AS (a, b)").where("a <> b").distinct()
            found, last = materialize(small, "edges"), mark
            mark = _mark(found)
            if mark == last:
                break
        tables.keep(found)
    nodes = found.selectExpr("a AS node", "b AS root")
    return nodes.unionByName(found.selectExpr("b AS node", "b AS root").distinct())


def _mark(found: DataFrame) -> tuple:
    """A count and a checksum: enough to see that a round changed nothing."""
    return tuple(found.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
