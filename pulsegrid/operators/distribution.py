"""Distribution of positive demand: histogram, exponential and Pareto fits.

Everything starts from ``demand value -> number of rows``, which is as small
as the range of demand values, and needs one shuffle of the demand table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(demand: DataFrame) -> DataFrame:
    """How often each positive demand value occurs."""
    return demand.filter("demand > 0").groupBy("demand").agg(F.expr("count(*) AS rows"))


def histogram(values: DataFrame, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum, normalised to area 1.

    Empty bins are listed; the last bin includes its upper edge.
    """
    # a single value gets the unit range around it
    edges = (
        values.selectExpr(
            "CAST(min(demand) AS DOUBLE) AS a", "CAST(max(demand) AS DOUBLE) AS b",
            "sum(rows) AS total",
        )
        .filter("total IS NOT NULL")
        .selectExpr("IF(a = b, a - 0.5D, a) AS low", "IF(a = b, b + 0.5D, b) AS high", "total")
        .selectExpr("low", f"(high - low) / {bins} AS width", "total")
    )
    placed = values.withColumn("edge", edges.selectExpr("struct(low, width)").scalar()).selectExpr(
        "*", "CAST(floor((demand - edge.low) / edge.width) AS INT) AS near"
    )
    # the division may be off by one right at an edge; the edges decide
    exact = (
        "near + CASE WHEN demand < edge.low + edge.width * near THEN -1"
        " WHEN demand >= edge.low + edge.width * (near + 1) THEN 1 ELSE 0 END"
    )
    filled = placed.groupBy(F.expr(f"least({exact}, {bins - 1}) AS bin")).agg(
        F.expr("sum(rows) AS cnt")
    )
    every = edges.selectExpr("*", f"explode(sequence(0, {bins - 1})) AS bin")
    return every.join(filled, "bin", "left").selectExpr(
        "bin", "low + width * bin AS bin_start", "coalesce(cnt, 0L) AS cnt",
        "coalesce(cnt, 0L) / (total * width) AS density",
    )


def fit_exponential(values: DataFrame, n: int | None = None,
                    mean: float | None = None) -> DataFrame:
    """Exponential density at 0..n-1 (default: up to the largest demand)."""
    fitted_mean = "sum(demand * rows) / sum(rows)" if mean is None else f"max({float(mean)!r}D)"
    fitted = values.selectExpr(f"{fitted_mean} AS m")
    return _points(values, fitted, n).selectExpr(
        "x", "fit.m AS mean", "exp(-x / fit.m) / fit.m AS density"
    )


def fit_pareto(values: DataFrame, n: int | None = None) -> DataFrame:
    """Pareto maximum likelihood: ``alpha``, ``xm`` and the density at 0..n-1.

    ``alpha`` is NULL when every value equals the minimum.
    """
    smallest = values.selectExpr("CAST(min(demand) AS DOUBLE)").scalar()
    fitted = values.withColumn("xm", smallest).selectExpr(
        "try_divide(sum(rows), sum(rows * (ln(demand) - ln(xm)))) AS alpha",
        "max(xm) AS xm",
    )
    tail = "alpha * pow(xm, alpha) / pow(x, alpha + 1)"
    return _points(values, fitted, n).selectExpr("x", "fit.xm AS xm", "fit.alpha AS alpha").selectExpr(
        "*", f"IF(x >= xm, {tail}, 0D) AS density"
    )


def _points(values: DataFrame, fitted: DataFrame, n: int | None) -> DataFrame:
    """``x`` = 0..n-1 over many tasks, each row with the one fitted row."""
    largest = values.agg(F.max("demand")).first()[0]
    count = 0 if largest is None else largest + 1 if n is None else n
    points = values.sparkSession.range(count).withColumnRenamed("id", "x")
    return points.withColumn("fit", fitted.select(F.struct("*")).scalar())
