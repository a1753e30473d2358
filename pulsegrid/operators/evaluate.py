"""Scores of predictions, per zone and pooled, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scores import SUMS, moment_sums, score_columns


def moments(df: DataFrame, *keys: str, label: str = "demand",
            prediction: str = "prediction") -> DataFrame:
    """Mergeable score sums per key."""
    return df.groupBy(*keys).agg(*map(F.expr, moment_sums(label, prediction)))


def score(df: DataFrame, *keys: str, label: str = "demand",
          prediction: str = "prediction") -> DataFrame:
    """``n, rmse, r2`` per key (or one row without keys).

    A key without any prediction keeps its row, with NULL scores.
    """
    sums = moments(df, *keys, label=label, prediction=prediction)
    return sums.selectExpr(*keys, "n", *score_columns())


def score_moments(sums: DataFrame, *keys: str) -> DataFrame:
    """Scores per key plus one pooled row with NULL keys.

    The pooled row is rolled up from the per-key sums, not from the rows.
    """
    totals = sums.rollup(*keys).agg(
        *[F.expr(f"sum({c}) AS {c}") for c in SUMS], F.expr("grouping_id() AS level")
    )
    return totals.filter(f"level IN (0, {2 ** len(keys) - 1})").selectExpr(
        *keys, "n", *score_columns()
    )


def score_with_total(df: DataFrame, *keys: str, label: str = "demand",
                     prediction: str = "prediction") -> DataFrame:
    return score_moments(moments(df, *keys, label=label, prediction=prediction), *keys)


def constant_rmse(df: DataFrame, constants: list[float], label: str = "demand") -> DataFrame:
    """RMSE of predicting each constant; all of them in one pass over the rows."""
    guesses = ", ".join(f"{float(c)!r}D" for c in constants)
    sums = df.selectExpr(
        f"count({label}) AS n", f"CAST(sum({label}) AS DOUBLE) AS s",
        f"sum(CAST({label} AS DOUBLE) * {label}) AS s2",
    )
    total = "greatest(s2 - 2 * constant * s + n * constant * constant, 0D)"
    return sums.selectExpr("n", "s", "s2", f"explode(array({guesses})) AS constant").selectExpr(
        "constant", f"sqrt({total} / nullif(n, 0)) AS rmse"
    )


def describe(df: DataFrame, *keys: str, column: str = "demand") -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum per key."""
    return df.groupBy(*keys).agg(*map(F.expr, (
        f"count({column}) AS cnt", f"avg({column}) AS mean",
        f"stddev_samp({column}) AS stddev", f"min({column}) AS min",
        f"max({column}) AS max",
    )))


def metric_summary(metrics: DataFrame, *names: str) -> DataFrame:
    """Mean and population deviation of metrics over the zones of each model."""
    columns = ["count(*) AS zones"]
    for name in names:
        columns.append(f"avg({name}) AS {name}_mean")
        columns.append(f"stddev_pop({name}) AS {name}_std")
    return metrics.groupBy("model").agg(*map(F.expr, columns))


def zscores(df: DataFrame, *names: str) -> DataFrame:
    """Standardise columns within each zone; a constant column becomes 0.

    Mean and deviation come from one aggregation, joined back on the zone.
    """
    stats = df.groupBy("zone_id").agg(
        *[F.expr(f"avg({n}) AS {n}_mean") for n in names],
        *[F.expr(f"stddev_pop({n}) AS {n}_std") for n in names],
    )
    scaled = [
        f"CASE WHEN {n}_std > 0 THEN ({n} - {n}_mean) / {n}_std ELSE 0D END AS {n}_z"
        for n in names
    ]
    return df.join(stats, "zone_id").selectExpr("slot_id", "zone_id", *scaled)
