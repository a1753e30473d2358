"""Model against model, zone by zone.

``metrics`` holds one row per (model, zone). Zones where a model has no score
are left out of its pairings and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _side_by_side(metrics: DataFrame, models: list[str], metric: str) -> DataFrame:
    """One row per zone with a column per model; a single aggregation, no join."""
    columns = [
        F.expr(f"max(IF(model = '{m}', {metric}, NULL)) AS m{i}") for i, m in enumerate(models)
    ]
    wanted = metrics.filter(F.col("model").isin(models)).filter("zone_id IS NOT NULL")
    return wanted.groupBy("zone_id").agg(*columns)


def compare_pair(metrics: DataFrame, a: str, b: str, metric: str = "r2") -> DataFrame:
    """Share of zones each model wins; a tie counts half for both."""
    zones = _side_by_side(metrics, [a, b], metric)
    ranked = "m0 IS NOT NULL AND m1 IS NOT NULL"

    def share(won: str) -> str:
        points = f"CASE WHEN {won} THEN 1D WHEN m0 = m1 THEN 0.5D ELSE 0D END"
        return f"avg(IF({ranked}, {points}, NULL))"

    return zones.selectExpr(
        f"{share('m0 > m1')} AS a_share", f"{share('m1 > m0')} AS b_share",
        f"count_if({ranked}) AS zones", f"count_if(NOT ({ranked})) AS left_out",
    ).selectExpr(f"'{a}' AS model_a", f"'{b}' AS model_b", "*")


def compare_all(metrics: DataFrame, models: list[str], metric: str = "r2") -> DataFrame:
    """Share of zones each model wins; ties go to the earlier model."""
    zones = _side_by_side(metrics, models, metric)
    columns = [f"m{i}" for i in range(len(models))]
    winner = f"array_position(array({', '.join(columns)}), greatest({', '.join(columns)}))"
    wins = zones.selectExpr(f"{winner} AS winner").selectExpr(
        "count(winner) AS zones",
        *[f"count_if(winner = {i + 1}) AS w{i}" for i in range(len(models))],
    )
    rows = ", ".join(f"struct('{m}' AS model, w{i} AS wins)" for i, m in enumerate(models))
    return wins.selectExpr("zones", f"inline(array({rows}))").selectExpr(
        "model", "wins", "try_divide(wins, zones) AS share"
    )


def compare_margin(metrics: DataFrame, a: str, b: str, metric: str = "r2",
                   floor: float = -1.0) -> DataFrame:
    """Sum and mean of the differences, each side clamped below at ``floor``."""
    zones = _side_by_side(metrics, [a, b], metric).dropna()
    low = f"{float(floor)!r}D"
    difference = f"greatest(m0, {low}) - greatest(m1, {low})"
    return zones.selectExpr(
        f"sum({difference}) AS margin_sum", f"avg({difference}) AS margin_mean", "count(*) AS zones",
    ).selectExpr(f"'{a}' AS model_a", f"'{b}' AS model_b", "*")
