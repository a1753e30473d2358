"""Metric reports as tidy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pulsegrid.sources.files import write_table


def metric_report(
    metrics: DataFrame, model: str, n_train_slots: int, n_test_slots: int
) -> DataFrame:
    """One line per zone (NULL zone = pooled) with the size of both sets."""
    return metrics.selectExpr(
        f"'{model}' AS model", "zone_id", "n", "rmse", "r2",
        f"{n_train_slots} AS n_train_slots", f"{n_test_slots} AS n_test_slots",
    )


def write_report(report: DataFrame, path: str, format: str = "parquet") -> None:
    """Write a report as Parquet or CSV."""
    write_table(report, path, format)
