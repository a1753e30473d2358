"""Predictors by name, fitted per group and scored per group and pooled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from pulsegrid.operators import linear, trees
from pulsegrid.operators.panels import Panel
from pulsegrid.sources.reports import metric_report

PREDICTORS: dict[str, Callable[..., DataFrame]] = {
    "linear_regression": linear.fit_and_score,
    "decision_tree": trees.fit_and_score,
}

#: The same on panels, whose rows are never made.
PANEL_PREDICTORS: dict[str, Callable[..., DataFrame]] = {
    "linear_regression": linear.score_panel,
    "decision_tree": trees.score_panel,
}


def evaluate(
    name: str, train: DataFrame, test: DataFrame, features: list[str],
    n_train_slots: int, n_test_slots: int,
) -> DataFrame:
    """Fit the named predictor per zone and report its scores."""
    scores = _named(PREDICTORS, name)(train, test, ["zone_id"], features)
    return metric_report(scores, name, n_train_slots, n_test_slots)


def evaluate_panel(name: str, panel: Panel, features: list[str], n_train_slots: int, n_test_slots: int) -> DataFrame:
    """Fit the named predictor per zone of a panel and report its scores."""
    return metric_report(_named(PANEL_PREDICTORS, name)(panel, features), name, n_train_slots, n_test_slots)


def _named(table: dict[str, Callable[..., DataFrame]], name: str) -> Callable[..., DataFrame]:
    if name not in table:
        raise KeyError(f"unknown predictor {name!r}; known: {sorted(table)}")
    return table[name]
