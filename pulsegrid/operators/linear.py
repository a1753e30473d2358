"""Least squares for every zone at once.

One aggregation collects the normal equations of all groups; only those small
matrices, never the rows, reach Python. On panels the matrices come from sums over the calendar, the
zones and the rows with demand, and so do the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.scores import SUMS, score_columns, sums_from_powers
from pulsegrid.operators.evaluate import score, score_moments, score_with_total
from pulsegrid.operators.features import assemble
from pulsegrid.operators.panels import Panel, pair_index
from pulsegrid.workspace import materialize


def fit_line(train: DataFrame, keys: list[str], feature: str, label: str = "demand") -> DataFrame:
    """One-feature least squares per group; a constant feature gives slope 0."""
    pair = f"{label}, {feature}"
    return train.groupBy(*keys).agg(*map(F.expr, (
        f"count({label}) AS n_train",
        f"coalesce(regr_slope({pair}), 0D) AS slope",
        f"coalesce(regr_intercept({pair}), avg({label})) AS intercept",
    )))


def predict_line(rows: DataFrame, model: DataFrame, keys: list[str], feature: str) -> DataFrame:
    """Rows with a prediction, NULL where the group has no model."""
    return rows.join(model, keys, "left").selectExpr(
        "*", f"intercept + slope * {feature} AS prediction"
    )


def normal_sums(train: DataFrame, keys: list[str], features: list[str],
                label: str = "demand") -> DataFrame:
    """``n``, sums and sums of products of features and label per group."""
    columns = [*features, label]
    sums = ", ".join(f"sum(CAST({c} AS DOUBLE))" for c in columns)
    products = ", ".join(
        f"sum(CAST({a} AS DOUBLE) * {b})" for i, a in enumerate(columns) for b in columns[i:]
    )
    return train.groupBy(*keys).agg(*map(F.expr, (
        "count(*) AS n", f"array({sums}) AS sums", f"array({products}) AS products",
    )))


def fit_ols(train: DataFrame, keys: list[str], features: list[str],
            label: str = "demand") -> DataFrame:
    """Least squares with intercept per group: ``keys, n, intercept, coefficients``.

    Collinear or constant features get the minimum-norm solution, so the
    predictions are those of any exact solution.
    """
    return solve_normal(normal_sums(train, keys, features, label), keys, len(features))


def solve_normal(stats: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Least squares of every row of ``n, sums, products`` (as of ``normal_sums``, ``p`` features)."""
    schema = T.StructType(
        [stats.schema[k] for k in keys]
        + [
            T.StructField("n", T.LongType()),
            T.StructField("intercept", T.DoubleType()),
            T.StructField("coefficients", T.ArrayType(T.DoubleType())),
        ]
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, cols = np.triu_indices(p + 1)
        for batch in batches:
            if batch.empty:
                continue
            n = batch["n"].to_numpy(float)[:, None]
            means = np.stack(batch["sums"].to_list()) / n
            cross = np.zeros((len(batch), p + 1, p + 1))
            cross[:, rows, cols] = np.stack(batch["products"].to_list()) / n
            cross[:, cols, rows] = cross[:, rows, cols]
            cov = cross - means[:, :, None] * means[:, None, :]
            var = np.einsum("gii->gi", cov)[:, :p]
            square = np.einsum("gii->gi", cross)[:, :p]
            scale = np.where(var > square * 1e-12, np.sqrt(np.maximum(var, 0)), np.inf)
            corr = cov[:, :p, :p] / scale[:, :, None] / scale[:, None, :]
            target = cov[:, :p, p] / scale
            beta = np.einsum("gij,gj->gi", np.linalg.pinv(corr, rcond=1e-9, hermitian=True), target)
            beta = beta / scale
            out = batch[keys + ["n"]].copy()
            out["intercept"] = means[:, p] - (beta * means[:, :p]).sum(axis=1)
            out["coefficients"] = list(beta)
            yield out

    return stats.mapInPandas(solve, schema)


def predict_ols(rows: DataFrame, model: DataFrame, keys: list[str],
                features: list[str]) -> DataFrame:
    """Rows with a prediction, NULL where the group has no model."""
    terms = "".join(f" + model.coefficients[{i}] * {name}" for i, name in enumerate(features))
    model = model.selectExpr(*keys, "struct(intercept, coefficients) AS model")
    # a model without keys is one row: a scalar, not a join
    with_model = rows.join(model, keys, "left") if keys else rows.withColumn("model", model.scalar())
    return with_model.selectExpr("*", f"model.intercept{terms} AS prediction").drop("model")


# --- panels: all slots of all zones, from sums -------------------------------


def fit_panel(panel: Panel, features: list[str]) -> DataFrame:
    """One regression per zone of a panel on calendar features: ``keys, n, intercept, coefficients``.

    Features of the zone are constant within it and have no part in its model.
    """
    sums, _ = _panel_sums(panel, features)
    return _fit_zones(panel, sums, len(features))


def _panel_sums(panel: Panel, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Label sums per zone beside the calendar's sums, written once, and the calendar features among ``features``."""
    names = panel.calendar_names(features)
    calendar = panel.calendar_sums(names)
    table = panel.label_sums(names).withColumn("calendar", calendar.select(F.struct(*calendar.columns)).scalar())
    return materialize(table.selectExpr("*", "calendar.*").drop("calendar"), "panel-sums"), names


def _fit_zones(panel: Panel, sums: DataFrame, p: int) -> DataFrame:
    products = [
        f"train_products[{pair_index(i, j, p)}]" if j < p else f"train_xy[{i}]" for i in range(p) for j in range(i, p + 1)
    ]
    stats = sums.filter("train_n > 0").selectExpr(
        *panel.keys, "train_n AS n", "concat(train_sums, array(train_y)) AS sums",
        f"array({', '.join([*products, 'train_y2'])}) AS products",
    )
    return solve_normal(stats, list(panel.keys), p)


def _score_zones(panel: Panel, modelled: DataFrame, p: int, pooled_only: bool = False) -> DataFrame:
    """Scores per zone and pooled from test sums; ``modelled`` has ``intercept`` and ``coefficients`` beside them."""
    b = "coefficients[{0}]"
    terms = ["test_n * intercept * intercept - 2 * intercept * test_y + test_y2"]
    for i in range(p):
        bi = b.format(i)
        terms.append(f"2 * {bi} * (intercept * test_sums[{i}] - test_xy[{i}])")
        for j in range(i, p):
            terms.append(f"{'' if i == j else '2 * '}{bi} * {b.format(j)} * test_products[{pair_index(i, j, p)}]")
    sums = modelled.filter("test_n > 0").selectExpr(
        *panel.keys, f"{' + '.join(terms)} AS sse", "test_n", "test_y", "test_y2", "intercept IS NOT NULL AS known"
    )
    sums = sums.selectExpr(*panel.keys, *_known_sums("known", "test_n"))
    if pooled_only:
        return sums.agg(*[F.expr(f"sum({c}) AS {c}") for c in SUMS]).selectExpr("n", *score_columns())
    return score_moments(sums, *panel.keys)


def _known_sums(known: str, n: str) -> list[str]:
    """``SUMS`` of zones, those without a model counted in ``n`` only."""
    scored = f"IF({known}, {n}, 0)"
    return [f"{n} AS n", *sums_from_powers(scored, "sse", f"IF({known}, test_y, NULL)", f"IF({known}, test_y2, NULL)")[1:]]


def score_panel(panel: Panel, features: list[str]) -> DataFrame:
    """One regression per zone of a panel, scored on its test part and pooled; no row of the panel is made."""
    sums, names = _panel_sums(panel, features)
    model = _fit_zones(panel, sums, len(names)).drop("n")
    return _score_zones(panel, sums.join(model, list(panel.keys), "left"), len(names))


def _line_model(sums: DataFrame) -> DataFrame:
    """``sums`` of one feature with ``slope`` and ``intercept``; a constant feature gives slope 0."""
    square = "train_n * train_products[0] - train_sums[0] * train_sums[0]"
    slope = f"coalesce((train_n * train_xy[0] - train_sums[0] * train_y) / nullif(greatest({square}, 0D), 0D), 0D)"
    return sums.selectExpr("*", f"IF(train_n > 0, {slope}, NULL) AS slope").selectExpr(
        "*", "(train_y - slope * train_sums[0]) / nullif(train_n, 0) AS intercept"
    )


def fit_panel_line(panel: Panel, feature: str) -> DataFrame:
    """``keys, n_train, slope, intercept`` of a line per zone on one calendar feature."""
    sums, _ = _panel_sums(panel, [feature])
    return _line_model(sums).filter("train_n > 0").selectExpr(*panel.keys, "train_n AS n_train", "slope", "intercept")


def score_panel_line(panel: Panel, feature: str) -> DataFrame:
    """A line per zone on one calendar feature, scored on the test part and pooled."""
    sums, _ = _panel_sums(panel, [feature])
    return _score_zones(panel, _line_model(sums).selectExpr("*", "array(slope) AS coefficients"), 1)


def score_panel_global(panel: Panel, features: list[str], pooled_only: bool = False) -> DataFrame:
    """One regression for all zones of a panel on calendar and zone features, scored per zone and pooled.

    Zone features are columns of the zone table. Products of two calendar features are their sums times
    the number of zones, those of two zone features times the number of slots, and mixed ones the product of two sums.
    """
    sums, names = _panel_sums(panel, features)
    zone_names = panel.zone_names(features)
    p, q = len(names), len(zone_names)
    z = [f"CAST({n} AS DOUBLE)" for n in zone_names]
    # one row: sums over the zones
    total = sums.agg(*map(F.expr, (
        "count(*) AS zones", "max(train_n) AS slots", "max(train_sums) AS cs", "max(train_products) AS cc",
        *[f"sum({v}) AS z{i}" for i, v in enumerate(z)], *[f"sum({v} * {w}) AS z{i}_{j}" for i, v in enumerate(z) for j, w in enumerate(z) if i <= j],
        *[f"sum(train_xy[{i}]) AS cy{i}" for i in range(p)], *[f"sum({v} * train_y) AS zy{i}" for i, v in enumerate(z)],
        "sum(train_y) AS y", "sum(train_y2) AS y2",
    )))

    def product(i: int, j: int) -> str:
        if j == p + q:
            return f"cy{i}" if i < p else f"zy{i - p}"
        if j < p:
            return f"zones * cc[{pair_index(i, j, p)}]"
        return f"cs[{i}] * z{j - p}" if i < p else f"slots * z{i - p}_{j - p}"

    first = [*[f"zones * cs[{i}]" for i in range(p)], *[f"slots * z{i}" for i in range(q)], "y"]
    products = [product(i, j) for i in range(p + q) for j in range(i, p + q + 1)]
    stats = total.filter("zones * slots > 0").selectExpr(
        "zones * slots AS n", f"array({', '.join(first)}) AS sums", f"array({', '.join([*products, 'y2'])}) AS products"
    )
    model = materialize(solve_normal(stats, [], p + q), "model").select(F.struct("intercept", "coefficients")).scalar()
    own = " + ".join(["model.intercept", *[f"model.coefficients[{p + i}] * {v}" for i, v in enumerate(z)]])
    modelled = sums.withColumn("model", model).selectExpr("*", f"{own} AS intercept", "model.coefficients AS coefficients")
    return _score_zones(panel, modelled, p, pooled_only)


# --- rows --------------------------------------------------------------------


def _scored(predicted: DataFrame, keys: list[str], label: str) -> DataFrame:
    if not keys:
        return score(predicted, label=label)
    return score_with_total(predicted, *keys, label=label)


def fit_and_score(train: DataFrame, test: DataFrame, keys: list[str], features: list[str],
                  label: str = "demand") -> DataFrame:
    """One regression per group, scored on its test rows and pooled."""
    predicted = predict_ols(test, fit_ols(train, keys, features, label), keys, features)
    return _scored(predicted, keys, label)


def global_regression(train: DataFrame, test: DataFrame, layout, label: str = "demand",
                      zone: str = "zone_id") -> DataFrame:
    """One linear regression for all zones, scored per zone and pooled."""
    model = LinearRegression(labelCol=label, featuresCol="features").fit(assemble(train, layout))
    return score_with_total(model.transform(assemble(test, layout)), zone, label=label)
