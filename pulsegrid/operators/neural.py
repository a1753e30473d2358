"""A small multilayer perceptron per zone.

Spark groups the rows and runs the zones in parallel. A group is one zone's
calendar (one row per slot), so its size is bounded by the number of slots in
the calendar and does not grow with the number of trips.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsegrid.functions.scores import SUMS, score_columns

# the helpers travel with the task, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fit_mlp(x: np.ndarray, y: np.ndarray, layers: tuple[int, ...], max_iter: int, seed: int):
    """Train with mini-batches and Adam until the loss stops falling."""
    rng = np.random.default_rng(seed)
    sizes = [x.shape[1], *layers, 1]
    limits = [np.sqrt(6.0 / (a + b)) for a, b in zip(sizes, sizes[1:])]
    params = [rng.uniform(-l, l, (a, b)) for l, a, b in zip(limits, sizes, sizes[1:])]
    params += [rng.uniform(-l, l, b) for l, b in zip(limits, sizes[1:])]
    depth = len(sizes) - 1
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step, best, stale = 0, np.inf, 0
    batch = min(200, len(x))
    for _ in range(max_iter):
        order, loss = rng.permutation(len(x)), 0.0
        for start in range(0, len(x), batch):
            rows = order[start:start + batch]
            acts = [x[rows]]
            for i in range(depth):
                z = acts[-1] @ params[i] + params[depth + i]
                acts.append(np.maximum(z, 0) if i < depth - 1 else z)
            delta = acts[-1] - y[rows, None]
            loss += float((delta**2).sum()) / 2
            delta, grads = delta / len(rows), [None] * (2 * depth)
            for i in reversed(range(depth)):
                grads[i], grads[depth + i] = acts[i].T @ delta, delta.sum(axis=0)
                delta = (delta @ params[i].T) * (acts[i] > 0)
            step += 1
            rate = 1e-3 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * m / (np.sqrt(v) + 1e-8)
        loss /= len(x)
        stale = stale + 1 if loss > best - 1e-4 else 0
        best = min(best, loss)
        if stale >= 10:
            break
    return params


def predict_mlp(params, x: np.ndarray) -> np.ndarray:
    depth = len(params) // 2
    for i in range(depth):
        x = x @ params[i] + params[depth + i]
        x = np.maximum(x, 0) if i < depth - 1 else x
    return x[:, 0]


def score_networks(
    rows: DataFrame, features: list[str], layers: tuple[int, ...] = (10, 10),
    max_iter: int = 1000, min_train: int = 5, min_test: int = 3, scale: bool = False,
    seed: int = 1, key: str = "zone_id", label: str = "demand",
) -> DataFrame:
    """One network per zone: ``zone, n_train, n_test, rmse, r2``.

    ``rows`` carry a boolean ``is_train``. Zones with too few rows on either
    side are left out. ``scale`` standardises with the training statistics.
    """
    schema = T.StructType([
        rows.schema[key],
        T.StructField("n_train", T.LongType()),
        *[T.StructField(c, T.LongType() if c in ("n", "scored") else T.DoubleType()) for c in SUMS],
    ])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(features)
        x, y = group[features].to_numpy(float), group[label].to_numpy(float)
        train = group["is_train"].to_numpy(bool)
        n_train, n_test = int(train.sum()), int((~train).sum())
        if n_train < min_train or n_test < min_test:
            return pd.DataFrame(columns=schema.fieldNames())
        if scale:
            spread = x[train].std(axis=0)
            x = (x - x[train].mean(axis=0)) / np.where(spread > 0, spread, 1.0)
        params = fit_mlp(x[train], y[train], layers, max_iter, seed)
        held, error = y[~train], predict_mlp(params, x[~train]) - y[~train]
        m2 = float(((held - held.mean()) ** 2).sum()) if np.ptp(held) > 0 else 0.0
        total = float(held.sum())
        return pd.DataFrame(
            [[group[key].iloc[0], n_train, n_test, n_test, float((error**2).sum()), total,
              total * total / n_test, m2]],
            columns=schema.fieldNames(),
        )

    columns = dict.fromkeys([key, *features, label, "is_train"])
    sums = rows.select(*columns).groupBy(key).applyInPandas(fit, schema)
    return sums.selectExpr(key, "n_train", "n AS n_test", *score_columns())
