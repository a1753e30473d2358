"""Predictors and scores against direct computations."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator

from pulsegrid.functions.slots import SlotSpec
from pulsegrid.operators import compare as C
from pulsegrid.operators import distribution as dist
from pulsegrid.operators import evaluate as E
from pulsegrid.operators import features as Fe
from pulsegrid.operators import linear, neural, profiles, splits, trees
from pulsegrid.plans import catalog
from pulsegrid.plans.predictors import PREDICTORS, evaluate
from pulsegrid.sources import testdata as td


SLOTS = SlotSpec.between(date(2024, 1, 1), date(2024, 1, 31), 600)


@pytest.fixture(scope="module")
def rows(spark, tiny):
    return catalog._model_rows(td.Tables(spark, tiny)).filter("zone_id < 6")


def test_scores_and_their_edges(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 0), (1, 1.0, 0), (2, 0.0, 0), (2, 0.0, 0), (3, 1.0, 1), (3, 3.0, 2)],
        "zone_id int, prediction double, demand bigint",
    )
    got = {r.zone_id: (r.n, r.rmse, r.r2) for r in E.score_with_total(df, "zone_id").collect()}
    assert got[1] == (2, 1.0, None) and got[2] == (2, 0.0, None)
    assert got[3] == (2, math.sqrt(0.5), -1.0)
    pooled = RegressionEvaluator(labelCol="demand", predictionCol="prediction")
    assert got[None][1] == pytest.approx(pooled.setMetricName("rmse").evaluate(df), abs=1e-6)
    assert got[None][2] == pytest.approx(pooled.setMetricName("r2").evaluate(df), abs=1e-6)


def test_pooled_error_is_the_weighted_zone_error(spark, tiny):
    got = catalog.QUERIES["mean_profile_zone"](spark, tiny).collect()
    zones = [r for r in got if r.zone_id is not None]
    total = next(r for r in got if r.zone_id is None)
    pooled = sum(r.n * r.rmse**2 for r in zones) / sum(r.n for r in zones)
    assert total.rmse**2 == pytest.approx(pooled, abs=1e-5)


def test_constant_rmse(spark):
    df = spark.createDataFrame([(0,), (1,), (4,)], "demand bigint")
    got = {r.constant: r.rmse for r in E.constant_rmse(df, [0.0, 1.0]).collect()}
    assert got == pytest.approx({0.0: math.sqrt(17 / 3), 1.0: math.sqrt(10 / 3)})


def test_ols_equals_numpy_on_collinear_features(spark, rows):
    names = list(Fe.LAYOUT_CALENDAR)
    train, test = splits.by_week(rows, SLOTS, date(2024, 1, 22))
    model = linear.fit_ols(train, ["zone_id"], names)
    ours = linear.predict_ols(test, model, ["zone_id"], names).toPandas()
    train, test = train.toPandas(), test.toPandas()
    for zone in test.zone_id.unique():
        a, b = train[train.zone_id == zone], test[test.zone_id == zone].sort_values("slot_id")
        x = np.c_[np.ones(len(a)), a[names]]
        beta = np.linalg.lstsq(x, a.demand.to_numpy(float), rcond=None)[0]
        want = np.c_[np.ones(len(b)), b[names]] @ beta
        mine = ours[ours.zone_id == zone].sort_values("slot_id").prediction
        assert np.allclose(mine, want, atol=1e-8)


def test_predictors_by_name(spark, rows):
    train, test = splits.by_week(rows, SLOTS, date(2024, 1, 22))
    for name in PREDICTORS:
        report = evaluate(name, train, test, list(Fe.LAYOUT_WEEKDAY), 3024, 1296).collect()
        assert {r.model for r in report} == {name}
        assert sum(r.zone_id is None for r in report) == 1
    with pytest.raises(KeyError):
        evaluate("oracle", train, test, [], 0, 0)


def test_library_regression_is_close_to_the_exact_one(spark, rows):
    train, test = splits.by_week(rows, SLOTS, date(2024, 1, 22))
    layout = ["zone_id", *Fe.LAYOUT_CALENDAR]
    library = linear.global_regression(train, test, layout).filter("zone_id IS NULL").first()
    exact = linear.fit_and_score(train, test, [], layout).first()
    assert library.rmse == pytest.approx(exact.rmse, abs=1e-3)


def test_constant_zone_gets_a_flat_model(spark):
    df = spark.range(50).selectExpr("1 AS zone_id", "CAST(id % 5 AS INT) AS x", "2L AS demand")
    row = linear.fit_line(df, ["zone_id"], "x").first()
    assert (row.slope, row.intercept) == (0.0, 2.0)
    row = linear.fit_ols(df.selectExpr("*", "3 AS c"), ["zone_id"], ["x", "c"]).first()
    assert row.intercept == pytest.approx(2.0) and np.allclose(row.coefficients, 0)


def grow_by_hand(x, y, names, depth, node=1, out=None):
    """A direct recursive tree for one group."""
    out = {} if out is None else out
    n, total = len(y), y.sum()
    best, spread = None, y.var()
    if spread == 0:
        depth = 0
    if depth > 0:
        for name in sorted(names):
            values = x[name].to_numpy(float)
            for v in np.unique(values)[:-1]:
                left = values <= v
                nl, sl = left.sum(), y[left].sum()
                gain = (sl**2 / nl + (total - sl)**2 / (n - nl) - total**2 / n) / n
                gain = round(gain / spread, 9)
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, name, v)
    out[node] = (None if best is None else best[1:], n, pytest.approx(total / n, abs=1e-12))
    if best is not None:
        left = x[best[1]].to_numpy(float) <= best[2]
        grow_by_hand(x[left], y[left], names, depth - 1, node * 2, out)
        grow_by_hand(x[~left], y[~left], names, depth - 1, node * 2 + 1, out)
    return out


def test_grouped_tree_equals_direct_trees(spark, rows):
    names = list(Fe.LAYOUT_CALENDAR)
    got = trees.grow(rows, ["zone_id"], names, 3).toPandas()
    data = rows.toPandas()
    for zone in sorted(data.zone_id.unique()):
        mine = {
            r.node_id: ((r.feature, r.threshold) if isinstance(r.feature, str) else None, r.n,
                        r.prediction)
            for r in got[got.zone_id == zone].itertuples()
        }
        one = data[data.zone_id == zone]
        assert mine == grow_by_hand(one[names], one.demand.to_numpy(float), names, 3)


def test_tree_of_a_constant_label_is_one_leaf(spark):
    df = spark.range(20).selectExpr("1 AS zone_id", "CAST(id AS INT) AS x", "3L AS demand")
    nodes = trees.grow(df, ["zone_id"], ["x"], 2).collect()
    assert [(r.node_id, r.feature, r.prediction) for r in nodes] == [(1, None, 3.0)]
    scored = trees.predict(df, trees.grow(df, ["zone_id"], ["x"], 2), ["zone_id"], ["x"], 2)
    assert scored.count() == 20


def test_profile_predictions_match_their_sums(spark, tiny):
    """Scoring from sums equals scoring the predicted rows one by one."""
    demand = catalog._zone_demand(td.Tables(spark, tiny))
    split = td.Tables(spark, tiny).split
    profile = profiles.zone_profile(
        profiles.profile_sums(demand, SLOTS, split), SLOTS, split
    )
    by_sums = profiles.score_zone_profile(profile, SLOTS, split)
    dense = catalog._model_rows(td.Tables(spark, tiny)).filter(f"slot_id >= {split}")
    by_rows = E.score_with_total(profiles.predict(dense, profile, "zone_id"), "zone_id")
    want = {r.zone_id: r for r in by_rows.collect()}
    got = by_sums.collect()
    assert len(got) == len(want)
    for r in got:
        assert r.n == want[r.zone_id].n
        assert r.rmse == pytest.approx(want[r.zone_id].rmse, abs=1e-9)
        assert r.r2 == pytest.approx(want[r.zone_id].r2, abs=1e-9)


def test_network_learns_a_line():
    x = np.linspace(-1, 1, 200)[:, None]
    y = 2 * x[:, 0] + 1
    params = neural.fit_mlp(x, y, (10, 10), 1000, seed=1)
    assert np.sqrt(np.mean((neural.predict_mlp(params, x) - y) ** 2)) < 0.1


def test_networks_skip_small_zones(spark):
    df = spark.createDataFrame(
        [(1, float(i), i % 4, i >= 4) for i in range(12)] + [(2, 1.0, 1, True)] * 9,
        "zone_id int, x double, demand int, is_train boolean",
    )
    got = neural.score_networks(df, ["x"], max_iter=5).collect()
    assert [(r.zone_id, r.n_train, r.n_test) for r in got] == [(1, 8, 4)]


def metrics(spark, **models):
    rows = [(m, z, v) for m, values in models.items() for z, v in enumerate(values)]
    return spark.createDataFrame(rows, "model string, zone_id int, r2 double")


def test_comparison(spark):
    table = metrics(spark, a=[0.5, 0.2, 0.3, None], b=[0.4, 0.2, 0.6, 0.9])
    row = C.compare_pair(table, "a", "b").first()
    assert (row.a_share, row.b_share, row.zones, row.left_out) == (0.5, 0.5, 3, 1)
    wins = {r.model: r.wins for r in C.compare_all(table, ["a", "b"]).collect()}
    assert wins == {"a": 2, "b": 2}
    table = metrics(spark, a=[-5.0], b=[0.1])
    assert C.compare_margin(table, "a", "b").first().margin_sum == -1.1


def test_distribution(spark):
    values = spark.createDataFrame([(v, 1) for v in (1, 2, 4, 8)], "demand bigint, rows bigint")
    fit = dist.fit_pareto(values).first()
    assert fit.xm == 1.0 and fit.alpha == pytest.approx(0.961797, abs=1e-6)
    bins = dist.histogram(values, 7).orderBy("bin").collect()
    counts, edges = np.histogram([1, 2, 4, 8], bins=7)
    assert [r.cnt for r in bins] == list(counts)
    assert [r.bin_start for r in bins] == pytest.approx(list(edges[:-1]))
    assert sum(r.density for r in bins) * (edges[1] - edges[0]) == pytest.approx(1, abs=1e-5)
    exponential = dist.fit_exponential(values, n=3, mean=2.0).orderBy("x").collect()
    assert [r.density for r in exponential] == pytest.approx([math.exp(-x / 2) / 2 for x in range(3)])


@pytest.mark.parametrize("bins", [3, 10, 49, 1101])
def test_histogram_edges_equal_numpy(spark, bins):
    demand = [1 + (i * i) % 98 for i in range(400)] + [1, 99]
    values = dist.value_counts(spark.createDataFrame([(v,) for v in demand], "demand bigint"))
    got = [r.cnt for r in dist.histogram(values, bins).orderBy("bin").collect()]
    assert got == list(np.histogram(demand, bins=bins)[0])


def test_distribution_of_one_value(spark):
    values = spark.createDataFrame([(5, 9)], "demand bigint, rows bigint")
    assert dist.fit_pareto(values).first().alpha is None
    assert sum(r.cnt for r in dist.histogram(values, 4).collect()) == 9
