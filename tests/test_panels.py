"""Models on panels against the same models on their dense rows; the candidate quadtree against brute force."""

from datetime import date

import numpy as np
import pytest

from pulsegrid.functions.slots import SlotSpec
from pulsegrid.operators import demand as D
from pulsegrid.operators import features as Fe
from pulsegrid.operators import linear, nearest, splits, trees
from pulsegrid.operators.panels import Panel
from pulsegrid.workspace import materialize

SLOTS = SlotSpec.between(date(2024, 12, 23), date(2025, 1, 13), 21600)  # across a new year
DAY = date(2025, 1, 7)
SPLIT = SLOTS.first_slot_of_week(DAY)
NAMES = list(Fe.LAYOUT_CALENDAR)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = {(int(z), int(s)): int(v) for z, s, v in zip(rng.integers(0, 6, 150), rng.integers(0, SLOTS.count, 150), rng.poisson(3, 150))}
    rows |= {(9, 5): 2, (9, -3): 7, (8, SLOTS.count + 4): 1, (77, 3): 5}  # outside the calendar, and a zone that is not listed
    demand = materialize(spark.createDataFrame([(*k, v) for k, v in rows.items()], "zone_id int, slot_id int, demand long"), "demand")
    zones = materialize(spark.createDataFrame([(z, z % 2, z % 3) for z in [*range(8), 9]], "zone_id int, a int, b int"), "zones")
    return Panel(demand, SLOTS, SPLIT, zones=zones)


@pytest.fixture(scope="module")
def dense(panel):
    filled = D.fill_calendar(panel.demand, SLOTS, panel.zones.select("zone_id"))
    rows = materialize(Fe.with_calendar(filled, SLOTS).join(panel.zones, "zone_id"), "dense")
    assert rows.count() == 9 * SLOTS.count
    return splits.by_week(rows, SLOTS, DAY)


def same(got, want):
    a, b = (df.toPandas() for df in (got, want))
    order = [c for c in ("max_depth", "zone_id", "node_id") if c in a]
    a, b = (df.sort_values(order)[sorted(a.columns)].reset_index(drop=True) for df in (a, b))
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == object:
            assert a[c].fillna("").tolist() == b[c].fillna("").tolist()
        else:
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-7, equal_nan=True), c


def test_regressions(panel, dense):
    train, test = dense
    same(linear.score_panel(panel, NAMES), linear.fit_and_score(train, test, ["zone_id"], NAMES))
    model = linear.fit_line(train, ["zone_id"], "hour")
    same(linear.fit_panel_line(panel, "hour"), model)
    scored = linear._scored(linear.predict_line(test, model, ["zone_id"], "hour"), ["zone_id"], "demand")
    same(linear.score_panel_line(panel, "hour"), scored)
    layout = [*NAMES, "zone_id", "a", "b"]
    predicted = linear.predict_ols(test, linear.fit_ols(train, [], layout), [], layout)
    same(linear.score_panel_global(panel, layout), linear._scored(predicted, ["zone_id"], "demand"))
    assert linear.score_panel_global(panel, layout, pooled_only=True).count() == 1


def test_trees(panel, dense):
    train, test = dense
    same(trees.grow_panel(panel, NAMES, 4), trees.grow(train, ["zone_id"], NAMES, 4))
    depths = [1, 3, 5]
    same(trees.panel_depth_sweep(panel, NAMES, depths), trees.depth_sweep(train, test, ["zone_id"], NAMES, depths))
    layout = [*NAMES, "zone_id", "a", "b"]
    nodes = trees.grow(train, [], layout, 4)
    same(trees.grow_panel(panel, layout, 4, grouped=False), nodes)
    scored = linear._scored(trees.predict(test, nodes, [], layout, 4), ["zone_id"], "demand")
    same(trees.score_panel(panel, layout, 4, grouped=False), scored)


def test_no_training_part(panel, spark):
    empty = Panel(panel.demand, SLOTS, 0, zones=panel.zones)
    for got in (linear.score_panel(empty, NAMES), linear.score_panel_line(empty, "hour"), trees.score_panel(empty, NAMES, 2)):
        rows = got.collect()
        assert len(rows) == 10 and {r.rmse for r in rows} == {None}
        assert {r.n for r in rows if r.zone_id is not None} == {SLOTS.count}


def test_one_tree_has_its_values_in_blocks(spark, monkeypatch):
    """A feature of many values: its sums run in blocks, and the split is the one found without them."""
    rows = spark.range(5000).selectExpr("CAST(id AS INT) AS slot_id", "CAST(id % 7 AS INT) AS x", "CAST(id > 3210 AS LONG) + id % 3 AS demand")
    rows = materialize(rows.selectExpr("*", "1 AS node_id"), "rows")
    names = ["slot_id", "x"]
    hist = materialize(trees.histogram(rows, [], names), "hist")
    bounds = trees.value_bounds(hist)
    assert len(bounds[0]) > 100 and bounds[1] == []
    one, many = trees.search(hist, [], names).first(), trees.search(hist, [], names, bounds).first()
    assert one == many and one.feature == "slot_id" and one.threshold == 3210
    same(trees.grow(rows.drop("node_id"), [], names, 3), trees.grow(rows.drop("node_id").selectExpr("*", "1 AS g"), ["g"], names, 3).drop("g"))


@pytest.mark.parametrize("k,clustered", [(1, False), (10, False), (300, True), (20_000, True)])
def test_nearest_zone(spark, k, clustered):
    rng = np.random.default_rng(k)
    centres = rng.uniform(0, 1, (k, 2))
    if clustered:
        middle = rng.uniform(0, 1, (20, 2))
        centres = middle[rng.integers(0, 20, k)] + rng.normal(0, 0.002, (k, 2)) * rng.choice([0.1, 1, 5], (k, 1))
    centres = centres * [0.5, 0.3] + [-74, 40]
    points = np.concatenate([
        rng.uniform(-1, 2, (500, 2)) * [0.5, 0.3] + [-74, 40], centres[rng.integers(0, k, 500)] + rng.normal(0, 1e-4, (500, 2)),
        rng.uniform(-180, 180, (500, 2)), [[0, 0], [0, 0], [-73.75, 1e6]], centres[:200],
    ])
    table = spark.createDataFrame(
        [(i, float(x), float(y)) for i, (x, y) in enumerate(centres)], "zone_id int, centroid_lon double, centroid_lat double"
    )
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "i int, x double, y double")
    got = {r.i: r.z for r in nearest.nearest_zone(df, table, {"z": ("x", "y")}).collect()}
    want = [int((((centres - p) ** 2).sum(axis=1)).argmin()) for p in points]
    assert [got[i] for i in range(len(points))] == want
