"""Large and tiny labels, NaN coordinates, groups without a model."""

import math

import pytest

from pulsegrid.operators import evaluate, linear, trees, zones


def test_large_labels_do_not_overflow(spark):
    rows = spark.createDataFrame([(1, 3_000_000_000, 3e9)] * 4, "zone_id int, demand long, prediction double")
    assert math.isclose(evaluate.moments(rows, "zone_id").first()["sq_mean"], 3.6e19)
    assert evaluate.constant_rmse(rows, [3e9]).first()["rmse"] == 0
    # a constant label has no R2, however large
    assert {(r.rmse, r.r2) for r in evaluate.score_with_total(rows, "zone_id").collect()} == {(0.0, None)}


def test_small_variance_around_a_large_mean_counts(spark):
    rows = [(1, 1e9 + i % 2, 1e9 + 0.5) for i in range(1000)]
    df = spark.createDataFrame(rows, "zone_id int, demand double, prediction double")
    for r in evaluate.score_with_total(df, "zone_id").collect():
        assert r.rmse == pytest.approx(0.5) and r.r2 == pytest.approx(0.0, abs=1e-6)


def test_tiny_labels_still_split(spark):
    rows = [(1, i, 1e-7 * (i > 5)) for i in range(20)]
    df = spark.createDataFrame(rows, "zone_id int, x int, demand double")
    nodes = {r.node_id: r for r in trees.grow(df, ["zone_id"], ["x"], 2).collect()}
    assert nodes[1].threshold == 5 and nodes[3].prediction == pytest.approx(1e-7)
    total = trees.fit_and_score(df, df, ["zone_id"], ["x"], 2).filter("zone_id IS NULL").first()
    assert total.rmse == pytest.approx(0, abs=1e-15) and total.r2 == pytest.approx(1.0)


def test_groups_without_training_rows_are_counted(spark):
    schema = "zone_id int, x int, demand long"
    train = spark.createDataFrame([(1, i, i % 3) for i in range(9)], schema)
    test = spark.createDataFrame([(1, 3, 1), (1, 4, 2), (2, 3, 7)], schema)
    keys, names = ["zone_id"], ["x"]
    line = linear.predict_line(test, linear.fit_line(train, keys, "x"), keys, "x")
    scored = [
        evaluate.score_with_total(line, "zone_id"),
        linear.fit_and_score(train, test, keys, names),
        trees.fit_and_score(train, test, keys, names, 2),
        trees.depth_sweep(train, test, keys, names, [2]).drop("max_depth"),
    ]
    for table in scored:
        got = {r.zone_id: r for r in table.collect()}
        assert got[2].n == 1 and got[2].rmse is None and got[2].r2 is None
        assert got[None].n == 3 and got[None].rmse == pytest.approx(got[1].rmse)


def test_nan_points_are_missing(spark):
    nan = float("nan")
    rows = [(1, 1.0, 2.0), (2, nan, 2.0), (3, 1.0, nan), (4, 0.0, 2.0), (5, None, 2.0)]
    trips = spark.createDataFrame(rows, "trip_id int, pickup_lon double, pickup_lat double")
    assert [r.trip_id for r in zones.nonzero_points(trips).collect()] == [1]
    places = spark.createDataFrame([(7, 1.0, 2.0)], "zone_id int, centroid_lon double, centroid_lat double")
    found = zones.nearest_zone(trips, places, {"z": ("pickup_lon", "pickup_lat")})
    assert {r.trip_id: r.z for r in found.collect()} == {1: 7, 2: None, 3: None, 4: 7, 5: None}


def test_nearest_vector(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0, 0.0]), (2, [0.0, 0.0, 9.0]), (3, [1.0, nan, 0.0]), (4, None), (5, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    means = spark.createDataFrame(
        [(3, [0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (9, [0.0, 0.0, 8.0]), (4, [6.0, 5.0, 5.0])],
        "zone_id int, centroid array<double>",
    )
    got = {r.id: r.zone_id for r in zones.nearest_vector(df, means, "v").collect()}
    assert got == {1: 2, 2: 9, 3: None, 4: None, 5: 4}
