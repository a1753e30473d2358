"""Grid edges, flags and the nearest-centroid search against brute force."""

import random

import numpy as np
import pytest

from pulsegrid.functions.grid import CITY_GRID, GridSpec, flag_columns
from pulsegrid.operators import kmeans, splits
from pulsegrid.operators import zones as Z

LON = [
    (-74.168, None), (-74.16, 0), (-74.15, 0), (-73.98, 9), (-73.7201, 24), (-73.72, 24),
    (-73.70, None), (0.0, None), (float("nan"), None), (1e300, None), (None, None),
]
LAT = [
    (40.569, None), (40.575, 0), (40.58, 0), (40.75, 15), (40.8499, 24), (40.85, None),
    (40.9, None), (0.0, None),
]


def test_grid_edges(spark):
    for cases, cell in ((LON, CITY_GRID.cell_x), (LAT, CITY_GRID.cell_y)):
        df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v double")
        found = df.selectExpr("i", f"{cell('v')} AS c").orderBy("i").collect()
        assert [r.c for r in found] == [c for _, c in cases]


def test_strict_grid_leaves_out_the_step_below(spark):
    df = spark.createDataFrame([(-74.16,), (-74.15,)], "v double")
    found = [r.c for r in df.selectExpr(f"{CITY_GRID.cell_x('v', strict=True)} AS c").collect()]
    assert found == [None, 0]


def test_flatten_round_trip(spark):
    grid = CITY_GRID.resized(100, 100)
    df = spark.range(grid.cells).selectExpr("id", f"{grid.x_of('id')} AS x", f"{grid.y_of('id')} AS y")
    assert df.filter(f"{grid.flatten('x', 'y')} <> id").count() == 0


def test_flags(spark):
    points = [(-74.00, 40.72), (-73.79, 40.65), (-74.025, 40.72), (None, None)]
    df = spark.createDataFrame(points, "lon double, lat double")
    rows = df.selectExpr(*flag_columns("lon", "lat")).collect()
    assert [tuple(r) for r in rows] == [(1, 0), (0, 1), (0, 0), (0, 0)]


def test_unknown_zone_gets_no_flags(spark):
    zones = spark.createDataFrame([(1, -74.0, 40.72)],
                                  "zone_id int, centroid_lon double, centroid_lat double")
    df = spark.createDataFrame([(1,), (2,)], "zone_id int")
    rows = Z.with_zone_flags(df, zones).orderBy("zone_id").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 0), (2, 0, 0)]


def nearest(point, centroids):
    lon, lat = point
    if lon is None or lat is None:
        return None
    return min(((x - lon) * (x - lon) + (y - lat) * (y - lat), z) for z, x, y in centroids)[1]


@pytest.mark.parametrize("layout", ["random", "clustered", "line", "single", "stacked"])
def test_nearest_zone_equals_brute_force(spark, layout):
    rng = random.Random(layout)
    centroids = {
        "random": [(i, rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(150)],
        "clustered": [(i, rng.gauss(i % 3, 0.01), rng.gauss(i % 2, 0.01)) for i in range(90)],
        "line": [(i, float(i), 2.0) for i in range(20)],
        "single": [(7, 0.5, 0.5)],
        "stacked": [(i, 0.25, 0.25) for i in range(9)] + [(20, 1.0, 1.0)],
    }[layout]
    points = [(rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(400)]
    points += [(rng.uniform(-500, 500), rng.uniform(-500, 500)) for _ in range(50)]
    points += [(x, y) for _, x, y in centroids]
    # exact ties between neighbours on the line
    points += [(i + 0.5, 2.0) for i in range(19)] + [(None, 1.0), (1.0, None)]
    df = spark.createDataFrame(
        [(i, x, y) for i, (x, y) in enumerate(points)], "i int, x double, y double"
    )
    table = spark.createDataFrame(
        centroids, "zone_id int, centroid_lon double, centroid_lat double"
    )
    found = Z.nearest_zone(df, table, {"z": ("x", "y")}).collect()
    assert len(found) == len(points)
    assert {r.i: r.z for r in found} == {i: nearest(p, centroids) for i, p in enumerate(points)}


def test_nearest_zone_beyond_the_broadcast_threshold(spark):
    """The same answers when the index has to be joined by shuffling."""
    rng = random.Random(3)
    centroids = [(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(60)]
    # a third of all points in one spot
    points = [(rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(400)] + [(0.31, 0.62)] * 200
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, x double, y double")
    table = spark.createDataFrame(centroids, "zone_id int, centroid_lon double, centroid_lat double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        located = Z.nearest_zone(df, table, {"z": ("x", "y")})
        plan = located._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        found = {r.i: r.z for r in located.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert found == {i: nearest(p, centroids) for i, p in enumerate(points)}


def test_zone_table_without_coordinates_is_refused(spark):
    table = spark.createDataFrame([], "zone_id int, centroid_lon double, centroid_lat double")
    with pytest.raises(ValueError):
        Z.nearest_zone(spark.range(1).selectExpr("1D AS x", "1D AS y"), table, {"z": ("x", "y")})


def test_kmeans_finds_separate_groups(spark):
    df = spark.range(600).selectExpr(
        "IF(id % 3 = 0, 1D, IF(id % 3 = 1, 5D, 9D)) + rand(1) * 0.1 AS pickup_lon",
        "CAST(id % 3 AS DOUBLE) + rand(2) * 0.1 AS pickup_lat",
    )
    table = Z.centroid_table(df, Z.train_kmeans(df, 3, seed=4))
    assert sorted(round(r.centroid_lon) for r in table.collect()) == [1, 5, 9]


def test_heat_map_can_sum_or_count(spark):
    cells = spark.createDataFrame([(0, 0, 7), (0, 0, 3)], "cell_x int, cell_y int, demand bigint")
    grid = GridSpec(0.0, 1.0, 0.0, 1.0, 2, 2)
    assert Z.heat_map(cells, grid).first().cnt == 2
    row = Z.heat_map(cells, grid, "demand").first()
    assert (row.cnt, round(row.bubble, 6)) == (10, 2.0)


def test_kmeans_equals_a_direct_replay(spark):
    """Places, ties and a centroid that loses its points, against loops over all pairs."""
    rng = np.random.default_rng(4)
    points = np.round(rng.normal(0, 1, (300, 2)) + rng.choice([-4, 0, 4], (300, 1)), 1)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(points)] + [(900, None, 1.0), (901, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "trip_id int, x double, y double")
    places = df.selectExpr("x AS lon", "y AS lat").dropna().distinct()
    centres = {r.zone_id: (r.centroid_lon, r.centroid_lat) for r in kmeans.start(places, 7, 5).collect()}
    assert sorted(centres) == list(range(7))
    for _ in range(6):
        c = np.array([centres[z] for z in range(7)])
        nearest = [int(((c[:, 0] - x) * (c[:, 0] - x) + (c[:, 1] - y) * (c[:, 1] - y)).argmin()) for x, y in points]
        for z in range(7):
            own = points[[n == z for n in nearest]]
            if len(own):
                centres[z] = tuple(np.round(own.mean(axis=0), 9))
    for few in (0, 64):  # through the index, and as one list
        old, kmeans.FEW = kmeans.FEW, few
        got = {r.zone_id: (r.centroid_lon, r.centroid_lat) for r in kmeans.train(df, "x", "y", 7, 6, 5).collect()}
        kmeans.FEW = old
        assert got.keys() == centres.keys()
        assert all(np.allclose(got[z], centres[z], atol=1e-8) for z in centres)
    assert kmeans.train(df.limit(3), "x", "y", 7, 2, 5).count() <= 3
    assert kmeans.size_of(1000, 50) == 20 and kmeans.size_of(3, 50) == 1


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000).toDF("trip_id")
    a, b = (Z.bernoulli_sample(df.repartition(n), 0.25, 3, "trip_id") for n in (3, 7))
    assert a.exceptAll(b).isEmpty() and a.count() == b.count() and 1100 < a.count() < 1400
    train, test = splits.at_random(df, 0.7, 3, "trip_id")
    assert train.unionByName(test).distinct().count() == 5000 and train.join(test, "trip_id").isEmpty()
