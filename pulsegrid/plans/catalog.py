"""Every operator as a query over the supplied tables.

A query takes ``(spark, sf_dir)`` and returns a DataFrame. All of them read
whole tables; the only limits are those that are the feature itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.grid import CITY_GRID, double
from pulsegrid.functions.slots import SlotSpec
from pulsegrid.operators import compare as C
from pulsegrid.operators import demand as D
from pulsegrid.operators import distribution as dist
from pulsegrid.operators import evaluate as E
from pulsegrid.operators import features as Fe
from pulsegrid.operators import linear, neural, profiles, splits, trees
from pulsegrid.operators import timeslots as ts
from pulsegrid.operators import zones as Z
from pulsegrid.operators.panels import Panel
from pulsegrid.plans import predictors, zoning
from pulsegrid.sources import files, reports
from pulsegrid.sources import testdata as td
from pulsegrid.sources.registry import Registry
from pulsegrid.workspace import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GRID5 = CITY_GRID.resized(5, 5)
GRID100 = CITY_GRID.resized(100, 100)
CALENDAR_LAYOUT = list(Fe.LAYOUT_CALENDAR)
CELL_LAYOUT = list(Fe.LAYOUT_CELL)
#: What names a slot of a calendar of several years.
WEEK_KEYS = ("year", "week", "day_of_week", "time_of_day_code")
#: Steps of the k-means queries, and sampled trips for each centroid.
KMEANS_STEPS, KMEANS_FACTOR = 4, 50
MODELS = ["tree", "line", "zone_mean", "global_mean"]


def query(function: Callable[[td.Tables], DataFrame]) -> Callable[[td.Tables], DataFrame]:
    QUERIES[function.__name__] = lambda spark, sf_dir: function(td.Tables(spark, sf_dir))
    return function


def rounded(function: Callable[[td.Tables], DataFrame]) -> Callable[[td.Tables], DataFrame]:
    """A query whose doubles are rounded to 6 digits, once and last."""

    @wraps(function)
    def shown(t: td.Tables) -> DataFrame:
        df = function(t)
        return df.select(*[
            F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else f.name
            for f in df.schema
        ])

    QUERIES[function.__name__] = lambda spark, sf_dir: shown(td.Tables(spark, sf_dir))
    return function


# --- shared inputs ---------------------------------------------------------

def _zone_demand(t: td.Tables, slots: SlotSpec | None = None) -> DataFrame:
    """Demand per slot and user group (40 zones without geometry)."""
    slots = slots or t.slots
    return D.count_demand(
        t.trips, slot_id=slots.slot_of("pickup_ts"), zone_id="pickup_zone"
    )


def _cell_demand(t: td.Tables, slots: SlotSpec | None = None) -> DataFrame:
    """Demand per slot and cell of the 5 x 5 grid, cells flattened to one id."""
    slots = slots or t.slots
    inside = zoning.slots_and_cells(t.trips, slots, GRID5)
    return D.count_demand(
        inside, slot_id="pickup_slot",
        zone_id=GRID5.flatten("pickup_x", "pickup_y"),
    )


def _centroids(t: td.Tables) -> DataFrame:
    return materialize(td.seed_centroids(t.trips), "centroids")


def _located(t: td.Tables, slots: SlotSpec, centroids: DataFrame) -> DataFrame:
    return zoning.slots_and_zones(t.trips, slots, centroids, ("pickup",))


def _fill(demand: DataFrame, slots: SlotSpec) -> DataFrame:
    demand = materialize(demand, "demand")
    return D.fill_calendar(demand, slots, D.distinct_values(demand, "zone_id"))


def _model_rows(t: td.Tables) -> DataFrame:
    """Zero-filled model input of all zones, written once."""
    return materialize(Fe.with_calendar(_fill(_zone_demand(t), t.slots), t.slots), "rows")


def _zone_panel(t: td.Tables, slots: SlotSpec | None = None, written: bool = False) -> Panel:
    """All slots of all zones with demand; ``written`` for models that read the demand several times."""
    slots = slots or t.slots
    demand = _zone_demand(t, slots)
    return Panel(materialize(demand, "demand") if written else demand, slots, t.week_split(slots))


def _cell_panel(t: td.Tables, written: bool = False) -> Panel:
    """All hours of all cells with demand; ``zones`` has the cells' positions and flags."""
    demand = _cell_demand(t, t.hourly)
    demand = materialize(demand, "demand") if written else demand
    demand = demand.selectExpr("slot_id", f"{GRID5.x_of()} AS cell_x", f"{GRID5.y_of()} AS cell_y", "demand")
    return Panel(demand, t.hourly, t.week_split(t.hourly), ("cell_x", "cell_y"))


def _global_panel(t: td.Tables) -> Panel:
    """All hours of all centroid zones, with their flags."""
    centroids = _centroids(t)
    located = _located(t, t.hourly, centroids)
    demand = materialize(D.count_demand(located, slot_id="pickup_slot", zone_id="pickup_zone"), "demand")
    return Panel(demand, t.hourly, t.week_split(t.hourly), zones=Z.zone_flags(centroids))


def _flagged_cells(panel: Panel) -> Panel:
    """The same panel with its cells' flags, for models of all cells."""
    cells = panel.demand.selectExpr("CAST(cell_x * 5 + cell_y AS INT) AS zone_id").distinct()
    return replace(panel, zones=Fe.cell_zones(cells, GRID5))


def _cell_rows(t: td.Tables) -> DataFrame:
    dense = _fill(_cell_demand(t, t.hourly), t.hourly)
    return materialize(Fe.grid_features(dense, t.hourly, GRID5), "rows")


def _global_rows(t: td.Tables) -> DataFrame:
    """Hourly zero-filled feature rows with zone flags for one-for-all models."""
    return materialize(features_cluster(t), "rows")


def _profile_sums(t: td.Tables, demand: DataFrame | None = None) -> DataFrame:
    demand = _zone_demand(t) if demand is None else demand
    return materialize(profiles.profile_sums(demand, t.slots, t.split), "profile")


def _metrics(t: td.Tables) -> DataFrame:
    """R2 and RMSE of four predictors per zone."""
    panel = _zone_panel(t, written=True)
    sums = _profile_sums(t, panel.demand)
    scored = {
        "tree": trees.score_panel(panel, CALENDAR_LAYOUT),
        "line": linear.score_panel_line(panel, "time_of_day_code"),
        "zone_mean": profiles.score_zone_profile(
            profiles.zone_profile(sums, t.slots, t.split), t.slots, t.split
        ),
        "global_mean": profiles.score_global_profile(
            sums, profiles.global_profile(sums, t.slots, t.split), t.slots, t.split
        ),
    }
    table = None
    for name in MODELS:
        part = scored[name].selectExpr(f"'{name}' AS model", "zone_id", "n", "rmse", "r2")
        table = part if table is None else table.unionByName(part)
    return table.filter("zone_id IS NOT NULL")


# --- sources and sinks -----------------------------------------------------

@query
def src_csv_or_parquet(t):
    """Trips through CSV with a declared schema, joined with Parquet slots."""
    registry = Registry(t.spark, scratch_path(t.spark, "tables"))
    trips = t.trips
    registry.save(trips, "trips")
    registry.save(ts.assign_slots(trips, t.slots), "trip_times")
    return registry.load("trips").join(registry.load("trip_times"), "trip_id").selectExpr(
        "trip_id", "pickup_ts", "dropoff_ts", "round(pickup_lon, 6) AS pickup_lon",
        "round(pickup_lat, 6) AS pickup_lat", "pickup_slot", "dropoff_slot",
    )


@query
def src_cell_partition(t):
    """One cell out of a table stored with one folder per cell."""
    path = scratch_path(t.spark, "cells")
    files.write_by_cell(Fe.grid_features(_fill(_cell_demand(t, t.hourly), t.hourly), t.hourly,
                                         GRID5), path)
    return files.read_cell(t.spark, path, 2, 2)


@query
def sink_roundtrip(t):
    path = scratch_path(t.spark, "demand")
    demand = _zone_demand(t)
    files.write_table(demand, path)
    return files.read_table(t.spark, path, demand.schema)


@query
def sink_by_date(t):
    """A snapshot stored by date, counted per date folder."""
    path = scratch_path(t.spark, "snapshot")
    files.write_by_date(t.trips, path, "pickup_ts")
    dates = t.spark.read.parquet(path).groupBy("trip_date").agg(F.expr("count(*) AS cnt"))
    return dates.selectExpr("date_format(trip_date, 'yyyy-MM-dd') AS trip_date", "cnt")


@query
def grid_meta(t):
    """A stored grid description, read back and applied to all trips."""
    path = scratch_path(t.spark, "grid")
    files.write_table(files.grid_meta(t.spark, CITY_GRID), path)
    grid = files.read_grid_meta(t.spark, path)
    return t.trips.selectExpr(
        *[f"{double(getattr(grid, n))} AS {n}" for n in ("lon_min", "lon_max", "lat_min", "lat_max")],
        f"{grid.nx} AS nx", f"{grid.ny} AS ny",
        f"{grid.cell_id('pickup_lon', 'pickup_lat')} AS cell",
    ).groupBy("lon_min", "lon_max", "lat_min", "lat_max", "nx", "ny").agg(
        F.expr("count(cell) AS trips_inside")
    )


@rounded
def report_metrics(t):
    """Scores of the zone profile as a stored report."""
    sums = _profile_sums(t)
    scores = profiles.score_zone_profile(profiles.zone_profile(sums, t.slots, t.split), t.slots, t.split)
    report = reports.metric_report(scores, "zone_mean", t.split, t.slots.count - t.split)
    path = scratch_path(t.spark, "report")
    reports.write_report(report, path, "csv")
    return files.read_table(t.spark, path, report.schema, "csv")


@query
def zone_groups(t):
    """Training and test rows of every zone."""
    is_train = splits.before_week(t.slots, t.test_start)
    return D.train_test_sizes(_zone_demand(t), is_train)


# --- time ------------------------------------------------------------------

def _slot_table(t):
    return ts.time_slots(t.spark, t.slots)


@query
def time_slots(t):
    return _slot_table(t)


@query
def time_slots_year(t):
    """Slots of another width over the years covered by the orders."""
    return ts.observed_slots(t.table("orders"), "o_orderdate", 6 * 3600)


@query
def assign_slot(t):
    return ts.assign_slots(t.trips, t.slots)


@query
def extend_slots(t):
    return ts.extend_slots(_slot_table(t), t.slots)


@query
def slot_calendar(t):
    return ts.slot_calendar(_slot_table(t))


@query
def weekday_day_counts(t):
    return ts.weekday_day_counts(slot_calendar(t), before=t.test_start)


@query
def weekday_day_counts_test(t):
    return ts.weekday_day_counts(slot_calendar(t), since=t.test_start)


@query
def calendar_lookup(t):
    """Day, hour and minute of every (year, week, weekday, time) with a trip."""
    seen = t.trips.selectExpr(f"{t.slots.slot_of('pickup_ts')} AS slot_id").distinct()
    keys = seen.selectExpr(*t.slots.fields(WEEK_KEYS))
    return ts.calendar_lookup(keys, slot_calendar(t))


@query
def profile_month(t):
    return ts.calendar_profile(t.table("orders"), "o_orderdate", "month")


@query
def profile_week(t):
    return ts.calendar_profile(t.table("orders"), "o_orderdate", "week")


@query
def profile_weekday(t):
    return ts.calendar_profile(t.table("orders"), "o_orderdate", "weekday")


@query
def profile_hour(t):
    return ts.calendar_profile(t.table("events"), "ts", "hour")


# --- space -----------------------------------------------------------------

@query
def grid_assign(t):
    return Z.assign_cells(t.trips, CITY_GRID)


@query
def grid_assign_fine(t):
    return Z.assign_cells(t.trips, GRID100)


@query
def grid_cell_id(t):
    cells = Z.assign_cells(t.trips, GRID100)
    return cells.selectExpr("trip_id", *[
        f"{GRID100.flatten(f'{end}_x', f'{end}_y')} AS {end}_zone" for end in Z.ENDS
    ])


@query
def grid_cell_origin(t):
    cells = Z.assign_cells(t.trips, CITY_GRID).dropna(subset=["pickup_x", "pickup_y"])
    used = cells.selectExpr("pickup_x AS cell_x", "pickup_y AS cell_y").distinct()
    return Z.cell_corners(used, CITY_GRID).selectExpr(
        "cell_x", "cell_y", "round(lon, 6) AS lon", "round(lat, 6) AS lat"
    )


@query
def nearest_centroid(t):
    """Nearest of 120 centroids for both ends of every trip."""
    return Z.assign_zones(t.trips, _centroids(t))


@query
def nearest_centroid_points(t):
    """Nearest label mean for every embedding, over all its dimensions."""
    points = td.vectors(t.spark, t.sf_dir)
    parts = points.selectExpr("label AS zone_id", "posexplode(vector) AS (i, x)")
    means = parts.groupBy("zone_id", "i").agg(F.expr("round(avg(x), 6) AS x")).groupBy("zone_id").agg(
        F.expr("transform(array_sort(collect_list(struct(i, x))), e -> e.x) AS centroid")
    )
    return Z.nearest_vector(points, means, "vector").select("vec_id", "label", "zone_id")


@query
def kmeans_train(t):
    trips = t.trips
    return Z.cluster_sample(trips, fraction=0.5, seed=7, steps=KMEANS_STEPS, factor=KMEANS_FACTOR)


@query
def centroid_table(t):
    trips = t.trips
    return Z.cluster_sample(trips, k=8, seed=3, steps=KMEANS_STEPS).selectExpr(
        "zone_id", "round(centroid_lon, 3) AS centroid_lon",
        "round(centroid_lat, 3) AS centroid_lat",
    )


@query
def zone_flags(t):
    return Z.zone_flags(td.seed_centroids(t.trips))


@query
def centroid_demand(t):
    centroids = _centroids(t)
    return Z.centroid_demand(Z.assign_zones(t.trips, centroids), centroids, 60)


def _cells_xy(t):
    return _cell_demand(t).selectExpr(
        f"{GRID5.x_of()} AS cell_x", f"{GRID5.y_of()} AS cell_y", "demand"
    )


@query
def grid_heat(t):
    return Z.heat_map(_cells_xy(t), GRID5, "demand").selectExpr(
        "cell_x", "cell_y", "round(lon, 6) AS lon", "round(lat, 6) AS lat", "cnt",
        "round(bubble, 6) AS bubble",
    )


@query
def grid_heat_rows(t):
    """The heat map that counts feature rows instead of demand."""
    return Z.heat_map(_cells_xy(t), GRID5).selectExpr(
        "cell_x", "cell_y", "cnt", "round(bubble, 6) AS bubble"
    )


@query
def nonzero_points(t):
    """Points with both coordinates set; every 50th id has one blanked."""
    trips = t.trips.withColumn(
        "pickup_lon", F.expr("IF(trip_id % 50 = 0, 0D, pickup_lon)")
    )
    return Z.nonzero_points(trips).selectExpr(
        "trip_id", "round(pickup_lon, 6) AS pickup_lon", "round(pickup_lat, 6) AS pickup_lat"
    )


@query
def zoning_clusters(t):
    """Trips to k-means zones to zero-filled demand in one job."""
    _, demand = zoning.cluster_demand(t.trips, t.hourly, k=20, fraction=0.5, seed=7, steps=KMEANS_STEPS)
    return demand


@query
def zoning_centroids(t):
    """The zone job with stored centroids instead of trained ones."""
    located = _located(t, t.hourly, _centroids(t))
    counted = D.count_demand(located, slot_id="pickup_slot", zone_id="pickup_zone")
    return D.fill_observed(materialize(counted, "demand"), t.hourly)


@query
def zoning_grid(t):
    return zoning.grid_demand(t.trips, t.slots, CITY_GRID)


# --- projections, filters, splits ------------------------------------------

@query
def feat_drop(t):
    return Fe.without_keys(Fe.with_calendar(_zone_demand(t), t.slots))


@query
def filter_zone(t):
    return _zone_demand(t).filter("zone_id = 7")


@query
def split_by_week(t):
    rows = Fe.with_calendar(_zone_demand(t), t.slots)
    return rows.selectExpr(
        "slot_id", "zone_id", "week", "demand", f"{splits.before_week(t.slots, t.test_start)} AS is_train"
    )


@query
def groups_min_rows(t):
    return D.groups_with_rows(_zone_demand(t), 10, "zone_id")


@query
def groups_train_test(t):
    return D.groups_with_train_test(_zone_demand(t), f"slot_id < {t.split}", 5, 3)


@query
def index_slice(t):
    """Rows 500 to 1499 of the demand table in (slot, zone) order."""
    return D.index_slice(materialize(_zone_demand(t), "demand"), 500, 1500)


@query
def split_first_n(t):
    rows = _fill(_zone_demand(t, t.hourly), t.hourly)
    return splits.first_n(rows, 21 * t.hourly.per_day)


@query
def split_leading_fraction(t):
    return splits.leading_fraction(_zone_demand(t), 0.1667)


@query
def split_by_key(t):
    return splits.by_key(_zone_demand(t), "slot_id", 70)


@query
def split_random(t):
    train, test = splits.at_random(_zone_demand(t), 0.7, 5, "slot_id", "zone_id")
    return train.selectExpr("*", "true AS is_train").unionByName(
        test.selectExpr("*", "false AS is_train")
    )


@query
def bernoulli_sample(t):
    return Z.bernoulli_sample(t.trips, 0.25, 11, "trip_id")


@query
def top_demand(t):
    return D.top_demand(_zone_demand(t), 10)


@query
def union_cells(t):
    """Feature rows of all cells in one table."""
    return Fe.grid_features(_cell_demand(t), t.slots, GRID5)


# --- joins, demand, look-ups -----------------------------------------------

@query
def combine_cluster(t):
    trips = t.trips
    return D.combine(ts.assign_slots(trips, t.slots), Z.assign_zones(trips, _centroids(t)))


@query
def grid_combined(t):
    trips = t.trips
    return D.combine_grid(Z.assign_cells(trips, CITY_GRID), ts.assign_slots(trips, t.slots))


@query
def demand_cluster(t):
    return _zone_demand(t)


@query
def demand_grid(t):
    return zoning.grid_demand(t.trips, t.hourly, CITY_GRID)


@query
def demand_grid_flat(t):
    inside = zoning.slots_and_cells(t.trips, t.slots, GRID100)
    return D.count_demand(
        inside, slot_id="pickup_slot",
        zone_id=GRID100.flatten("pickup_x", "pickup_y"),
    )


@query
def demand_calendar(t):
    joined = D.join_calendar(_zone_demand(t), extend_slots(t))
    return joined.orderBy("slot_id", "zone_id")


@query
def demand_slots(t):
    joined = D.join_slots(_zone_demand(t), _slot_table(t))
    return joined.orderBy("slot_id", "zone_id")


@query
def densify_demand(t):
    return D.fill_observed(materialize(_zone_demand(t, t.hourly), "demand"), t.hourly)


@query
def densify_calendar(t):
    return _fill(_zone_demand(t, t.hourly), t.hourly)


@query
def dense_features(t):
    """Existing feature rows completed with synthesised zero rows."""
    demand = materialize(_zone_demand(t, t.hourly), "demand")
    centroids = _centroids(t)
    dense = D.fill_calendar(demand, t.hourly, D.distinct_values(demand, "zone_id"))
    found = Fe.sparse_features(demand, t.hourly, centroids).drop("month")
    return Fe.fill_features(found, dense, t.hourly, centroids)


def _dropoff_keys(t):
    return t.trips.selectExpr(
        "trip_id", f"{t.slots.slot_of('dropoff_ts')} AS slot_id", "pickup_zone AS zone_id"
    )


@query
def lookup_demand(t):
    """Pickup demand at every trip's drop-off slot."""
    demand = materialize(_zone_demand(t), "demand")
    return D.lookup_demand(_dropoff_keys(t), demand).select(
        "trip_id", "slot_id", "zone_id", "demand"
    )


@query
def lookup_features(t):
    """Feature rows by (year, week, weekday, time, zone) of every drop-off."""
    features = Fe.with_calendar(_zone_demand(t), t.slots, "year")
    seen = _dropoff_keys(t).select("slot_id", "zone_id").distinct()
    keys = seen.selectExpr(*t.slots.fields(WEEK_KEYS), "zone_id")
    return D.lookup_features(keys, features)


@query
def lookup_features_grid(t):
    """Feature rows by (year, week, weekday, time, cell) of every drop-off."""
    features = Fe.grid_features(_cell_demand(t), t.slots, GRID5, "year")
    seen = zoning.slots_and_cells(t.trips, t.slots, GRID5).selectExpr(
        "dropoff_slot AS slot_id", "dropoff_y AS cell_y", "dropoff_x AS cell_x"
    ).distinct()
    keys = seen.selectExpr(*t.slots.fields(WEEK_KEYS), "cell_y", "cell_x")
    return D.lookup_features(keys, features)


@query
def distinct_zones(t):
    return D.distinct_values(_zone_demand(t), "zone_id")


@query
def zone_counts(t):
    return D.zone_counts(t.trips)


# --- features --------------------------------------------------------------

@query
def features_cluster(t):
    """Dense hourly features of the centroid zones."""
    centroids = _centroids(t)
    located = _located(t, t.hourly, centroids)
    demand = D.count_demand(located, slot_id="pickup_slot", zone_id="pickup_zone")
    demand = materialize(demand, "demand")
    zones = centroids.select("zone_id")
    return Fe.zone_features(D.fill_calendar(demand, t.hourly, zones), t.hourly, centroids)


@query
def features_grid(t):
    """Dense hourly features of every cell of the grid, known from its size."""
    zones = t.spark.range(GRID5.cells).selectExpr("CAST(id AS INT) AS zone_id")
    dense = D.fill_calendar(materialize(_cell_demand(t, t.hourly), "demand"), t.hourly, zones)
    return Fe.grid_features(dense, t.hourly, GRID5)


@query
def features_sparse(t):
    centroids = _centroids(t)
    located = _located(t, t.slots, centroids)
    demand = D.count_demand(located, slot_id="pickup_slot", zone_id="pickup_zone")
    return Fe.sparse_features(demand, t.slots, centroids)


@query
def zone_train_test(t):
    """Training and test features of one zone, label last."""
    rows = Fe.with_calendar(_zone_demand(t), t.slots).filter("zone_id = 12")
    is_train = f"{splits.before_week(t.slots, t.test_start)} AS is_train"
    return rows.selectExpr(*Fe.LAYOUT_CALENDAR, "demand", is_train)


@query
def assemble_features(t):
    """The nine-feature vector of every sparse feature row, spread to columns."""
    rows = Fe.assemble(features_sparse(t))
    return rows.withColumn("v", vector_to_array("features")).selectExpr(
        "slot_id", "zone_id", *[f"v[{i}] AS f{i}" for i in range(len(Fe.LAYOUT_GLOBAL))]
    )


# --- profiles --------------------------------------------------------------

@rounded
def mean_profile_global(t):
    sums = _profile_sums(t)
    profile = profiles.global_profile(sums, t.slots, t.split)
    return profiles.score_global_profile(sums, profile, t.slots, t.split)


@query
def mean_profile_global_table(t):
    profile = profiles.global_profile(_profile_sums(t), t.slots, t.split)
    return profile.withColumn("prediction", F.expr("round(prediction, 6)"))


@rounded
def mean_profile_zone(t):
    profile = profiles.zone_profile(
        profiles.profile_sums(_zone_demand(t), t.slots, t.split), t.slots, t.split
    )
    return profiles.score_zone_profile(profile, t.slots, t.split)


@rounded
def mean_profile_cell(t):
    """The flagship: trips to cells to profile to scores, in one pass."""
    sums = profiles.profile_sums(_cell_demand(t), t.slots, t.split)
    scored = profiles.score_zone_profile(profiles.zone_profile(sums, t.slots, t.split), t.slots, t.split)
    return scored.selectExpr(
        f"{GRID5.x_of()} AS cell_x", f"{GRID5.y_of()} AS cell_y", "n", "rmse", "r2"
    )


@query
def mean_profile_predict(t):
    """Zone profile predictions next to the demand of every hourly test slot."""
    split = t.hourly.first_slot_of(t.test_start)
    dense = Fe.with_calendar(_fill(_zone_demand(t, t.hourly), t.hourly), t.hourly)
    dense = materialize(dense, "rows")
    train = dense.filter(f"slot_id < {split}").select("slot_id", "zone_id", "demand")
    profile = profiles.zone_profile(
        profiles.profile_sums(train, t.hourly, split), t.hourly, split
    )
    test = dense.filter(f"slot_id >= {split}")
    return profiles.predict(test, profile, "zone_id").selectExpr(
        "slot_id", "zone_id", "demand", "round(prediction, 6) AS prediction"
    )


@rounded
def mean_rows_zone(t):
    sums = profiles.profile_sums(_zone_demand(t), t.slots, t.split)
    return profiles.score_existing_rows(profiles.row_means(sums))


@query
def mean_of_means(t):
    profile = profiles.mean_of_means(_profile_sums(t))
    return profile.withColumn("prediction", F.expr("round(prediction, 6)"))


@rounded
def mean_of_means_scored(t):
    sums = _profile_sums(t)
    return profiles.score_pooled_rows(sums, profiles.mean_of_means(sums))


@rounded
def constant_rmse(t):
    """Guessing 0 and 1 on the test part of a reproducible 70/30 split."""
    rows = splits.by_key(_zone_demand(t), "slot_id", 70)
    return E.constant_rmse(rows.filter("NOT is_train"), [0.0, 1.0])


# --- linear models ---------------------------------------------------------

@query
def ols_zone(t):
    model = linear.fit_panel_line(_zone_panel(t), "time_of_day_code")
    return model.selectExpr(
        "zone_id", "n_train", "round(slope, 6) AS slope", "round(intercept, 6) AS intercept"
    )


@rounded
def ols_zone_scored(t):
    return linear.score_panel_line(_zone_panel(t), "time_of_day_code")


@query
def ols_zone_two(t):
    """Regression on weekday and time of day for every zone."""
    model = linear.fit_panel(_zone_panel(t), list(Fe.LAYOUT_WEEKDAY))
    return model.selectExpr(
        "zone_id", "n", "round(intercept, 6) AS intercept",
        *[f"round(coefficients[{i}], 6) AS b_{n}" for i, n in enumerate(Fe.LAYOUT_WEEKDAY)],
    )


@rounded
def ols_zone_multi(t):
    return linear.score_panel(_zone_panel(t), CALENDAR_LAYOUT)


@rounded
def ols_cell(t):
    """One-feature regression per grid cell, scored per cell and pooled."""
    return linear.score_panel_line(_cell_panel(t), "time_of_day_code")


@rounded
def ols_cell_multi(t):
    return linear.score_panel(_cell_panel(t), CELL_LAYOUT)


@rounded
def ols_global_scored(t):
    train, test = splits.by_week(_global_rows(t), t.hourly, t.test_start)
    return linear.global_regression(train, test, Fe.LAYOUT_GLOBAL)


@rounded
def ols_global_zones(t):
    """One exact nine-feature regression for all zones, scored per zone."""
    return linear.score_panel_global(_global_panel(t), list(Fe.LAYOUT_GLOBAL))


@rounded
def ols_global_exact(t):
    """One regression for all zones from a single aggregation, pooled score."""
    return linear.score_panel_global(_zone_panel(t), list(Fe.LAYOUT_WEEKDAY), pooled_only=True)


# --- trees -----------------------------------------------------------------

@rounded
def tree_split_zone(t):
    """The first split of every zone's tree."""
    found = trees.panel_splits(_zone_panel(t, written=True), CALENDAR_LAYOUT)
    return found.select("zone_id", "n", "feature", "threshold", "gain")


@rounded
def tree_zone_depth3(t):
    """Every node of every zone's depth-3 tree."""
    return trees.grow_panel(_zone_panel(t, written=True), CALENDAR_LAYOUT, 3)


@rounded
def tree_zone_scored(t):
    return trees.score_panel(_zone_panel(t, written=True), CALENDAR_LAYOUT, 3)


@rounded
def tree_cell_scored(t):
    return trees.score_panel(_cell_panel(t, written=True), CELL_LAYOUT, 3)


@rounded
def tree_all_zones(t):
    """One exact depth-3 tree over all zones, as a node table."""
    return trees.grow_panel(_zone_panel(t, written=True), ["zone_id", *CALENDAR_LAYOUT], 3, grouped=False)


@rounded
def tree_global(t):
    """One binned depth-3 tree for all zones, scored per zone."""
    train, test = splits.by_week(_global_rows(t), t.hourly, t.test_start)
    return trees.score_model(trees.global_tree(train, Fe.LAYOUT_GLOBAL, 3), test, Fe.LAYOUT_GLOBAL)


@query
def tree_global_text(t):
    """The text dump of the depth-5 tree for all zones."""
    train, _ = splits.by_week(_global_rows(t), t.hourly, t.test_start)
    return trees.tree_text(train, trees.global_tree(train, Fe.LAYOUT_GLOBAL, 5))


@rounded
def tree_depth_sweep(t):
    """Scores at depths 2-8 and 10 from one growth of every zone's tree."""
    return trees.panel_depth_sweep(_zone_panel(t, t.hourly, written=True), CALENDAR_LAYOUT, [2, 3, 4, 5, 6, 7, 8, 10])


@rounded
def tree_default(t):
    """The default-depth tree on slot and zone, random 70/30 split."""
    train, test = splits.at_random(materialize(_zone_demand(t), "demand"), 0.7, 5, "slot_id", "zone_id")
    return trees.score_model(
        trees.global_tree(train, Fe.LAYOUT_SLOT_ZONE), test, Fe.LAYOUT_SLOT_ZONE
    )


@rounded
def forest(t):
    """A random forest on slot and zone, random 70/30 split."""
    train, test = splits.at_random(materialize(_zone_demand(t), "demand"), 0.7, 5, "slot_id", "zone_id")
    model = trees.global_forest(train, Fe.LAYOUT_SLOT_ZONE, seed=5)
    return trees.score_model(model, test, Fe.LAYOUT_SLOT_ZONE)


# --- neural networks, scaling ----------------------------------------------

@rounded
def mlp_zone(t):
    """A (10, 10) network per zone on hourly rows."""
    rows = Fe.with_calendar(_fill(_zone_demand(t, t.hourly), t.hourly), t.hourly)
    rows = rows.selectExpr("*", f"{splits.before_week(t.hourly, t.test_start)} AS is_train")
    return neural.score_networks(rows, CALENDAR_LAYOUT, layers=(10, 10), max_iter=1000)


@rounded
def mlp_cell(t):
    """A (5,) network per grid cell on hourly rows."""
    rows = Fe.grid_features(_fill(_cell_demand(t, t.hourly), t.hourly), t.hourly, GRID5)
    rows = rows.selectExpr(
        "*", f"{splits.before_week(t.hourly, t.test_start)} AS is_train",
        f"{GRID5.flatten('cell_x', 'cell_y')} AS zone_id",
    )
    return neural.score_networks(rows, CELL_LAYOUT, layers=(5,), max_iter=2000)


@rounded
def mlp_leading(t):
    """Networks on sparse rows, the leading sixth of each zone held out."""
    rows = _zone_demand(t).filter(t.slots.inside())
    rows = splits.leading_fraction(rows, 0.1667)
    names = ["month", "day_of_week", "time_of_day_code"]
    rows = rows.selectExpr("*", *t.slots.fields(names))
    return neural.score_networks(
        rows, [*names, "zone_id"], layers=(10, 10), max_iter=1000, scale=True
    )


@query
def zscore_zone(t):
    rows = Fe.with_calendar(_fill(_zone_demand(t, t.hourly), t.hourly), t.hourly)
    scaled = E.zscores(materialize(rows, "rows"), "time_of_day_code", "day_of_week", "demand")
    names = ("time_of_day_code_z", "day_of_week_z", "demand_z")
    return scaled.selectExpr("slot_id", "zone_id", *[f"round({n}, 6) AS {n}" for n in names])


# --- evaluation, comparison, distribution ----------------------------------

def _hour_scores(t):
    return linear.score_panel_line(_zone_panel(t), "hour")


@rounded
def eval_rmse(t):
    return _hour_scores(t).filter("zone_id IS NOT NULL").drop("r2")


@rounded
def eval_r2(t):
    return _hour_scores(t).filter("zone_id IS NOT NULL").drop("rmse")


@rounded
def eval_rollup(t):
    return _hour_scores(t)


@rounded
def describe_zone(t):
    return E.describe(_model_rows(t), "zone_id")


@rounded
def describe_all(t):
    return E.describe(_model_rows(t))


@rounded
def metric_summary(t):
    return E.metric_summary(_metrics(t), "rmse", "r2")


@rounded
def compare_pair(t):
    """All six pairings of the four predictors."""
    metrics = materialize(_metrics(t), "metrics")
    result = None
    for i, a in enumerate(MODELS):
        for b in MODELS[i + 1:]:
            pair = C.compare_pair(metrics, a, b)
            result = pair if result is None else result.unionByName(pair)
    return result


@rounded
def compare_all(t):
    return C.compare_all(_metrics(t), MODELS)


@rounded
def compare_margin(t):
    metrics = materialize(_metrics(t), "metrics")
    result = None
    for i, a in enumerate(MODELS):
        for b in MODELS[i + 1:]:
            pair = C.compare_margin(metrics, a, b)
            result = pair if result is None else result.unionByName(pair)
    return result


def _value_counts(t):
    day = t.slots.resized(86400)
    return materialize(dist.value_counts(_zone_demand(t, day)), "values")


@rounded
def demand_hist(t):
    """Daily demand per zone in 20 bins."""
    return dist.histogram(_value_counts(t), 20)


@rounded
def fit_exponential(t):
    return dist.fit_exponential(_value_counts(t))


@rounded
def fit_pareto(t):
    return dist.fit_pareto(_value_counts(t))


# --- one model for all, scored apart ---------------------------------------

@rounded
def ols_zone_layout(t):
    """One regression per zone on the seven features of a zone."""
    return linear.score_panel(_global_panel(t), list(Fe.LAYOUT_ZONE))


@rounded
def ols_global_cells(t):
    """One exact regression for all cells, scored per cell and pooled."""
    return linear.score_panel_global(_flagged_cells(_cell_panel(t, written=True)), CELL_LAYOUT)


@rounded
def tree_global_cells(t):
    """One exact depth-3 tree for all cells, scored per cell and pooled."""
    return trees.score_panel(_flagged_cells(_cell_panel(t, written=True)), CELL_LAYOUT, 3, grouped=False)


@rounded
def tree_global_zones(t):
    """One exact depth-5 tree for all zones, scored per zone and pooled."""
    return trees.score_panel(_global_panel(t), list(Fe.LAYOUT_GLOBAL), 5, grouped=False)


# --- what must hold for random and iterative operators ----------------------

@query
def bernoulli_facts(t):
    """Per zone: trips, and whether the sample holds each at most once, nothing else, and a fair share."""
    drawn = bernoulli_sample(t).groupBy("trip_id").agg(F.count("*").alias("times"))
    joined = t.trips.select("trip_id", "pickup_zone").join(drawn, "trip_id", "full")
    return joined.groupBy(F.col("pickup_zone").alias("zone_id")).agg(*map(F.expr, (
        "count(*) AS n", "coalesce(max(times), 1) = 1 AS once",
        "abs(count(times) - 0.25D * count(*)) <= 6 * sqrt(0.25D * 0.75D * count(*)) AS fair",
    )))


@query
def split_random_facts(t):
    """Both random parts together: in how many parts each row is, and whether the share is fair."""
    both = materialize(split_random(t), "parts")
    fair = both.selectExpr(
        "abs(count_if(is_train) - 0.7D * count(*)) <= 6 * sqrt(0.7D * 0.3D * count(*))"
    ).scalar()
    rows = both.groupBy("slot_id", "zone_id", "demand").agg(F.count("*").alias("parts"))
    return rows.withColumn("fair", fair)


@query
def kmeans_facts(t):
    """Per centroid: whether it is the mean of the points nearest to it, as at the end of k-means."""
    trips = t.trips
    model = Z.train_kmeans(trips, k=8, seed=3)
    centroids = materialize(Z.centroid_table(trips, model), "centroids")
    points = {"zone_id": ("pickup_lon", "pickup_lat")}
    means = Z.nearest_zone(trips.select("pickup_lon", "pickup_lat"), centroids, points).groupBy("zone_id").agg(
        F.expr("avg(pickup_lon) AS lon"), F.expr("avg(pickup_lat) AS lat"), F.expr("count(*) AS n")
    )
    means = materialize(means, "means")
    off = "greatest(abs(lon - centroid_lon), abs(lat - centroid_lat))"
    return centroids.join(means, "zone_id", "left").withColumn(
        "n_points", means.selectExpr("sum(n)").scalar()
    ).selectExpr("zone_id", f"coalesce({off} < 1e-3, false) AS is_mean", "n_points")


@query
def zoning_clusters_facts(t):
    """Per observed slot of ``zoning_clusters``: its zones and their demand together."""
    return zoning_clusters(t).groupBy("slot_id").agg(*map(F.expr, (
        "count(*) AS n", "count(DISTINCT zone_id) AS zones", "sum(demand) AS demand",
    )))


def _fit_facts(model, train: DataFrame, rows: DataFrame, layout, tree: bool) -> DataFrame:
    """``zone_id, n`` of the scored rows, and what holds for the training rows of a library model.

    ``better``: its squared error is below that of the training mean. For a single
    tree also ``leaf_means``: each distinct prediction is the mean label of its rows.
    """
    fitted = model.transform(Fe.assemble(train, layout)).groupBy("prediction").agg(*map(F.expr, (
        "count(*) AS n", "CAST(sum(demand) AS DOUBLE) AS s", "sum(CAST(demand AS DOUBLE) * demand) AS s2",
    )))
    fitted = materialize(fitted, "fitted")
    error = "sum(s2 - 2 * prediction * s + n * prediction * prediction)"
    facts = {"better": f"{error} < sum(s2) - sum(s) * sum(s) / sum(n)"}
    if tree:
        facts["leaf_means"] = "max(abs(s / n - prediction)) < 1e-9"
    scored = trees.score_model(model, rows, layout).select("zone_id", "n")
    return scored.withColumns({k: fitted.selectExpr(v).scalar() for k, v in facts.items()})


@query
def tree_global_facts(t):
    train, test = splits.by_week(_global_rows(t), t.hourly, t.test_start)
    model = trees.global_tree(train, Fe.LAYOUT_GLOBAL, 3)
    return _fit_facts(model, train, test, Fe.LAYOUT_GLOBAL, tree=True)


@query
def tree_default_facts(t):
    """The default tree fitted on the random 70 percent; all rows are scored."""
    rows = materialize(_zone_demand(t), "demand")
    train = materialize(splits.at_random(rows, 0.7, 5, "slot_id", "zone_id")[0], "train")
    model = trees.global_tree(train, Fe.LAYOUT_SLOT_ZONE)
    return _fit_facts(model, train, rows, Fe.LAYOUT_SLOT_ZONE, tree=True)


@query
def forest_facts(t):
    """The forest fitted on the random 70 percent; all rows are scored."""
    rows = materialize(_zone_demand(t), "demand")
    train = materialize(splits.at_random(rows, 0.7, 5, "slot_id", "zone_id")[0], "train")
    model = trees.global_forest(train, Fe.LAYOUT_SLOT_ZONE, seed=5)
    return _fit_facts(model, train, rows, Fe.LAYOUT_SLOT_ZONE, tree=False)


def _network_facts(scores: DataFrame) -> DataFrame:
    known = "rmse IS NOT NULL AND NOT isnan(rmse) AND rmse >= 0"
    return scores.selectExpr("zone_id", "n_train", "n_test", f"{known} AS finite")


@query
def mlp_cell_facts(t):
    """Rows on either side per cell, and that its network came to a finite error."""
    return _network_facts(mlp_cell(t))


@query
def mlp_leading_facts(t):
    """As ``mlp_cell_facts`` for the sparse rows of zones."""
    return _network_facts(mlp_leading(t))


@rounded
def predictors_by_name(t):
    """The reports of both named predictors on the same rows."""
    panel = _zone_panel(t, written=True)
    n_train, n_test = t.split, t.slots.count - t.split
    both = [
        predictors.evaluate_panel(name, panel, CALENDAR_LAYOUT, n_train, n_test)
        for name in sorted(predictors.PANEL_PREDICTORS)
    ]
    return both[0].unionByName(both[1])


@query
def sql_over_views(t):
    """SQL over a table that the registry made a view."""
    registry = Registry(t.spark, scratch_path(t.spark, "tables"))
    registry.save(t.trips, "trips")
    view = registry.register("trips", f"trips_{uuid.uuid4().hex}")
    return t.spark.sql(
        f"SELECT date_format(pickup_ts, 'yyyy-MM-dd') AS day, count(*) AS n, max(dropoff_ts) AS last FROM {view} GROUP BY 1"
    )


@query
def demand_kept_on_disk(t):
    """Demand read twice from the executors' disks: each row with its share of the zone."""
    demand = files.keep_on_disk(_zone_demand(t))
    totals = demand.groupBy("zone_id").agg(F.sum("demand").alias("total"))
    return demand.join(totals, "zone_id")
