"""Every query: against its check statement, or for its shape and sanity."""

import math

import pytest
from compare import connect, difference

import __spark_entry__ as contract
from pulsegrid.plans import catalog
from pulsegrid.plans.catalog import QUERIES
from pulsegrid.plans.checks import CHECKS

ROWS_ONLY = sorted(set(QUERIES) - set(CHECKS))


@pytest.fixture(scope="module")
def duck(tiny):
    return connect(tiny)


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
    assert QUERIES.keys() <= contract.queries().keys()


def test_entry(spark):
    assert contract.entry(spark).count() == 26


def no_cross_join(df):
    """The frame, after a look at its plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    return df


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, duck, tiny, name):
    ours = no_cross_join(QUERIES[name](spark, tiny)).toPandas()
    assert difference(ours, duck.sql(CHECKS[name]).df()) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query(spark, tiny, name):
    rows = no_cross_join(QUERIES[name](spark, tiny)).collect()
    assert rows
    for row in rows:
        for key in ("rmse", "centroid_lon"):
            if key in row:
                assert math.isfinite(row[key])


@pytest.fixture(scope="module")
def shifted(spark, tiny, tmp_path_factory):
    """The same tables with every event three days later."""
    path = str(tmp_path_factory.mktemp("shifted"))
    events = spark.read.parquet(f"{tiny}/events.parquet")
    events.selectExpr(*[
        "ts + INTERVAL '3' DAY AS ts" if c == "ts" else c for c in events.columns
    ]).toPandas().to_parquet(f"{path}/events.parquet", coerce_timestamps="us")
    return path


def test_no_trip_is_lost_or_mislabelled_when_data_starts_on_another_day(spark, tiny, shifted):
    trips = spark.read.parquet(f"{tiny}/events.parquet").count()
    for name in ("densify_calendar", "demand_slots", "demand_calendar", "demand_cluster"):
        assert QUERIES[name](spark, shifted).selectExpr("sum(demand)").first()[0] == trips, name
    slots = QUERIES["slot_calendar"](spark, shifted)
    assert slots.count() == 30 * 144
    assert slots.filter("day_of_week <> weekday(slot_start)").count() == 0
    extended = QUERIES["extend_slots"](spark, shifted)
    assert extended.filter("day_of_week <> weekday(slot_start)").count() == 0


@pytest.mark.parametrize("name", [
    "time_slots", "extend_slots", "weekday_day_counts", "demand_calendar", "demand_slots", "split_by_week",
    "densify_calendar", "mean_profile_zone", "mean_profile_global", "ols_zone_scored",
])
def test_query_equals_sql_on_shifted_events(spark, shifted, name):
    ours = QUERIES[name](spark, shifted).toPandas()
    assert difference(ours, connect(shifted).sql(CHECKS[name]).df()) is None


@pytest.fixture(scope="module")
def new_year(spark, tiny, tmp_path_factory):
    """Events from 22 December on: the split lies in January."""
    return _moved(spark, tiny, tmp_path_factory, "new-year", "ts - INTERVAL '10' DAY AS ts")


@pytest.fixture(scope="module")
def two_years(spark, tiny, tmp_path_factory):
    """Every event again 371 days later, on the same weekday of an ISO week of the same number."""
    return _moved(spark, tiny, tmp_path_factory, "two-years", "explode(array(ts, ts + INTERVAL '371' DAY)) AS ts")


def _moved(spark, tiny, factory, name, ts):
    path = str(factory.mktemp(name))
    events = spark.read.parquet(f"{tiny}/events.parquet")
    moved = events.selectExpr(*[ts if c == "ts" else c for c in events.columns])
    # ids stay unique
    moved.selectExpr("* EXCEPT (event_id)", "CAST(row_number() OVER (ORDER BY event_id, ts) AS BIGINT) AS event_id").toPandas().to_parquet(
        f"{path}/events.parquet", coerce_timestamps="us"
    )
    return path


@pytest.mark.parametrize("name", [
    # the statements on six calendar features span them by four, which holds within one month only; test_panels has those
    "split_by_week", "zone_groups", "zone_train_test", "ols_zone_scored", "ols_zone_two", "ols_cell", "eval_rollup", "tree_zone_scored",
    "metric_summary", "calendar_lookup",
])
def test_query_equals_sql_across_a_new_year(spark, new_year, name):
    ours = QUERIES[name](spark, new_year).toPandas()
    assert difference(ours, connect(new_year).sql(CHECKS[name]).df()) is None


def test_training_lies_before_the_test_part_across_a_new_year(spark, new_year):
    rows = QUERIES["split_by_week"](spark, new_year)
    last, first = rows.selectExpr("max(IF(is_train, slot_id, NULL))", "min(IF(is_train, NULL, slot_id))").first()
    assert last < first


@pytest.mark.parametrize("name", ["calendar_lookup", "lookup_features", "lookup_features_grid", "slot_calendar"])
def test_query_equals_sql_on_two_years(spark, two_years, name):
    ours = QUERIES[name](spark, two_years)
    assert difference(ours.toPandas(), connect(two_years).sql(CHECKS[name]).df()) is None
    if name == "calendar_lookup":
        assert ours.count() == ours.select("year", "week", "day_of_week", "time_of_day_code").distinct().count()


@pytest.mark.parametrize("name", ["demand_cluster", "mean_profile_cell", "tree_zone_depth3"])
def test_input_partitioning_does_not_matter(spark, tiny, monkeypatch, name):
    before = QUERIES[name](spark, tiny).toPandas()
    plain = catalog.td.table
    monkeypatch.setattr(
        catalog.td, "table", lambda s, d, n: plain(s, d, n).repartition(11)
    )
    assert difference(QUERIES[name](spark, tiny).toPandas(), before) is None

