"""Zero fill, slices, splits and look-ups, including hot keys."""

from datetime import date

from pyspark.sql import functions as F

from pulsegrid.functions.slots import SlotSpec
from pulsegrid.operators import demand as D
from pulsegrid.operators import features as Fe
from pulsegrid.operators import splits
from pulsegrid.plans import zoning
from pulsegrid.sources import testdata as td

SLOTS = SlotSpec.between(date(2024, 1, 1), date(2024, 1, 4), 3600)
MONTH = SlotSpec.between(date(2024, 1, 1), date(2024, 1, 31), 600)


def hot_demand(spark):
    """60 zones, zone 5 has demand in nearly every slot."""
    return spark.range(4000).selectExpr(
        "CAST(IF(id % 3 = 0, 5, id % 90) AS INT) AS zone_id",
        "CAST((id * 7) % 72 AS INT) AS slot_id",
    ).groupBy("slot_id", "zone_id").agg(F.expr("count(*) AS demand"))


def test_fill_calendar_is_complete_and_keeps_totals(spark):
    demand = hot_demand(spark)
    dense = D.fill_calendar(demand, SLOTS, D.distinct_values(demand, "zone_id"))
    row = dense.selectExpr(
        "count(*)", "count(DISTINCT slot_id, zone_id)", "sum(demand)", "min(slot_id)", "max(slot_id)"
    ).first()
    assert tuple(row) == (72 * 60, 72 * 60, 4000, 0, 71)
    kept = dense.filter("demand > 0").select("slot_id", "zone_id", "demand")
    assert kept.exceptAll(demand.select(kept.columns)).count() == 0


def test_fill_calendar_drops_slots_outside_and_keeps_empty_zones(spark):
    demand = spark.createDataFrame(
        [(-5, 1, 3), (0, 1, 2), (71, 1, 1), (72, 1, 9), (10**6, 1, 4)],
        "slot_id int, zone_id int, demand bigint",
    )
    zones = spark.createDataFrame([(1,), (2,)], "zone_id int")
    dense = D.fill_calendar(demand, SLOTS, zones)
    totals = {r.zone_id: (r.n, r.s) for r in dense.groupBy("zone_id").agg(
        F.expr("count(*) AS n"), F.expr("sum(demand) AS s")).collect()}
    assert totals == {1: (72, 3), 2: (72, 0)}


def test_fill_calendar_with_a_part_day(spark):
    part = SlotSpec(date(2024, 1, 1), 30, 3600)
    demand = spark.createDataFrame([(29, 1, 3)], "slot_id int, zone_id int, demand bigint")
    dense = D.fill_calendar(demand, part, demand.select("zone_id"))
    assert (dense.count(), dense.agg(F.max("slot_id")).first()[0]) == (30, 29)


def test_fill_observed_uses_observed_keys_only(spark):
    demand = spark.createDataFrame(
        [(-30, 1, 3), (5, 2, 2), (500, 1, 1), (5, 3, 4), (2_000_000_000, 2, 6)],
        "slot_id int, zone_id int, demand bigint",
    )
    dense = D.fill_observed(demand, SLOTS)
    got = {(r.slot_id, r.zone_id): r.demand for r in dense.collect()}
    known = {(-30, 1): 3, (5, 2): 2, (500, 1): 1, (5, 3): 4, (2_000_000_000, 2): 6}
    slots = (-30, 5, 500, 2_000_000_000)
    assert got == {(s, z): known.get((s, z), 0) for s in slots for z in (1, 2, 3)}


def test_index_slice_follows_slot_zone_order(spark):
    demand = hot_demand(spark)
    ordered = sorted((r.slot_id, r.zone_id) for r in demand.collect())
    got = {r.row_index: (r.slot_id, r.zone_id) for r in D.index_slice(demand, 100, 1234).collect()}
    assert got == {i: ordered[i] for i in range(100, min(1234, len(ordered)))}


def test_splits(spark):
    demand = hot_demand(spark)
    rows = splits.leading_fraction(demand, 0.1667).collect()
    for zone in {r.zone_id for r in rows}:
        mine = sorted((r.slot_id, r.is_train) for r in rows if r.zone_id == zone)
        size = int(0.1667 * len(mine))
        assert [t for _, t in mine] == [False] * size + [True] * (len(mine) - size)
    first = splits.first_n(demand, 3).filter("is_train").groupBy("zone_id").count()
    assert first.agg(F.max("count")).first()[0] == 3
    train, test = splits.at_random(demand, 0.7, 1, "slot_id", "zone_id")
    assert train.count() + test.count() == demand.count()


def test_lookup_repeated_hot_key(spark):
    demand = hot_demand(spark)
    keys = spark.range(3000).selectExpr(
        "id", "CAST(IF(id % 3 = 0, 7, id % 72) AS INT) AS slot_id",
        "CAST(IF(id % 3 = 0, 5, 1000) AS INT) AS zone_id",
    )
    found = D.lookup_demand(keys, demand)
    assert found.count() == 3000
    assert found.filter("zone_id = 1000 AND demand <> 0").count() == 0
    hot = demand.filter("slot_id = 7 AND zone_id = 5").first()
    values = {r.demand for r in found.filter("zone_id = 5").select("demand").distinct().collect()}
    assert values == {hot.demand if hot else 0}


def test_groups_min_rows(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(2,)] * 2, "zone_id int")
    assert [tuple(r) for r in D.groups_with_rows(df, 3, "zone_id").collect()] == [(1, 3)]


def test_grid_demand_equals_kept_trips_in_any_partitioning(spark, tiny):
    trips = td.trips(spark, tiny)
    grid = td.SEED_GRID
    total = zoning.grid_demand(trips, MONTH, grid)
    kept = zoning.slots_and_cells(trips, MONTH, grid).count()
    assert total.agg(F.sum("demand")).first()[0] == kept
    shuffled = zoning.grid_demand(trips.repartition(13), MONTH, grid)
    assert total.exceptAll(shuffled).count() == 0


def test_one_pass_equals_stored_tables_join(spark, tiny):
    from pulsegrid.operators import timeslots as ts
    from pulsegrid.operators import zones as Z
    trips = td.trips(spark, tiny)
    centroids = td.seed_centroids(trips)
    joined = D.combine(ts.assign_slots(trips, MONTH), Z.assign_zones(trips, centroids))
    one_pass = zoning.slots_and_zones(trips, MONTH, centroids)
    assert joined.exceptAll(one_pass.select(joined.columns)).count() == 0


def test_cluster_job_keeps_its_tables_and_every_trip(spark, tiny, tmp_path):
    trips = td.trips(spark, tiny)
    keep = {"zones": str(tmp_path / "zones"), "combined": str(tmp_path / "combined")}
    centroids, demand = zoning.cluster_demand(trips, MONTH.resized(3600), k=6, seed=2, keep=keep)
    assert centroids.count() == spark.read.parquet(keep["zones"]).count() == 6
    combined = spark.read.parquet(keep["combined"])
    assert combined.count() == trips.count()
    row = demand.selectExpr(
        "sum(demand)", "count(*)", "count(DISTINCT slot_id) * count(DISTINCT zone_id)"
    ).first()
    assert row[0] == trips.count() and row[1] == row[2]


def test_fill_features_equals_features_of_filled_demand(spark):
    demand = hot_demand(spark)
    zones = spark.createDataFrame([(5, -74.0, 40.72)],
                                  "zone_id int, centroid_lon double, centroid_lat double")
    dense = D.fill_calendar(demand, SLOTS, D.distinct_values(demand, "zone_id"))
    sparse = Fe.sparse_features(demand, SLOTS, zones).drop("month")
    filled = Fe.fill_features(sparse, dense, SLOTS, zones)
    direct = Fe.zone_features(dense, SLOTS, zones)
    assert filled.exceptAll(direct.select(filled.columns)).count() == 0
    assert filled.count() == 72 * 60
