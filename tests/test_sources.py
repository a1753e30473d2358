"""Registry, files, reports and the options of a database snapshot."""

import os
import glob

import pytest

from pulsegrid.functions.grid import CITY_GRID
from pulsegrid.sources import files, jdbc
from pulsegrid.sources import testdata as td
from pulsegrid.sources.registry import TRIPS, Registry, TableSpec
from pulsegrid.plans.catalog import QUERIES
from pulsegrid.workspace import app_dir, clear, materialize, scope, scratch_path, shared_dir


def test_registry_round_trip(spark, tiny, tmp_path):
    registry = Registry(spark, str(tmp_path))
    trips = td.trips(spark, tiny).drop("pickup_zone")
    registry.save(trips, "trips")
    assert registry.spec("trips").format == "csv"
    back = registry.load("trips")
    assert back.exceptAll(trips).count() == 0 and back.count() == trips.count()
    registry.register("trips", "trips_view")
    assert spark.sql("SELECT count(*) FROM trips_view").first()[0] == trips.count()
    registry.add(TableSpec("trips", TRIPS, "trips").with_suffix("_200"))
    assert registry.path("trips_200").endswith("/trips_200")
    with pytest.raises(KeyError):
        registry.load("nowhere")
    with pytest.raises(ValueError):
        files.read_table(spark, str(tmp_path), TRIPS, "avro")


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_a_failed_write_leaves_the_old_table(spark, tmp_path, format):
    path = str(tmp_path / "numbers")
    rows = spark.range(100).selectExpr("id", "id * 2 AS twice")
    read = lambda: sorted(tuple(r) for r in files.read_table(spark, path, rows.schema, format).collect())
    files.write_table(rows, path, format)
    before = read()
    broken = spark.range(0, 100, 1, 4).selectExpr("id", "IF(id = 99, CAST(raise_error('half-way') AS LONG), id) AS twice")
    with pytest.raises(Exception, match="half-way"):
        files.write_table(broken, path, format)
    assert read() == before == [(i, 2 * i) for i in range(100)]
    assert len(glob.glob(f"{path}/{files.VERSION}*")) == 1
    # a table written from its own rows, and a reader that began before
    reader = files.read_table(spark, path, rows.schema, format)
    files.write_table(reader.selectExpr("id", "twice + 1 AS twice"), path, format)
    assert read() == [(i, 2 * i + 1) for i in range(100)]
    assert reader.count() == 100
    files.write_table(rows.limit(3), path, format)
    assert len(read()) == 3 and len(glob.glob(f"{path}/{files.VERSION}*")) == 2


def test_other_folders_are_read_as_they_are(spark, tmp_path):
    rows = spark.range(10).toDF("id")
    rows.write.parquet(str(tmp_path / "plain"))
    for path in ("plain", "pl*n"):
        assert files.read_table(spark, str(tmp_path / path), rows.schema).count() == 10


def test_grid_meta_round_trip(spark, tmp_path):
    path = str(tmp_path / "grid")
    files.write_table(files.grid_meta(spark, CITY_GRID), path)
    assert files.read_grid_meta(spark, path) == CITY_GRID


def test_one_cell_is_pruned_to_its_folder(spark, tmp_path):
    path = str(tmp_path / "cells")
    df = spark.range(1000).selectExpr(
        # a third of all rows in one cell
        "id", "CAST(IF(id % 3 = 0, 1, id % 5) AS INT) AS cell_x", "CAST(id % 2 AS INT) AS cell_y"
    )
    files.write_by_cell(df, path)
    assert len(glob.glob(f"{path}/cell_x=*/cell_y=*")) == 10
    one = files.read_cell(spark, path, 1, 0)
    assert one.count() == df.filter("cell_x = 1 AND cell_y = 0").count()
    assert len(one.inputFiles()) <= 10
    assert all("/cell_x=1/cell_y=0/" in name for name in one.inputFiles())
    assert set(one.columns) == {"id", "cell_x", "cell_y"} and one.first().cell_x == 1
    none = files.read_cell(spark, path, 77, 0)
    assert none.count() == 0 and none.schema == one.schema


def test_dates_become_folders(spark, tiny, tmp_path):
    path = str(tmp_path / "dates")
    for _ in range(2):  # a second run changes nothing
        files.write_by_date(td.trips(spark, tiny), path, "pickup_ts")
    assert spark.read.parquet(path).count() == td.trips(spark, tiny).count()
    assert len(glob.glob(f"{path}/trip_date=*")) == 30


def test_snapshot_reads_in_parallel_ranges():
    options = jdbc.read_options(
        "jdbc:postgresql://host/db", "schema.trips", "id", 0, 77_000_000, 200, user="reader"
    )
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "200"
    assert options["user"] == "reader"
    with pytest.raises(ValueError):
        jdbc.read_options("u", "t", "id", 5, 5, 10)


def test_disk_table(spark):
    df = files.keep_on_disk(spark.range(10))
    assert df.storageLevel.useDisk and not df.storageLevel.useMemory
    df.unpersist()


def _tables(spark):
    folder = app_dir(spark).removeprefix("file:")
    return set(os.listdir(folder)) if os.path.exists(folder) else set()


@pytest.mark.parametrize("name", ["zone_train_test", "tree_zone_scored", "nearest_centroid", "src_csv_or_parquet", "demand_kept_on_disk", "lookup_demand"])
def test_nothing_is_left_of_a_query_in_a_scope(spark, tiny, name):
    before, frames = _tables(spark), spark.sparkContext._jsc.getPersistentRDDs().size()
    with scope(spark):
        assert QUERIES[name](spark, tiny).count() > 0
    assert _tables(spark) == before
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == frames


def test_scopes_hand_tables_on(spark):
    with scope(spark):
        with scope(spark) as inner:
            gone = materialize(spark.range(5), "gone")
            stays = inner.keep(materialize(gone.selectExpr("id + 1 AS id"), "stays"))
            disk = inner.keep(files.keep_on_disk(stays))
            with pytest.raises(ValueError):
                inner.keep(gone.select("id"))
        assert stays.count() == disk.count() == 5 and disk.storageLevel.useDisk
        with pytest.raises(Exception):
            gone.count()
    assert not disk.storageLevel.useDisk
    with pytest.raises(Exception):
        stays.count()
    before = _tables(spark)
    with pytest.raises(ZeroDivisionError), scope(spark):
        materialize(spark.range(5), "gone")
        1 / 0
    assert _tables(spark) == before


def test_a_scope_releases_only_what_it_kept(spark):
    mine = files.keep_on_disk(spark.range(11))  # without a scope
    with scope(spark):
        assert files.keep_on_disk(spark.range(11)).count() == 11
    assert mine.storageLevel.useDisk
    mine.unpersist()
    with scope(spark) as outer:
        first = files.keep_on_disk(spark.range(12))
        with scope(spark):
            assert files.keep_on_disk(spark.range(12)).count() == 12
        assert first.storageLevel.useDisk
        with scope(spark) as inner:  # one plan kept twice is handed on once
            files.keep_on_disk(spark.range(13))
            again = inner.keep(files.keep_on_disk(spark.range(13)))
        assert again.storageLevel.useDisk and len(outer.frames) == 3
    assert not first.storageLevel.useDisk and not again.storageLevel.useDisk


def test_a_cluster_needs_a_shared_folder():
    class Unset:
        def get(self, key, default=None):
            return default

    class Cluster:
        master, conf = "spark://host:7077", Unset()
        sparkContext = property(lambda self: self)
        getConf = Unset

    with pytest.raises(RuntimeError):
        shared_dir(Cluster())


def test_written_tables_live_in_the_shared_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    table = materialize(spark.range(10), "numbers")
    assert table.count() == 10
    folder = os.path.dirname(scratch_path(spark, "x").removeprefix("file:"))
    assert os.listdir(folder)
    clear(spark)
    assert not os.path.exists(folder)
