"""Trip-like views over the supplied test tables.

``events`` has times but no places, so coordinates are computed from the event
id with arithmetic that any SQL engine repeats exactly.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.grid import GridSpec, double
from pulsegrid.functions.slots import SlotSpec
from pulsegrid.operators.timeslots import observed_spec

# Models train on the first three weeks of the calendar.
TRAIN_DAYS = 21

# A box around every point of ``trips``; its cells seed the centroid table.
SEED_GRID = GridSpec(-74.2, -73.65, 40.55, 40.9, nx=10, ny=12)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """The tables of one folder, and the calendar their trips cover.

    One slot origin serves slot tables, demand and models: the first midnight
    seen in ``events``. It is looked up once, when a query first needs it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def trips(self) -> DataFrame:
        return trips(self.spark, self.sf_dir)

    @cached_property
    def slots(self) -> SlotSpec:
        return observed_spec(self.table("events"), "ts", 600)

    @property
    def hourly(self) -> SlotSpec:
        return self.slots.resized(3600)

    @property
    def test_start(self) -> date:
        return self.slots.origin + timedelta(days=TRAIN_DAYS)

    @property
    def split(self) -> int:
        """The first test slot."""
        return self.slots.first_slot_of(self.test_start)

    def week_split(self, slots: SlotSpec) -> int:
        """The first test slot of a split by week: the start of the ISO week in which the test part starts."""
        return slots.first_slot_of_week(self.test_start)


def _coordinate(low: float, span: float, multiplier: int) -> str:
    # reduced first so that the product cannot overflow
    fraction = f"CAST((event_id % 1000 * {multiplier}) % 1000 AS DOUBLE)"
    return f"{double(low)} + {double(span)} * {fraction} / 1000D"


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trips; points lie inside and outside the city grid."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS trip_id",
        "ts AS pickup_ts",
        "timestampadd(MINUTE, event_id % 60, ts) AS dropoff_ts",
        f"{_coordinate(-74.2, 0.55, 7919)} AS pickup_lon",
        f"{_coordinate(40.55, 0.35, 104729)} AS pickup_lat",
        f"{_coordinate(-74.2, 0.55, 15485863)} AS dropoff_lon",
        f"{_coordinate(40.55, 0.35, 32452843)} AS dropoff_lat",
        "CAST(user_id % 40 AS INT) AS pickup_zone",
    )


def seed_centroids(trips: DataFrame) -> DataFrame:
    """The middle of the pickup points of each seed cell, as a zone table."""
    cell = SEED_GRID.cell_id("pickup_lon", "pickup_lat")
    return (
        trips.groupBy(F.expr(f"{cell} AS zone_id"))
        .agg(
            F.expr("(min(pickup_lon) + max(pickup_lon)) / 2 AS centroid_lon"),
            F.expr("(min(pickup_lat) + max(pickup_lat)) / 2 AS centroid_lat"),
        )
        .filter("zone_id IS NOT NULL")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole vectors of ``embeddings`` in double precision."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "label", "CAST(embedding AS ARRAY<DOUBLE>) AS vector"
    )
