"""Named tables: logical name -> location, format and schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pulsegrid.sources import files


def _schema(**fields: str) -> T.StructType:
    """``name="type"`` pairs; a trailing ``!`` marks a column not nullable."""
    kinds = {
        "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
        "timestamp": T.TimestampNTZType(),
    }
    return T.StructType(
        [T.StructField(n, kinds[k.rstrip("!")], not k.endswith("!")) for n, k in fields.items()]
    )


TRIPS = _schema(
    trip_id="bigint!", pickup_ts="timestamp", dropoff_ts="timestamp",
    pickup_lon="double", pickup_lat="double", dropoff_lon="double", dropoff_lat="double",
)
TIME_SLOTS = _schema(slot_id="int!", slot_start="timestamp!", slot_end="timestamp!")
EXTENDED_SLOTS = _schema(
    slot_id="int!", slot_start="timestamp!", slot_end="timestamp!", month="int!", week="int!",
    day="int!", day_of_week="int!", time_of_day_code="int!", hour="int!", minute="int!",
)
TRIP_TIMES = _schema(trip_id="bigint!", pickup_slot="int", dropoff_slot="int")
TRIP_ZONES = _schema(trip_id="bigint!", pickup_zone="int", dropoff_zone="int")
ZONES = _schema(zone_id="int!", centroid_lon="double", centroid_lat="double")
COMBINED = _schema(
    trip_id="bigint!", pickup_zone="int", dropoff_zone="int", pickup_slot="int", dropoff_slot="int"
)
DEMAND = _schema(slot_id="int!", zone_id="int!", demand="bigint")
GRID_META = _schema(
    lon_min="double!", lon_max="double!", lat_min="double!", lat_max="double!",
    nx="int!", ny="int!", missing_value="int",
)
GRID_TRIPS = _schema(
    trip_id="bigint!", pickup_x="int", pickup_y="int", dropoff_x="int", dropoff_y="int"
)
SPARSE_FEATURES = _schema(
    slot_id="int!", zone_id="int!", month="int!", week="int!", day="int!", day_of_week="int!",
    time_of_day_code="int!", hour="int!", minute="int!", is_manhattan="int!", is_airport="int!",
    demand="bigint!",
)
FEATURES = _schema(
    slot_id="int!", zone_id="int!", time_of_day_code="int!", day_of_week="int!", day="int!",
    week="int!", hour="int!", minute="int!", is_manhattan="int!", is_airport="int!",
    demand="bigint!",
)
GRID_FEATURES = _schema(
    slot_id="int!", cell_x="int!", cell_y="int!", time_of_day_code="int!", day_of_week="int!",
    day="int!", week="int!", hour="int!", minute="int!", is_manhattan="int!", is_airport="int!",
    demand="bigint!",
)


@dataclass(frozen=True)
class TableSpec:
    """One logical table below a root folder."""

    name: str
    schema: T.StructType
    path: str
    format: str = "parquet"

    def with_suffix(self, suffix: str) -> "TableSpec":
        """The same table of another run, e.g. another zone count."""
        return TableSpec(self.name + suffix, self.schema, self.path + suffix, self.format)


DEFAULT_TABLES = {
    spec.name: spec
    for spec in (
        TableSpec("trips", TRIPS, "trips", "csv"),
        TableSpec("time_slots", TIME_SLOTS, "time_slots"),
        TableSpec("extended_slots", EXTENDED_SLOTS, "extended_slots"),
        TableSpec("trip_times", TRIP_TIMES, "trip_times"),
        TableSpec("trip_zones", TRIP_ZONES, "clusters/trip_zones"),
        TableSpec("zones", ZONES, "clusters/zones"),
        TableSpec("combined", COMBINED, "clusters/combined"),
        TableSpec("demand", DEMAND, "clusters/demand"),
        TableSpec("sparse_features", SPARSE_FEATURES, "clusters/sparse_features"),
        TableSpec("features", FEATURES, "clusters/features"),
        TableSpec("grid_meta", GRID_META, "grids/meta"),
        TableSpec("grid_trips", GRID_TRIPS, "grids/trips"),
        TableSpec("grid_features", GRID_FEATURES, "grids/features"),
    )
}


class Registry:
    """Resolves, reads and registers tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str, tables=None) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.tables = dict(DEFAULT_TABLES if tables is None else tables)

    def spec(self, name: str) -> TableSpec:
        if name not in self.tables:
            raise KeyError(f"unknown table {name!r}; known: {sorted(self.tables)}")
        return self.tables[name]

    def add(self, spec: TableSpec) -> None:
        self.tables[spec.name] = spec

    def path(self, name: str) -> str:
        return f"{self.root}/{self.spec(name).path}"

    def load(self, name: str) -> DataFrame:
        spec = self.spec(name)
        return files.read_table(self.spark, self.path(name), spec.schema, spec.format)

    def save(self, df: DataFrame, name: str) -> None:
        spec = self.spec(name)
        files.write_table(df.select(*spec.schema.fieldNames()), self.path(name), spec.format)

    def register(self, name: str, view: str | None = None) -> str:
        """Make the table available to SQL; returns the view name."""
        view = view or name
        self.load(name).createOrReplaceTempView(view)
        return view
