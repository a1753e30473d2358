"""Feature tables: calendar fields and zone flags next to the demand."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from pulsegrid.functions.grid import FLAG_BOXES, GridSpec, flag_columns
from pulsegrid.functions.slots import SlotSpec
from pulsegrid.operators.zones import with_zone_flags

# The feature layouts of the predictors, in order.
LAYOUT_GLOBAL = (
    "time_of_day_code", "zone_id", "day_of_week", "day", "week", "hour", "minute",
    "is_manhattan", "is_airport",
)
LAYOUT_ZONE = (
    "time_of_day_code", "day_of_week", "day", "week", "hour", "is_manhattan", "is_airport",
)
LAYOUT_CALENDAR = ("time_of_day_code", "day_of_week", "day", "week", "hour", "minute")
LAYOUT_CELL = (
    "day", "day_of_week", "hour", "is_airport", "is_manhattan", "minute", "cell_y", "cell_x",
    "time_of_day_code", "week",
)
LAYOUT_SLOT_ZONE = ("slot_id", "zone_id")
LAYOUT_WEEKDAY = ("day_of_week", "time_of_day_code")


def with_calendar(demand: DataFrame, slots: SlotSpec, *more: str) -> DataFrame:
    """Calendar fields (and ``more`` of them) of every row, computed from the slot id alone."""
    return demand.selectExpr("slot_id", "zone_id", *slots.fields((*LAYOUT_CALENDAR, *more)), "demand")


def zone_features(demand: DataFrame, slots: SlotSpec, zones: DataFrame,
                  boxes=FLAG_BOXES) -> DataFrame:
    """Calendar fields and flags for every row of a zone demand table.

    Calendar fields are computed from the slot id; only the flags are joined.
    """
    flags = [box.name for box in boxes]
    return with_zone_flags(with_calendar(demand, slots), zones, boxes).select(
        "slot_id", "zone_id", *LAYOUT_CALENDAR, *flags, "demand"
    )


def sparse_features(demand: DataFrame, slots: SlotSpec, zones: DataFrame,
                    boxes=FLAG_BOXES) -> DataFrame:
    """As ``zone_features``, only for rows with demand inside the calendar."""
    seen = demand.filter(f"{slots.inside()} AND demand > 0")
    return zone_features(seen, slots, zones, boxes).selectExpr(
        "*", *slots.fields(("month",))
    )


def grid_features(demand: DataFrame, slots: SlotSpec, grid: GridSpec, *more: str,
                  boxes=FLAG_BOXES) -> DataFrame:
    """Calendar fields (and ``more`` of them) and flags for a demand table whose zones are cells.

    The flags look at the cell's corner; nothing is joined.
    """
    lon, lat = grid.corner_lon(grid.x_of()), grid.corner_lat(grid.y_of())
    return demand.selectExpr(
        "slot_id", f"{grid.x_of()} AS cell_x", f"{grid.y_of()} AS cell_y",
        *slots.fields((*LAYOUT_CALENDAR, *more)), *flag_columns(lon, lat, boxes), "demand",
    )


def fill_features(features: DataFrame, dense: DataFrame, slots: SlotSpec, zones: DataFrame,
                  boxes=FLAG_BOXES) -> DataFrame:
    """Existing feature rows, and a synthesised zero row for every other key.

    ``dense`` lists the wanted (slot, zone) keys.
    """
    names = [*LAYOUT_CALENDAR, *(box.name for box in boxes), "demand"]
    keys = dense.selectExpr("slot_id", "zone_id", "0L AS demand")
    made = zone_features(keys, slots, zones, boxes)
    found = features.selectExpr("slot_id", "zone_id", *[f"{n} AS found_{n}" for n in names])
    joined = made.join(found, ["slot_id", "zone_id"], "left")
    return joined.selectExpr(
        "slot_id", "zone_id", *[f"coalesce(found_{n}, {n}) AS {n}" for n in names]
    )


def without_keys(features: DataFrame) -> DataFrame:
    """Model input only: drop the slot and zone keys."""
    return features.drop("slot_id", "zone_id")


def assemble(features: DataFrame, layout=LAYOUT_GLOBAL) -> DataFrame:
    """Add the vector column ``features`` in the given column order."""
    return VectorAssembler(inputCols=list(layout), outputCol="features").transform(features)


def cell_zones(cells: DataFrame, grid: GridSpec, boxes=FLAG_BOXES) -> DataFrame:
    """``cell_x, cell_y`` and flags of flattened cells (``zone_id``), the zone table of a panel of cells."""
    lon, lat = grid.corner_lon(grid.x_of()), grid.corner_lat(grid.y_of())
    return cells.selectExpr(f"{grid.x_of()} AS cell_x", f"{grid.y_of()} AS cell_y", *flag_columns(lon, lat, boxes))
