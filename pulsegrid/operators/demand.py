"""Demand counts, zero fill, joins and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.slots import SlotSpec


def combine(trip_times: DataFrame, trip_zones: DataFrame) -> DataFrame:
    """Slots and zones of the same trip from two stored tables."""
    return trip_times.join(trip_zones, "trip_id", "inner").select(
        "trip_id", "pickup_zone", "dropoff_zone", "pickup_slot", "dropoff_slot"
    )


def combine_grid(grid_trips: DataFrame, trip_times: DataFrame) -> DataFrame:
    """Trips that start and end inside the grid, with their slots."""
    inside = grid_trips.dropna(subset=["pickup_x", "pickup_y", "dropoff_x", "dropoff_y"])
    return inside.join(trip_times, "trip_id", "inner").select(
        "trip_id", "pickup_x", "pickup_y", "dropoff_x", "dropoff_y", "pickup_slot", "dropoff_slot"
    )


def count_demand(trips: DataFrame, **keys: str) -> DataFrame:
    """Trips per key, each key given as ``name="SQL expression"``.

    Counts are combined before the one shuffle, so a hot key costs one row
    per task.
    """
    columns = [F.expr(f"{expression} AS {name}") for name, expression in keys.items()]
    return trips.groupBy(*columns).agg(F.expr("count(*) AS demand"))


def fill_calendar(demand: DataFrame, slots: SlotSpec, zones: DataFrame) -> DataFrame:
    """Demand for every calendar slot of every zone, 0 where nothing happened.

    Works in day blocks: only (zone, day) rows are joined, and the dense rows
    appear in the final projection, after the last shuffle. A block holds at
    most one day of slots. Slots outside the calendar are not listed; take the
    calendar from the data (``timeslots.observed_spec``) to have none.
    """
    if not slots.count:
        return demand.select("slot_id", "zone_id", "demand").filter("false")
    blocks = zones.selectExpr(
        "zone_id", f"explode(sequence(0, {slots.days - 1})) AS day_index"
    )
    dense = _expand_blocks(demand.filter(slots.inside()), blocks, slots)
    return dense.filter(slots.inside())


def _expand_blocks(demand: DataFrame, blocks: DataFrame, slots: SlotSpec) -> DataFrame:
    """Dense rows of (zone, day) blocks.

    ``blocks`` may carry ``codes``, the slots of that day to fill; by default
    the whole day is filled.
    """
    seen = demand.groupBy("zone_id", F.expr(f"{slots.day_index()} AS day_index")).agg(
        F.expr(f"collect_list(struct({slots.time_of_day()} AS code, demand)) AS found")
    )
    wanted = "codes" if "codes" in blocks.columns else f"sequence(0, {slots.per_day - 1})"
    missing = f"array_except({wanted}, transform(found, e -> e.code))"
    zeros = f"transform({missing}, c -> struct(c AS code, 0L AS demand))"
    all_zero = f"transform({wanted}, c -> struct(c AS code, 0L AS demand))"
    entries = f"IF(found IS NULL, {all_zero}, concat(found, {zeros}))"
    return (
        blocks.join(seen, ["zone_id", "day_index"], "left")
        .selectExpr("zone_id", "day_index", f"explode({entries}) AS e")
        .selectExpr(
            f"CAST(day_index * {slots.per_day} + e.code AS INT) AS slot_id", "zone_id",
            "e.demand AS demand",
        )
    )


def fill_observed(demand: DataFrame, slots: SlotSpec) -> DataFrame:
    """Demand for every observed slot of every observed zone.

    ``demand`` is read three times; pass a written table. Observed slots are
    kept as one short array per day, so the key space is joined by day.
    """
    known = demand.filter("slot_id IS NOT NULL")
    per_day = known.groupBy(F.expr(f"{slots.day_index()} AS day_index")).agg(
        F.expr(f"collect_set({slots.time_of_day()}) AS codes")
    )
    # the list of observed days: a stray timestamp adds one day, not a range
    days = per_day.selectExpr("collect_list(day_index)").scalar()
    zones = demand.select("zone_id").filter("zone_id IS NOT NULL").distinct()
    blocks = zones.select("zone_id", F.explode(days).alias("day_index")).join(per_day, "day_index")
    return _expand_blocks(known, blocks, slots)


def join_calendar(demand: DataFrame, extended_slots: DataFrame) -> DataFrame:
    """Demand with the stored calendar; slots outside of it disappear."""
    return demand.join(extended_slots, "slot_id", "inner").select(
        "slot_id", "zone_id", "month", "day_of_week", "time_of_day_code", "demand"
    )


def join_slots(demand: DataFrame, slots_table: DataFrame) -> DataFrame:
    """Demand with slot start and end."""
    return demand.join(slots_table, "slot_id", "inner").select(
        "slot_id", "zone_id", "demand", "slot_start", "slot_end"
    )


def lookup_demand(keys: DataFrame, demand: DataFrame) -> DataFrame:
    """Demand of each (slot, zone) key, 0 when there is none.

    ``demand`` has one row per key, so repeated keys do not multiply rows. Pass
    it as a written table: its known size then decides between a broadcast,
    which leaves the keys in place, and a shuffled join whose hot keys AQE
    splits.
    """
    return keys.join(demand, ["slot_id", "zone_id"], "left").fillna(0, ["demand"])


def lookup_features(keys: DataFrame, features: DataFrame) -> DataFrame:
    """Feature rows for keys given by any subset of the feature columns.

    Keys without a feature row give no row.
    """
    return keys.join(features, keys.columns, "inner")


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def zone_counts(trips: DataFrame, zone: str = "pickup_zone") -> DataFrame:
    return trips.groupBy(F.col(zone).alias("zone_id")).agg(F.expr("count(*) AS cnt"))


def top_demand(demand: DataFrame, n: int) -> DataFrame:
    """The ``n`` zones with the most demand, lowest id first on a tie."""
    totals = demand.groupBy("zone_id").agg(F.expr("sum(demand) AS demand"))
    return totals.orderBy(F.desc("demand"), "zone_id").limit(n)


def groups_with_rows(df: DataFrame, minimum: int, *keys: str) -> DataFrame:
    """Groups that have at least ``minimum`` rows, with their size."""
    return df.groupBy(*keys).agg(F.expr("count(*) AS n")).filter(f"n >= {minimum}")


def groups_with_train_test(
    df: DataFrame, is_train: str, min_train: int, min_test: int
) -> DataFrame:
    """Zones with enough rows on both sides of a split."""
    return train_test_sizes(df, is_train).filter(
        f"n_train >= {min_train} AND n_test >= {min_test}"
    )


def train_test_sizes(df: DataFrame, is_train: str) -> DataFrame:
    """Rows per zone on both sides of a split."""
    return df.groupBy("zone_id").agg(
        F.expr(f"count_if({is_train}) AS n_train"), F.expr(f"count_if(NOT ({is_train})) AS n_test")
    )


def index_slice(demand: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows ``start <= row_index < stop`` in (slot, zone) order.

    Row positions come from counts per slot; only slots that overlap the
    range are numbered, each on its own (at most one row per zone), so no
    task ever sorts the whole table. ``demand`` is read twice; pass a written
    table.
    """
    counts = demand.groupBy("slot_id").agg(F.expr("count(*) AS rows"))
    counts = counts.selectExpr("slot_id", "rows", "floor(slot_id / 4096) AS block")
    blocks = counts.groupBy("block").agg(F.expr("sum(rows) AS rows")).selectExpr(
        "block", "sum(rows) OVER (ORDER BY block) - rows AS before_block"
    )
    offsets = (
        counts.selectExpr(
            "*", "sum(rows) OVER (PARTITION BY block ORDER BY slot_id) - rows AS in_block"
        )
        .join(blocks, "block")
        .selectExpr("slot_id", "before_block + in_block AS first", "rows")
        .filter(f"first < {stop} AND first + rows > {start}")
    )
    rank = "row_number() OVER (PARTITION BY slot_id ORDER BY zone_id) - 1"
    return (
        demand.join(offsets, "slot_id")
        .selectExpr(f"first + {rank} AS row_index", "slot_id", "zone_id", "demand")
        .filter(f"row_index >= {start} AND row_index < {stop}")
    )
