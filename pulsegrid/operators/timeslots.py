"""Slot tables, slot assignment and calendar profiles."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.slots import SlotSpec


def time_slots(spark: SparkSession, slots: SlotSpec) -> DataFrame:
    """``slot_id, slot_start, slot_end`` of every slot."""
    return spark.range(slots.count).selectExpr(
        "CAST(id AS INT) AS slot_id",
        f"{slots.start_of('id')} AS slot_start",
        f"{slots.end_of('id')} AS slot_end",
    )


def observed_spec(df: DataFrame, ts: str, width_seconds: int = 600) -> SlotSpec:
    """The whole days seen in column ``ts``, counted from the first midnight.

    Starts one job over one column. Without any timestamp there are no slots.
    """
    first, last = df.selectExpr(f"CAST({ts} AS DATE) AS d").selectExpr("min(d)", "max(d)").first()
    if first is None:
        return SlotSpec(date(1970, 1, 1), 0, width_seconds)
    return SlotSpec.between(first, last + timedelta(days=1), width_seconds)


def observed_slots(df: DataFrame, ts: str, width_seconds: int = 600) -> DataFrame:
    """The slot table that covers the whole days seen in column ``ts``."""
    return time_slots(df.sparkSession, observed_spec(df, ts, width_seconds))


def extend_slots(slots_table: DataFrame, slots: SlotSpec) -> DataFrame:
    """Weekday and time of day from the id alone, month from the start."""
    first_weekday, per_day = slots.origin.weekday(), slots.per_day
    return slots_table.selectExpr(
        "slot_id", "slot_start", "slot_end",
        f"CAST(floor({first_weekday} + slot_id / {per_day}) % 7 AS INT) AS day_of_week",
        f"CAST(slot_id % {per_day} AS INT) AS time_of_day_code",
        "month(slot_start) AS month",
    )


def slot_calendar(slots_table: DataFrame, width_seconds: int = 600) -> DataFrame:
    """All calendar fields of a slot table, read from the slot start."""
    seconds = "hour(slot_start) * 3600 + minute(slot_start) * 60"
    return slots_table.selectExpr(
        "slot_id", "slot_start", "slot_end",
        "month(slot_start) AS month",
        "extract(YEAROFWEEK FROM slot_start) AS year",
        "weekofyear(slot_start) AS week",
        "dayofmonth(slot_start) AS day",
        "weekday(slot_start) AS day_of_week",
        f"CAST(({seconds}) div {width_seconds} AS INT) AS time_of_day_code",
        "hour(slot_start) AS hour",
        "minute(slot_start) AS minute",
    )


def assign_slots(trips: DataFrame, slots: SlotSpec, strict: bool = False) -> DataFrame:
    """``trip_id, pickup_slot, dropoff_slot``; no join, no Python."""
    return trips.selectExpr(
        "trip_id",
        f"{slots.slot_of('pickup_ts', strict)} AS pickup_slot",
        f"{slots.slot_of('dropoff_ts', strict)} AS dropoff_slot",
    )


def weekday_day_counts(calendar: DataFrame, before: date | None = None,
                       since: date | None = None) -> DataFrame:
    """Number of distinct days per weekday in a date range of the calendar."""
    chosen = calendar
    if before is not None:
        chosen = chosen.filter(f"CAST(slot_start AS DATE) < DATE '{before}'")
    if since is not None:
        chosen = chosen.filter(f"CAST(slot_start AS DATE) >= DATE '{since}'")
    return chosen.groupBy("day_of_week").agg(
        F.expr("count(DISTINCT CAST(slot_start AS DATE)) AS days")
    )


def calendar_lookup(keys: DataFrame, calendar: DataFrame) -> DataFrame:
    """``day, hour, minute`` for ``(year, week, day_of_week, time_of_day_code)`` keys, of the ISO year.

    The four name one slot, also in a calendar of several years.
    """
    on = ["year", "week", "day_of_week", "time_of_day_code"]
    return keys.join(calendar.select(*on, "day", "hour", "minute"), on, "inner")


PROFILE_UNITS = {
    "month": "month({})", "week": "weekofyear({})", "hour": "hour({})",
    "weekday": "weekday({}) + 1",
}


def calendar_profile(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """Row counts per month, ISO week, hour or weekday (1 = Monday).

    A NULL timestamp forms its own group with count 0.
    """
    part = PROFILE_UNITS[unit].format(ts)
    return df.selectExpr(f"{part} AS {unit}").groupBy(unit).agg(F.expr(f"count({unit}) AS cnt"))
