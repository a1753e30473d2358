"""Mean demand profiles per weekday and hour, fitted and scored from sums.

A profile predicts one value per (weekday, hour). Its squared error over all
slots of such a cell is ``n p^2 - 2 p sum(y) + sum(y^2)``, where the number of
slots ``n`` is known from the calendar. So one aggregation of the *sparse*
demand gives fit and scores; the zero-filled table is never built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.slots import SlotSpec
from pulsegrid.functions.scores import sums_from_powers
from pulsegrid.operators.evaluate import score_moments

CELL = ("day_of_week", "hour")


def profile_sums(demand: DataFrame, slots: SlotSpec, first_test_slot: int) -> DataFrame:
    """Per zone, weekday and hour: training and test sums of the demand."""
    train, test = f"slot_id < {first_test_slot}", f"slot_id >= {first_test_slot}"
    keys = ["zone_id", *slots.fields(CELL)]
    return demand.filter(slots.inside()).groupBy(*map(F.expr, keys)).agg(*map(F.expr, (
        f"count_if({train}) AS train_rows",
        f"sum(IF({train}, demand, 0)) AS train_sum",
        f"count_if({test}) AS test_rows",
        f"sum(IF({test}, demand, 0)) AS test_sum",
        f"sum(IF({test}, CAST(demand AS DOUBLE) * demand, 0D)) AS test_sum2",
    )))


def _slots_in_cell(slots: SlotSpec, first: int, stop: int) -> str:
    """Calendar slots of a row's (weekday, hour) between two slot ids."""
    counts = (str(days * slots.per_hour) for days in slots.weekday_days(first, stop))
    return f"array({', '.join(counts)})[day_of_week]"


def zone_profile(sums: DataFrame, slots: SlotSpec, first_test_slot: int) -> DataFrame:
    """Per-slot mean of each zone's training days, zeros included."""
    n = _slots_in_cell(slots, 0, first_test_slot)
    return sums.selectExpr("*", f"coalesce(try_divide(train_sum, {n}), 0D) AS prediction")


def global_profile(sums: DataFrame, slots: SlotSpec, first_test_slot: int) -> DataFrame:
    """Per-slot mean over all zones, one row per (weekday, hour)."""
    n = _slots_in_cell(slots, 0, first_test_slot)
    zones = sums.selectExpr("count(DISTINCT zone_id)").scalar()
    cells = sums.groupBy(*CELL).agg(F.expr("sum(train_sum) AS train_sum"))
    return cells.withColumn("zones", zones).selectExpr(
        *CELL, f"coalesce(try_divide(train_sum, {n} * zones), 0D) AS prediction"
    )


def row_means(sums: DataFrame) -> DataFrame:
    """Mean of the existing training rows only; no row, prediction 0."""
    return sums.selectExpr("*", "coalesce(try_divide(train_sum, train_rows), 0D) AS prediction")


def mean_of_means(sums: DataFrame) -> DataFrame:
    """The zones' row means averaged over every zone that has training rows."""
    zones = sums.filter("train_rows > 0").selectExpr("count(DISTINCT zone_id)").scalar()
    totals = row_means(sums).groupBy(*CELL).agg(F.expr("sum(prediction) AS total"))
    return totals.withColumn("zones", zones).selectExpr(
        *CELL, "coalesce(try_divide(total, zones), 0D) AS prediction"
    )


def _cell_moments(cells: DataFrame, n: str) -> DataFrame:
    p = "prediction"
    return cells.groupBy("zone_id").agg(*map(F.expr, (
        f"sum({n}) AS n",
        f"sum({n} * {p} * {p} - 2 * {p} * test_sum + test_sum2) AS sse",
        "CAST(sum(test_sum) AS DOUBLE) AS sum_y",
        "CAST(sum(test_sum2) AS DOUBLE) AS sum_y2",
    )))


def score_zone_profile(profile: DataFrame, slots: SlotSpec, first_test_slot: int) -> DataFrame:
    """RMSE and R2 per zone over every test slot, plus the pooled row.

    Cells a zone never used predict 0 for a label of 0 and add only to ``n``.
    """
    sums = _cell_moments(profile, _slots_in_cell(slots, first_test_slot, slots.count))
    whole = f"{slots.count - first_test_slot}L"
    powers = sums_from_powers(whole, "sse", "sum_y", "sum_y2")
    return score_moments(sums.selectExpr("zone_id", *powers), "zone_id")


def score_global_profile(sums: DataFrame, profile: DataFrame, slots: SlotSpec,
                         first_test_slot: int) -> DataFrame:
    """As ``score_zone_profile`` for one profile shared by all zones.

    A zone's unused cells still get a non-zero prediction; their error is the
    same for every zone, so it is summed once and corrected per used cell.
    """
    n = _slots_in_cell(slots, first_test_slot, slots.count)
    empty_error = profile.selectExpr(f"sum({n} * prediction * prediction)").scalar()
    used = sums.join(profile, list(CELL)).groupBy("zone_id").agg(*map(F.expr, (
        "sum(test_sum2 - 2 * prediction * test_sum) AS used",
        "CAST(sum(test_sum) AS DOUBLE) AS sum_y",
        "CAST(sum(test_sum2) AS DOUBLE) AS sum_y2",
    )))
    scored = used.withColumn("empty_error", empty_error).selectExpr(
        "zone_id",
        *sums_from_powers(f"{slots.count - first_test_slot}L", "(used + empty_error)", "sum_y", "sum_y2"),
    )
    return score_moments(scored, "zone_id")


def score_existing_rows(profile: DataFrame) -> DataFrame:
    """Scores over the test rows that exist, as ``row_means`` is defined."""
    sums = _cell_moments(profile, "test_rows").filter("n > 0")
    powers = sums_from_powers("n", "sse", "sum_y", "sum_y2")
    return score_moments(sums.selectExpr("zone_id", *powers), "zone_id")


def score_pooled_rows(sums: DataFrame, profile: DataFrame) -> DataFrame:
    """One pooled score of a shared profile over the test rows that exist."""
    scored = score_existing_rows(sums.join(profile, list(CELL)))
    return scored.filter("zone_id IS NULL").drop("zone_id")


def predict(rows: DataFrame, profile: DataFrame, *keys: str) -> DataFrame:
    """Attach a profile's prediction to feature rows; unknown cells give 0."""
    on = [*keys, *CELL]
    return rows.join(profile.select(*on, "prediction"), on, "left").fillna(0.0, ["prediction"])
