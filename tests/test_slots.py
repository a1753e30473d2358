"""Slot and calendar vectors computed by hand."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.slots import SlotSpec
from pulsegrid.operators import timeslots as ts

YEAR = SlotSpec.between(date(2015, 1, 1), date(2015, 6, 30))

STAMPS = [
    (datetime(2014, 12, 31, 23, 50), -1, -1),
    (datetime(2014, 12, 31, 23, 55), 0, -1),
    (datetime(2015, 1, 1), 0, 0),
    (datetime(2015, 1, 1, 0, 9, 59), 0, 0),
    (datetime(2015, 1, 1, 0, 10), 1, 1),
    (datetime(2015, 3, 8, 12), 9576, 9576),
    (datetime(2015, 6, 29, 23, 59, 59), 25919, 25919),
    (datetime(2015, 6, 30), 25920, 25920),
    (None, None, None),
]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_slot_of(spark, kind):
    rows = [(i, stamp) for i, (stamp, _, _) in enumerate(STAMPS)]
    df = spark.createDataFrame(rows, f"i int, t {kind}")
    found = df.selectExpr(
        "i", f"{YEAR.slot_of('t')} AS s", f"{YEAR.slot_of('t', strict=True)} AS f"
    ).orderBy("i").collect()
    assert [r.s for r in found] == [s for _, s, _ in STAMPS]
    assert [r.f for r in found] == [f for _, _, f in STAMPS]


def test_calendar_from_id_and_from_start_agree(spark):
    table = ts.time_slots(spark, YEAR)
    assert table.count() == 25920
    names = ["month", "week", "day", "day_of_week", "time_of_day_code", "hour", "minute"]
    by_start = ts.slot_calendar(table).select("slot_id", *names)
    by_id = table.selectExpr("slot_id", *YEAR.fields(names))
    assert by_start.exceptAll(by_id).count() == 0
    picked = by_id.filter("slot_id IN (0, 143, 144, 21743, 21744, 25919)").orderBy("slot_id")
    got = [(r.slot_id, r.day_of_week, r.time_of_day_code, r.week) for r in picked.collect()]
    assert got == [
        (0, 3, 0, 1), (143, 3, 143, 1), (144, 4, 0, 1), (21743, 6, 143, 22),
        (21744, 0, 0, 23), (25919, 0, 143, 27),
    ]
    extended = ts.extend_slots(table, YEAR).select("slot_id", "day_of_week", "time_of_day_code")
    assert extended.exceptAll(by_id.select(extended.columns)).count() == 0


def test_weekday_day_counts(spark):
    expected = [21, 21, 21, 22, 22, 22, 22]
    split = YEAR.first_slot_of(date(2015, 6, 1))
    assert YEAR.weekday_days(0, split) == expected
    assert sum(YEAR.weekday_days(split, YEAR.count)) == 29
    calendar = ts.slot_calendar(ts.time_slots(spark, YEAR))
    counts = ts.weekday_day_counts(calendar, before=date(2015, 6, 1)).orderBy("day_of_week")
    assert [r.days for r in counts.collect()] == expected


def test_whole_year_and_bad_width():
    assert SlotSpec.between(date(2015, 1, 1), date(2016, 1, 1)).count == 52560
    with pytest.raises(ValueError):
        SlotSpec(date(2015, 1, 1), 10, 7000)


def test_observed_slots_cover_whole_days(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 2, 28, 23, 59),), (datetime(2024, 3, 1, 0, 1),), (None,)],
        "t timestamp_ntz",
    )
    slots = ts.observed_slots(df, "t", 3600).orderBy("slot_id").collect()
    assert len(slots) == 72 and slots[0].slot_start == datetime(2024, 2, 28)
    assert slots[-1].slot_end == datetime(2024, 3, 2)
    assert ts.observed_slots(df.filter("t IS NULL"), "t").count() == 0


def test_profile_counts_null_timestamps_as_zero(spark):
    df = spark.createDataFrame([(datetime(2015, 6, 1),), (None,), (None,)], "t timestamp_ntz")
    rows = {r.weekday: r.cnt for r in ts.calendar_profile(df, "t", "weekday").collect()}
    assert rows == {1: 1, None: 0}


def test_session_zone_does_not_shift_slots(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(datetime(2015, 3, 8, 12),)], "t timestamp_ntz")
        assert df.select(F.expr(YEAR.slot_of("t"))).first()[0] == 9576
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
