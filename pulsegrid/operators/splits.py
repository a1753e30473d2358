"""Train/test splits."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from pulsegrid.functions.coins import coin
from pulsegrid.functions.slots import SlotSpec


def before_week(slots: SlotSpec, day: date) -> str:
    """True for training rows: slots before the ISO week that holds ``day``, also across a new year."""
    return f"(slot_id < {slots.first_slot_of_week(day)})"


def by_week(df: DataFrame, slots: SlotSpec, day: date) -> tuple[DataFrame, DataFrame]:
    """Training and test rows as two filters that reach the scan: before the ISO week of ``day``, and from it on."""
    split = slots.first_slot_of_week(day)
    return df.filter(f"slot_id < {split}"), df.filter(f"slot_id >= {split}")


def first_n(df: DataFrame, n: int) -> DataFrame:
    """Mark the first ``n`` rows of each zone in slot order as training rows."""
    rank = "row_number() OVER (PARTITION BY zone_id ORDER BY slot_id)"
    return df.selectExpr("*", f"{rank} <= {n} AS is_train")


def leading_fraction(df: DataFrame, fraction: float) -> DataFrame:
    """Mark the leading fraction of each zone's rows as *test* rows."""
    rank = "row_number() OVER (PARTITION BY zone_id ORDER BY slot_id)"
    size = f"CAST(count(*) OVER (PARTITION BY zone_id) * {float(fraction)!r}D AS INT)"
    return df.selectExpr("*", f"{rank} > {size} AS is_train")


def by_key(df: DataFrame, key: str, train_percent: int) -> DataFrame:
    """A reproducible split on the key's residue modulo 100."""
    return df.selectExpr("*", f"pmod({key}, 100) < {train_percent} AS is_train")


def at_random(df: DataFrame, train: float, seed: int, *key: str) -> tuple[DataFrame, DataFrame]:
    """A random split into two frames by a coin that each row's key tosses, the same in every run."""
    toss = f"{coin(seed, *key)} < {float(train)!r}D"
    return df.filter(toss), df.filter(f"NOT ({toss})")
