"""Panels: every slot of a calendar for every zone, with a label of 0 where nothing happened.

A panel is never written out row by row. Its calendar features are arithmetic on the slot id, its zone
features a column of the zone table, and its labels the sparse demand. Sums over all its
rows factor into sums over the calendar, over the zones and over the rows with demand, and
that is what the models on panels (``linear``, ``trees``) work from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.slots import CALENDAR_FIELDS, SlotSpec

SIDES = ("train", "test")


@dataclass(frozen=True)
class Panel:
    """``demand`` (``keys, slot_id, demand``) over the calendar of ``slots`` and ``zones`` (``keys`` and zone features).

    Slots before ``split`` are the training part. ``demand`` outside the calendar or of unlisted zones is no part of
    the panel. Without ``zones`` the panel has the zones with demand inside the calendar, and their keys as features.
    """

    demand: DataFrame
    slots: SlotSpec
    split: int
    keys: tuple[str, ...] = ("zone_id",)
    zones: DataFrame | None = None

    @property
    def spark(self):
        return self.demand.sparkSession

    def side(self, side: str) -> str:
        """SQL for the slots of a part."""
        split = min(max(self.split, 0), self.slots.count)
        return f"slot_id < {split}" if side == "train" else f"slot_id >= {split}"

    def n_slots(self, side: str) -> int:
        split = min(max(self.split, 0), self.slots.count)
        return split if side == "train" else self.slots.count - split

    def first_slot(self, side: str) -> int:
        return 0 if side == "train" else self.n_slots("train")

    def calendar_names(self, features: list[str]) -> list[str]:
        return [f for f in features if f in CALENDAR_FIELDS]

    def zone_names(self, features: list[str]) -> list[str]:
        return [f for f in features if f not in CALENDAR_FIELDS]

    def values(self, names: list[str]) -> list[str]:
        """SQL for calendar features of a row's ``slot_id``, as doubles."""
        return [f"CAST({self.slots.field(n)} AS DOUBLE)" for n in names]

    def calendar(self) -> DataFrame:
        """``slot_id`` of every slot."""
        return self.spark.range(self.slots.count).selectExpr("CAST(id AS INT) AS slot_id")

    def grid(self, names: list[str]) -> np.ndarray:
        """Calendar features of every slot, one row a slot; other ``names`` are 0. As large as the calendar, however much demand there is."""
        parts = [self.values([n])[0] if n in CALENDAR_FIELDS else "0D" for n in names]
        table = self.calendar().selectExpr("slot_id", *[f"{v} AS x{i}" for i, v in enumerate(parts)]).toPandas()
        return table.sort_values("slot_id").drop(columns="slot_id").to_numpy(float).reshape(-1, len(names))

    def rows(self, side: str) -> DataFrame:
        """The rows with demand of a part."""
        return self.demand.filter(f"{self.slots.inside()} AND {self.side(side)}")

    def calendar_sums(self, names: list[str]) -> DataFrame:
        """One row: for both parts ``{side}_n``, ``{side}_sums`` and ``{side}_products`` (pairs i <= j) of calendar features."""
        table = self.calendar().selectExpr("slot_id", *[f"{v} AS x{i}" for i, v in enumerate(self.values(names))])
        out = []
        for side in SIDES:
            chosen = [f"IF({self.side(side)}, {{}}, 0D)".format(f"x{i}") for i in range(len(names))]
            out.append(f"count_if({self.side(side)}) AS {side}_n")
            out.append(_array([f"sum({x})" for x in chosen], f"{side}_sums"))
            out.append(_array([f"sum({x} * x{j})" for i, x in enumerate(chosen) for j in range(i, len(names))], f"{side}_products"))
        return table.agg(*map(F.expr, out))

    def label_sums(self, names: list[str]) -> DataFrame:
        """Per zone: for both parts ``{side}_y``, ``{side}_y2`` and ``{side}_xy`` (labels times calendar features).

        One aggregation of the sparse rows; zones without any get zeros.
        """
        table = self.demand.filter(self.slots.inside()).selectExpr(
            *self.keys, "slot_id", "CAST(demand AS DOUBLE) AS y", *[f"{v} AS x{i}" for i, v in enumerate(self.values(names))]
        )
        out = []
        for side in SIDES:
            y = f"IF({self.side(side)}, y, 0D)"
            out.append(f"sum({y}) AS {side}_y")
            out.append(f"sum({y} * y) AS {side}_y2")
            out.append(_array([f"sum({y} * x{i})" for i in range(len(names))], f"{side}_xy"))
        sums = table.groupBy(*self.keys).agg(*map(F.expr, out))
        if self.zones is None:
            return sums
        zero = f"array_repeat(0D, {len(names)})"
        filled = [
            f"coalesce({side}_{c}, {z}) AS {side}_{c}" for side in SIDES for c, z in (("y", "0D"), ("y2", "0D"), ("xy", zero))
        ]
        named = [c for c in self.zones.columns if c not in self.keys]
        return self.zones.join(sums, list(self.keys), "left").selectExpr(*self.keys, *named, *filled)


def _array(parts: list[str], name: str) -> str:
    return f"array({', '.join(parts)}) AS {name}" if parts else f"CAST(array() AS ARRAY<DOUBLE>) AS {name}"


def pair_index(i: int, j: int, p: int) -> int:
    """The place of the pair (i, j) among the pairs i <= j of ``p`` features."""
    i, j = min(i, j), max(i, j)
    return i * p - i * (i - 1) // 2 + j - i
