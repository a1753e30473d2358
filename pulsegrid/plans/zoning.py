"""Complete jobs: trips in, demand out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pulsegrid.functions.grid import GridSpec
from pulsegrid.functions.slots import SlotSpec
from pulsegrid.operators import demand as D
from pulsegrid.operators import zones as Z
from pulsegrid.workspace import materialize


def slots_and_zones(
    trips: DataFrame, slots: SlotSpec, centroids: DataFrame, ends=Z.ENDS
) -> DataFrame:
    """Slot and nearest zone of the trip ends in one pass over the trips.

    Counting pickups needs ``ends=("pickup",)`` only.
    """
    points = {f"{end}_zone": (f"{end}_lon", f"{end}_lat") for end in ends}
    located = Z.nearest_zone(trips.drop(*points), centroids, points)
    return located.selectExpr(
        "trip_id", *points, *[f"{slots.slot_of(f'{end}_ts')} AS {end}_slot" for end in ends]
    )


def slots_and_cells(trips: DataFrame, slots: SlotSpec, grid: GridSpec) -> DataFrame:
    """Slot and cell of both trip ends, trips outside the grid dropped."""
    cells = {
        f"{end}_{axis}": cell
        for end in Z.ENDS
        for axis, cell in (
            ("x", grid.cell_x(f"{end}_lon")), ("y", grid.cell_y(f"{end}_lat")),
        )
    }
    return trips.selectExpr(
        "trip_id", *[f"{c} AS {n}" for n, c in cells.items()],
        f"{slots.slot_of('pickup_ts')} AS pickup_slot",
        f"{slots.slot_of('dropoff_ts')} AS dropoff_slot",
    ).dropna(subset=list(cells))


def cluster_demand(
    trips: DataFrame, slots: SlotSpec, k: int | None = None, fraction: float = 1.0, seed: int = 1,
    steps: int = 20, keep: dict[str, str] | None = None, factor: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """k-means zones and the zero-filled demand over observed slots and zones.

    Returns ``(centroids, demand)``. Without ``k`` there is one zone for every ``factor`` sampled trips. ``keep`` names paths for the intermediate
    tables ``zones`` and ``combined`` when they are wanted.
    """
    keep = keep or {}
    centroids = Z.cluster_sample(trips, k, fraction, seed, steps, factor)
    ends = Z.ENDS if "combined" in keep else ("pickup",)
    combined = slots_and_zones(trips, slots, centroids, ends)
    if "zones" in keep:
        centroids.write.mode("overwrite").parquet(keep["zones"])
    if "combined" in keep:
        combined.write.mode("overwrite").parquet(keep["combined"])
        combined = trips.sparkSession.read.parquet(keep["combined"])
    counted = D.count_demand(combined, slot_id="pickup_slot", zone_id="pickup_zone")
    return centroids, D.fill_observed(materialize(counted, "demand"), slots)


def grid_demand(trips: DataFrame, slots: SlotSpec, grid: GridSpec) -> DataFrame:
    """Demand per slot and cell: one scan, one shuffle of the counts."""
    return D.count_demand(
        slots_and_cells(trips, slots, grid),
        slot_id="pickup_slot", cell_x="pickup_x", cell_y="pickup_y",
    )
