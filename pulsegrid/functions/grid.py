"""Uniform longitude/latitude grids and zone flags.

Methods take and return Spark SQL expressions as text.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class GridSpec:
    """``nx`` by ``ny`` equal cells over a longitude/latitude box."""

    lon_min: float
    lon_max: float
    lat_min: float
    lat_max: float
    nx: int = 25
    ny: int = 25

    @property
    def lon_step(self) -> float:
        return (self.lon_max - self.lon_min) / self.nx

    @property
    def lat_step(self) -> float:
        return (self.lat_max - self.lat_min) / self.ny

    @property
    def cells(self) -> int:
        return self.nx * self.ny

    def resized(self, nx: int, ny: int) -> "GridSpec":
        return GridSpec(self.lon_min, self.lon_max, self.lat_min, self.lat_max, nx, ny)

    def cell_x(self, lon: str, strict: bool = False) -> str:
        return _index(lon, self.lon_min, self.lon_step, self.nx, strict)

    def cell_y(self, lat: str, strict: bool = False) -> str:
        return _index(lat, self.lat_min, self.lat_step, self.ny, strict)

    def flatten(self, x: str, y: str) -> str:
        """One id per cell; NULL when either index is NULL."""
        return f"CAST(({x}) * {self.ny} + ({y}) AS INT)"

    def cell_id(self, lon: str, lat: str) -> str:
        return self.flatten(self.cell_x(lon), self.cell_y(lat))

    def x_of(self, cell: str = "zone_id") -> str:
        return f"CAST({cell} div {self.ny} AS INT)"

    def y_of(self, cell: str = "zone_id") -> str:
        return f"CAST({cell} % {self.ny} AS INT)"

    def corner_lon(self, x: str) -> str:
        return f"(({x}) * {double(self.lon_step)} + {double(self.lon_min)})"

    def corner_lat(self, y: str) -> str:
        return f"(({y}) * {double(self.lat_step)} + {double(self.lat_min)})"


def double(value: float) -> str:
    """A DOUBLE literal."""
    return f"({float(value)!r}D)"


def _index(value: str, low: float, step: float, n: int, strict: bool) -> str:
    """Cell index truncated toward zero, NULL outside.

    Truncation puts values up to one step below the low edge into cell 0;
    ``strict`` leaves them out. The range test comes first, so NaN and huge
    values give NULL instead of a cast overflow.
    """
    position = f"(({value}) - {double(low)}) / {double(step)}"
    lowest = f"{position} >= 0D" if strict else f"{position} > -1D"
    return f"CASE WHEN {lowest} AND {position} < {n}D THEN CAST({position} AS INT) END"


@dataclass(frozen=True)
class FlagBox:
    """A named box; a zone whose coordinates lie strictly inside is flagged."""

    name: str
    lon_low: float
    lon_high: float
    lat_low: float
    lat_high: float

    def contains(self, lon: str, lat: str) -> str:
        return (
            f"({lon} > {double(self.lon_low)} AND {lon} < {double(self.lon_high)}"
            f" AND {lat} > {double(self.lat_low)} AND {lat} < {double(self.lat_high)})"
        )


# The grid box and the two flagged areas.
CITY_GRID = GridSpec(lon_min=-74.15, lon_max=-73.72, lat_min=40.58, lat_max=40.85)
FLAG_BOXES = (
    FlagBox("is_manhattan", -74.025, -73.975, 40.705, 40.75),
    FlagBox("is_airport", -73.81, -73.77, 40.64, 40.663),
)


def flag_columns(lon: str, lat: str, boxes=FLAG_BOXES) -> list[str]:
    """One 0/1 column per box; the first matching box wins, NULL gives 0."""
    columns = []
    for i, box in enumerate(boxes):
        earlier = "".join(f"WHEN {b.contains(lon, lat)} THEN 0 " for b in boxes[:i])
        hit = f"WHEN {box.contains(lon, lat)} THEN 1 "
        columns.append(f"CASE {earlier}{hit}ELSE 0 END AS {box.name}")
    return columns
