"""Nearest centroids through a sparse quadtree of candidates.

The plane is cut into two regions with two coordinates each: a box around the centroids (longitude, latitude), and
everything outside of it (direction from the box's middle, and the inverse of the distance from it, so that far
points lie at 0). Both become quadtrees. A cell keeps the centroids that can be nearest somewhere in it: those that the one
nearest to its middle does not beat all over the cell. Cells that keep more than ``LEAF`` are quartered, and only their
candidates go on, so clustered centroids are told apart by small cells where they lie and nowhere else. Every level is
one shuffle of (cell, candidate) rows by cell; nothing is gathered, and there is no limit to the number of centroids.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.grid import double
from pulsegrid.workspace import materialize, scope

#: Candidates that a cell may keep without being quartered.
LEAF = 16
#: (cell, centroid) rows of the first level, for each region.
PAIRS = 1 << 17
#: Depths of the quadtrees: 2 ** depth cells a side. At the last, cells keep all their candidates. Outside the box small
#: cells do not help where many centroids lie on one straight edge: they all tie for far points.
FIRST, DEEPEST, DEEPEST_OUTSIDE = 5, 26, 9
#: Slack for rounding, as a part of a cell or value.
SLACK = 1e-9


@dataclass(frozen=True)
class Plane:
    """The box around the centroids."""

    lon_low: float
    lon_high: float
    lat_low: float
    lat_high: float

    @property
    def middle(self) -> tuple[float, float]:
        return (self.lon_low + self.lon_high) / 2, (self.lat_low + self.lat_high) / 2

    @property
    def inverse(self) -> float:
        """The greatest inverse distance from the middle of points outside the box."""
        return 2 / min(self.lon_high - self.lon_low, self.lat_high - self.lat_low)

    def axes(self) -> list[tuple[tuple[float, float], tuple[float, float]]]:
        """Low and high ends of both coordinates of both regions."""
        turn = (-math.pi, math.pi)
        return [((self.lon_low, self.lon_high), (self.lat_low, self.lat_high)), (turn, (0.0, self.inverse * (1 + SLACK)))]

    def region(self, lon: str, lat: str) -> str:
        inside = (
            f"{lon} >= {double(self.lon_low)} AND {lon} < {double(self.lon_high)}"
            f" AND {lat} >= {double(self.lat_low)} AND {lat} < {double(self.lat_high)}"
        )
        return f"IF({inside}, 0, 1)"

    def places(self, lon: str, lat: str) -> tuple[str, str]:
        """SQL for the place of a point in its region, both coordinates from 0 to 1."""
        x, y = (f"({c} - {double(m)})" for c, m in zip((lon, lat), self.middle))
        raw = [(lon, lat), (f"atan2({y}, {x})", f"1 / sqrt({x} * {x} + {y} * {y})")]
        out = []
        for axis in (0, 1):
            parts = [
                f"({values[axis]} - {double(ends[axis][0])}) / {double(ends[axis][1] - ends[axis][0])}"
                for values, ends in zip(raw, self.axes())
            ]
            out.append(f"IF(region = 0, {parts[0]}, {parts[1]})")
        return out[0], out[1]

    def edges(self) -> list[str]:
        """SQL for ``u0, u1, v0, v1``, the ends of the cell ``x, y`` at ``depth``, with some slack."""
        out = []
        for axis, cell in ((0, "x"), (1, "y")):
            for end, step in ((0, f"{cell} - {SLACK!r}D"), (1, f"{cell} + 1 + {SLACK!r}D")):
                parts = [
                    f"{double(e[axis][0])} + ({step}) / shiftleft(1, depth) * {double(e[axis][1] - e[axis][0])}" for e in self.axes()
                ]
                out.append(f"IF(region = 0, {parts[0]}, {parts[1]}) AS {'uv'[axis]}{end}")
        return out

    def compared(self) -> str:
        """SQL for what centroids are compared by in the middle of a cell.

        Inside the box that is the squared distance. Outside, it is the squared distance without the part
        that all centroids share, times the inverse distance from the middle of the box.
        """
        x, y = (f"({c} - {double(m)})" for c, m in zip(("lon", "lat"), self.middle))
        u, v = "((u0 + u1) / 2)", "((v0 + v1) / 2)"
        near = f"(lon - {u}) * (lon - {u}) + (lat - {v}) * (lat - {v})"
        return f"IF(region = 0, {near}, {v} * ({x} * {x} + {y} * {y}) - 2 * ({x} * cos({u}) + {y} * sin({u})))"

    def lead(self) -> str:
        """SQL for the least that a centroid is behind ``best`` anywhere in the cell; negative where it is ahead.

        Inside the box the difference is linear in the point, so its least value lies at a corner.
        """
        dx, dy = "(lon - best.lon)", "(lat - best.lat)"
        corner = "{dx} * (lon + best.lon - 2 * {u}) + {dy} * (lat + best.lat - 2 * {v})"
        corners = ", ".join(corner.format(dx=dx, dy=dy, u=u, v=v) for u in ("u0", "u1") for v in ("v0", "v1"))
        cx, cy = (double(2 * m) for m in self.middle)
        a = f"({dx} * (lon + best.lon - {cx}) + {dy} * (lat + best.lat - {cy}))"
        phi = f"atan2({dy}, {dx})"
        most = f"IF({phi} BETWEEN u0 AND u1, 1D, greatest(cos(u0 - {phi}), cos(u1 - {phi})))"
        return f"IF(region = 0, least({corners}), least({a} * greatest(v0, 0D), {a} * v1) - 2 * sqrt({dx} * {dx} + {dy} * {dy}) * {most})"

    def noise(self) -> str:
        """SQL for a difference that may be due to rounding."""
        size = math.hypot(self.lon_high - self.lon_low, self.lat_high - self.lat_low)
        return f"{double(SLACK)} * (abs(lon - best.lon) + abs(lat - best.lat)) * IF(region = 0, {double(size)}, 1D)"


def key(depth: int | str, x: str, y: str) -> str:
    """SQL for a cell's name."""
    return f"((CAST(region AS BIGINT) * 64 + {depth}) * {1 << 26} + CAST({x} AS BIGINT)) * {1 << 26} + CAST({y} AS BIGINT)"


def _possible(rows: DataFrame, plane: Plane) -> DataFrame:
    """The (cell, candidate) rows that can be nearest in their cell, with the number ``held`` by it."""
    cell = "PARTITION BY region, x, y"
    best = f"min_by(struct(lon, lat), struct(middle, lon, lat)) OVER ({cell}) AS best"
    return (
        rows.selectExpr("*", *plane.edges()).selectExpr("*", f"{plane.compared()} AS middle").selectExpr("*", best)
        .filter(f"{plane.lead()} <= {plane.noise()}").selectExpr(*rows.columns, f"count(*) OVER ({cell}) AS held")
    )


def centroid_index(centroids: DataFrame) -> tuple[DataFrame, Plane, list[int]]:
    """The written table ``cell, who`` of the quadtrees' leaves, the plane they cut, and the depths at which leaves lie."""
    spark = centroids.sparkSession
    with scope(spark) as tables:
        # of centroids at the same place only the lowest id can be chosen
        places = materialize(
            centroids.dropna().selectExpr("centroid_lon AS lon", "centroid_lat AS lat", "zone_id").groupBy("lon", "lat").agg(
                F.min("zone_id").alias("zone_id")
            ),
            "places",
        )
        k, *ends = places.selectExpr("count(*)", "min(lon)", "max(lon)", "min(lat)", "max(lat)").first()
        if not k:
            raise ValueError("the zone table has no coordinates")
        margin = [max((high - low) / 2, 1e-6) for low, high in (ends[:2], ends[2:])]
        plane = Plane(ends[0] - margin[0], ends[1] + margin[0], ends[2] - margin[1], ends[3] + margin[1])
        depth = max(1, min(FIRST, int(math.log2(max(PAIRS / k, 1)) / 2)))
        side = 1 << depth
        rows = places.selectExpr("*", f"{depth} AS depth", "explode(array(0, 1)) AS region", f"explode(sequence(0, {side * side - 1})) AS c")
        rows = rows.selectExpr("region", "depth", f"CAST(c div {side} AS INT) AS x", f"CAST(c % {side} AS INT) AS y", "lon", "lat", "zone_id")
        leaves, depths = None, []
        while True:
            level = materialize(_possible(rows, plane), "cells")
            last = f"held <= {LEAF} OR depth >= IF(region = 0, {DEEPEST}, {DEEPEST_OUTSIDE})"
            done = level.filter(last)
            found = done.groupBy(F.expr(f"{key(depth, 'x', 'y')} AS cell")).agg(F.expr("collect_list(struct(lon, lat, zone_id)) AS who"))
            leaves, depths = found if leaves is None else leaves.unionByName(found), [*depths, depth]
            open_cells = level.filter(f"NOT ({last})").drop("held")
            if open_cells.isEmpty():
                break
            depth += 1
            rows = open_cells.selectExpr(
                "region", f"{depth} AS depth", "explode(array(0, 1, 2, 3)) AS q", "x", "y", "lon", "lat", "zone_id"
            ).selectExpr("region", "depth", "x * 2 + q div 2 AS x", "y * 2 + q % 2 AS y", "lon", "lat", "zone_id")
            rows = rows.selectExpr("region", "depth", "CAST(x AS INT) AS x", "CAST(y AS INT) AS y", "lon", "lat", "zone_id")
        return tables.keep(materialize(leaves, "centroid-index")), plane, depths


def nearest_zone(df: DataFrame, centroids: DataFrame, points: dict[str, tuple[str, str]]) -> DataFrame:
    """Add the nearest centroid's id for each ``{output: (lon, lat)}`` pair.

    A row looks up the few candidates of its cell; where leaves lie at several depths it asks at each of them and meets one.
    The index is joined without a hint: while it is small Spark broadcasts it and the rows stay where
    they are; beyond the broadcast threshold it becomes a shuffled join whose hot cells AQE splits. Squared
    planar distance, lowest zone id on a tie, NULL for NULL or NaN points.
    """
    index, plane, depths = centroid_index(centroids)
    original = df.columns
    for name, (lon, lat) in points.items():
        d2 = f"(c.lon - {lon}) * (c.lon - {lon}) + (c.lat - {lat}) * (c.lat - {lat})"
        closest = f"array_min(transform(who, c -> struct({d2} AS d2, c.zone_id))).zone_id"
        nearest = f"IF(size(who) = 1, who[0].zone_id, {closest})"
        known = f"NOT isnan(coalesce({lon}, double('NaN'))) AND NOT isnan(coalesce({lat}, double('NaN')))"
        u, v = plane.places(lon, lat)
        placed = df.selectExpr("*", f"{plane.region(lon, lat)} AS region").selectExpr("*", f"{u} AS _u", f"{v} AS _v")
        cells = []
        for depth in depths:
            x, y = (f"least(greatest(CAST(floor({c} * {1 << depth}) AS INT), 0), {(1 << depth) - 1})" for c in ("_u", "_v"))
            cells.append(key(depth, x, y))
        cell = cells[0] if len(cells) == 1 else f"explode_outer(IF({known}, array({', '.join(cells)}), NULL))"
        asked = placed.selectExpr(*df.columns, f"IF({known}, {cells[0]}, NULL) AS cell" if len(cells) == 1 else f"{cell} AS cell")
        met = asked.join(index, "cell", "left")
        if len(cells) > 1:
            met = met.filter("who IS NOT NULL OR cell IS NULL")
        df = met.selectExpr(*df.columns, f"{nearest} AS {name}")
    return df.select(*original, *points)
