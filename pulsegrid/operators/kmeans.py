"""k-means whose every step is an aggregation that can be replayed.

The start is the ``k`` places of the smallest hash; a step assigns every place to its nearest centroid and takes the
mean of each. Means are kept at 9 digits, so that the order of a sum makes no difference to the next
step. Points at one place count once, with their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.coins import coin
from pulsegrid.operators.nearest import nearest_zone
from pulsegrid.workspace import materialize, scope

#: Centroids that travel as one short list; more are found through the index.
FEW = 64


def size_of(sample_size: int, factor: int) -> int:
    """Number of centroids for a sample: one for every ``factor`` points, at least one."""
    return max(1, sample_size // factor)


def start(places: DataFrame, k: int, seed: int) -> DataFrame:
    """``zone_id, centroid_lon, centroid_lat`` of the ``k`` places (``lon, lat``) of the smallest hash."""
    least = places.selectExpr("lon", "lat", f"{coin(seed, 'lon', 'lat')} AS toss").orderBy("toss", "lon", "lat").limit(k)
    # k rows from here on
    return least.selectExpr(
        "CAST(row_number() OVER (ORDER BY toss, lon, lat) AS INT) - 1 AS zone_id", "lon AS centroid_lon", "lat AS centroid_lat"
    )


def assign(places: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """``places`` with the ``zone_id`` of the nearest centroid, the lowest on a tie."""
    if k > FEW:
        return nearest_zone(places, centroids, {"zone_id": ("lon", "lat")})
    listed = centroids.selectExpr("collect_list(struct(centroid_lon AS lon, centroid_lat AS lat, zone_id))").scalar()
    d2 = "(c.lon - lon) * (c.lon - lon) + (c.lat - lat) * (c.lat - lat)"
    nearest = f"array_min(transform(listed, c -> struct({d2} AS d2, c.zone_id AS zone_id))).zone_id"
    return places.withColumn("listed", listed).selectExpr(*places.columns, f"{nearest} AS zone_id")


def train(points: DataFrame, lon: str, lat: str, k: int, steps: int = 20, seed: int = 1) -> DataFrame:
    """The written centroid table after at most ``steps`` steps; fewer if nothing moves any more.

    NULL and NaN points take no part. With fewer places than ``k`` every place is a centroid. A centroid that
    loses all its points stays where it is.
    """
    with scope(points.sparkSession) as tables:
        known = points.selectExpr(f"{lon} AS lon", f"{lat} AS lat").dropna()
        places = materialize(known.groupBy("lon", "lat").agg(F.expr("count(*) AS n")), "places")
        centroids = materialize(start(places, k, seed), "centroids")
        for _ in range(steps):
            means = assign(places, centroids, k).groupBy("zone_id").agg(
                F.expr("sum(lon * n) / sum(n) AS lon"), F.expr("sum(lat * n) / sum(n) AS lat")
            )
            moved = centroids.join(means, "zone_id", "left").selectExpr(
                "zone_id", "coalesce(round(lon, 9), centroid_lon) AS centroid_lon", "coalesce(round(lat, 9), centroid_lat) AS centroid_lat",
                "round(lon, 9) <> centroid_lon OR round(lat, 9) <> centroid_lat AS moved",
            )
            moved = materialize(moved, "centroids")
            centroids = moved.drop("moved")
            if moved.filter("moved").isEmpty():
                break
        return tables.keep(materialize(centroids, "centroids"))
