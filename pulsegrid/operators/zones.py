"""Zones: grid cells, nearest centroids, k-means and zone flags."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.coins import coin
from pulsegrid.functions.grid import FLAG_BOXES, GridSpec, flag_columns
from pulsegrid.operators import kmeans
from pulsegrid.operators.nearest import nearest_zone

ENDS = ("pickup", "dropoff")


def assign_cells(trips: DataFrame, grid: GridSpec, strict: bool = False) -> DataFrame:
    """``trip_id`` with the pickup and dropoff cell; outside is NULL."""
    columns = ["trip_id"]
    for end in ENDS:
        columns.append(f"{grid.cell_x(f'{end}_lon', strict)} AS {end}_x")
        columns.append(f"{grid.cell_y(f'{end}_lat', strict)} AS {end}_y")
    return trips.selectExpr(*columns)


def cell_corners(cells: DataFrame, grid: GridSpec) -> DataFrame:
    """Add the coordinates of each cell's south-west corner."""
    return cells.selectExpr(
        "*", f"{grid.corner_lon('cell_x')} AS lon", f"{grid.corner_lat('cell_y')} AS lat"
    )


def nonzero_points(trips: DataFrame) -> DataFrame:
    """Pickup points without missing (zero, NULL or NaN) coordinates, filtered as pairs."""
    return trips.select("trip_id", "pickup_lon", "pickup_lat").filter(
        "pickup_lon <> 0 AND pickup_lat <> 0 AND NOT isnan(pickup_lon) AND NOT isnan(pickup_lat)"
    )


def bernoulli_sample(df: DataFrame, fraction: float, seed: int, *key: str) -> DataFrame:
    """Keep each row with the given probability, by a coin that its key tosses.

    The sample does not depend on files, partitions or retries. Rows of one key stay or go together.
    """
    return df.filter(f"{coin(seed, *key)} < {float(fraction)!r}D")


def train_kmeans(
    trips: DataFrame, k: int, fraction: float = 1.0, seed: int = 1, max_iter: int = 1000
) -> KMeansModel:
    """The library's k-means on a Bernoulli sample of the pickup points; ``kmeans.train`` can be replayed."""
    sample = trips
    if fraction < 1.0:
        sample = bernoulli_sample(sample, fraction, seed, "trip_id")
    sample = sample.select("pickup_lon", "pickup_lat").dropna()
    vectors = VectorAssembler(
        inputCols=["pickup_lon", "pickup_lat"], outputCol="features"
    ).transform(sample).select("features")
    return KMeans(k=k, seed=seed, maxIter=max_iter).fit(vectors)


def cluster_sample(
    trips: DataFrame, k: int | None = None, fraction: float = 1.0, seed: int = 1, steps: int = 20, factor: int | None = None
) -> DataFrame:
    """The centroid table of a Bernoulli sample of the pickup points.

    Without ``k`` there is one centroid for every ``factor`` sampled points.
    """
    sample = bernoulli_sample(trips, fraction, seed, "trip_id") if fraction < 1.0 else trips
    if k is None:
        k = kmeans.size_of(sample.count(), factor)
    return kmeans.train(sample, "pickup_lon", "pickup_lat", k, steps, seed)


def centroid_table(trips: DataFrame, model: KMeansModel) -> DataFrame:
    """``zone_id, centroid_lon, centroid_lat``; ``k`` rows held by the model."""
    rows = [(i, float(c[0]), float(c[1])) for i, c in enumerate(model.clusterCenters())]
    return trips.sparkSession.createDataFrame(
        rows, "zone_id int, centroid_lon double, centroid_lat double"
    )


def nearest_vector(
    df: DataFrame, centroids: DataFrame, vector: str, output: str = "zone_id"
) -> DataFrame:
    """Add the id of the nearest of a short list of centroids of any dimension.

    ``centroids`` has ``zone_id`` and ``centroid``, an array as long as the
    vectors; all of them travel as one value, so this is for lists of a known,
    small length such as class means. Squared distance over the whole vector,
    lowest id on a tie; NULL for a NULL vector or one holding NULL or NaN.
    """
    listed = centroids.selectExpr("collect_list(struct(zone_id, centroid))").scalar()
    d2 = (
        f"aggregate(zip_with({vector}, c.centroid, (a, b) -> CAST(a - b AS DOUBLE) * (a - b)),"
        " 0D, (total, e) -> total + e)"
    )
    closest = f"array_min(transform(listed, c -> struct({d2} AS d2, c.zone_id))).zone_id"
    known = f"{vector} IS NOT NULL AND NOT exists({vector}, e -> e IS NULL OR isnan(e))"
    return df.withColumn("listed", listed).selectExpr(
        *df.columns, f"IF({known}, {closest}, NULL) AS {output}"
    )


def assign_zones(trips: DataFrame, centroids: DataFrame) -> DataFrame:
    """``trip_id, pickup_zone, dropoff_zone`` by nearest centroid."""
    ends = trips.select("trip_id", "pickup_lon", "pickup_lat", "dropoff_lon", "dropoff_lat")
    found = nearest_zone(
        ends, centroids, {f"{end}_zone": (f"{end}_lon", f"{end}_lat") for end in ENDS}
    )
    return found.select("trip_id", "pickup_zone", "dropoff_zone")


def zone_flags(zones: DataFrame, boxes=FLAG_BOXES) -> DataFrame:
    """``zone_id`` with a 0/1 column per box around the zone's coordinates."""
    return zones.selectExpr("zone_id", *flag_columns("centroid_lon", "centroid_lat", boxes))


def with_zone_flags(df: DataFrame, zones: DataFrame, boxes=FLAG_BOXES) -> DataFrame:
    """Attach the flags of ``zones``; a zone that is not listed gets 0."""
    joined = df.join(zone_flags(zones, boxes), "zone_id", "left")
    return joined.fillna(0, [box.name for box in boxes])


def centroid_demand(trip_zones: DataFrame, zones: DataFrame, zone_limit: int) -> DataFrame:
    """Pickups per zone with the zone's coordinates, for zone ids below a limit."""
    counts = (
        trip_zones.filter(f"pickup_zone < {zone_limit}")
        .groupBy(F.col("pickup_zone").alias("zone_id"))
        .agg(F.count("*").alias("cnt"))
    )
    return counts.join(zones, "zone_id", "inner").select(
        "zone_id", "centroid_lon", "centroid_lat", "cnt"
    )


def heat_map(cells: DataFrame, grid: GridSpec, demand: str | None = None) -> DataFrame:
    """Rows per cell with corner coordinates and bubble size ``2^log10(count)``.

    With ``demand`` the column is summed instead of the rows counted.
    """
    measure = "count(*)" if demand is None else f"sum({demand})"
    counted = cells.groupBy("cell_x", "cell_y").agg(F.expr(f"{measure} AS cnt"))
    return cell_corners(counted, grid).selectExpr(
        "*", "CASE WHEN cnt > 0 THEN pow(2D, log10(cnt)) END AS bubble"
    )
