"""Session settings this library is tuned for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Cluster-independent settings. Parallelism is left to the cluster: AQE sizes
# the post-shuffle partitions from the data it sees at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str, cpus: int | str = "*", memory: str = "6g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    shuffle = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", shuffle)
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Jobs that run inside send Python workers Arrow batches of about ``size``, not of Spark's 64 MB.

    For whole texts: the executor and each worker then hold some megabytes of rows at once. A larger row is a
    batch of its own. A limit that the session has of its own stays.
    """
    own = spark.conf.get(BATCH_BYTES, None)
    if own is None:
        spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(BATCH_BYTES)
