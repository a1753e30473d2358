"""File sources and sinks."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pulsegrid.functions.grid import GridSpec
from pulsegrid.workspace import delete, kept


# Fixed value: CSV keeps microseconds, as Parquet does.
CSV_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Names inside a table's folder; other readers skip what starts with an underscore.
POINTER, VERSION = "_current", "_rows-"


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet"
) -> DataFrame:
    """Read CSV or Parquet under a declared schema (never inferred).

    A table that ``write_table`` wrote is read in its current version; any other
    folder, also one with a path pattern, is read as it is.
    """
    if format not in ("csv", "parquet"):
        raise ValueError(f"unsupported format {format!r}")
    options = CSV_OPTIONS if format == "csv" else {}
    return spark.read.schema(schema).format(format).options(**options).load(current_path(spark, path))


def current_path(spark: SparkSession, path: str) -> str:
    """The folder with the rows of the table at ``path``."""
    pointer, fs = _at(spark, f"{path}/{POINTER}")
    if set(path) & set("*?[{") or not fs.exists(pointer):
        return path
    stream = fs.open(pointer)
    try:
        version = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return f"{path}/{version}"


def write_table(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Replace the table at ``path`` as a whole.

    The rows go to a new folder beside the current ones, and the pointer that names
    the current folder is replaced when the job has written them all. A job that
    fails leaves the old table in place, and a table may be written from its own rows.
    Readers that began before the switch have the old rows until the next write deletes them.
    """
    spark = df.sparkSession
    options = CSV_OPTIONS if format == "csv" else {}
    old = current_path(spark, path).removeprefix(f"{path}/")
    version = f"{VERSION}{uuid.uuid4().hex}"
    try:
        df.write.format(format).options(**options).save(f"{path}/{version}")
    except Exception:
        delete(spark, f"{path}/{version}")
        raise
    fresh, fs = _at(spark, f"{path}/{POINTER}-{version}")
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fresh, _at(spark, f"{path}/{POINTER}")[0], overwrite)
    for status in fs.listStatus(_at(spark, path)[0]):
        name = status.getPath().getName()
        if name.startswith(VERSION) and name not in (old, version):
            fs.delete(status.getPath(), True)


def _at(spark: SparkSession, path: str):
    """A path with its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def write_by_date(df: DataFrame, path: str, ts: str, name: str = "trip_date") -> None:
    """Store a snapshot with one folder per calendar date.

    A date that is written again is replaced, so a repeated run changes nothing.

    The rebalance hint lets AQE split a date that holds far more rows than the
    others and merge tiny ones, so neither hot dates nor small files appear.
    """
    dated = df.selectExpr("*", f"CAST({ts} AS DATE) AS {name}")
    spread = dated.hint("rebalance", name).write.mode("overwrite")
    spread.option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)


def write_by_cell(df: DataFrame, path: str) -> None:
    """One folder per grid cell (``cell_x``, ``cell_y``), hot cells split by AQE."""
    df.hint("rebalance", "cell_x", "cell_y").write.mode("overwrite").partitionBy(
        "cell_x", "cell_y"
    ).parquet(path)


def read_cell(spark: SparkSession, path: str, x: int, y: int) -> DataFrame:
    """The rows of one cell; only that cell's folder is listed and read.

    A cell without a folder has no rows.
    """
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/cell_x={x}/cell_y={y}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.read.parquet(path).filter("false")


def grid_meta(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """The one-row description of a grid."""
    return spark.createDataFrame(
        [(grid.lon_min, grid.lon_max, grid.lat_min, grid.lat_max, grid.nx, grid.ny, None)],
        "lon_min double, lon_max double, lat_min double, lat_max double,"
        " nx int, ny int, missing_value int",
    )


def read_grid_meta(spark: SparkSession, path: str) -> GridSpec:
    """Read a grid description back from its one-row table."""
    row = spark.read.parquet(current_path(spark, path)).first().asDict()
    row.pop("missing_value", None)
    return GridSpec(**row)


def keep_on_disk(df: DataFrame) -> DataFrame:
    """Keep a re-used table on the executors' disks instead of their memory, until its scope ends."""
    return kept(df, StorageLevel.DISK_ONLY)
