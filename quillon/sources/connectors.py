"""Readers and writers, key-value scans and change polling over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "csv", "json", "orc", "text", "avro", "jdbc")


def read(spark: SparkSession, path: str, format: str = "parquet", schema=None, **options) -> DataFrame:
    """Any of Spark's file formats; CSV has a header by default. Filters and columns are pushed into the scan by the planner."""
    if format == "csv":
        options = {"header": True} | options
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = (), **options) -> None:
    if format == "csv":
        options = {"header": True} | options
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Inline rows."""
    return spark.createDataFrame(rows, schema)


def kv_get(store: DataFrame, key: str) -> DataFrame:
    return store.filter(F.col("key") == key)


def kv_scan(store: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """Keys with the prefix, in key order; with a limit Spark keeps only the first rows of each partition."""
    rows = store.filter(F.col("key").startswith(prefix)).orderBy("key")
    return rows if limit is None else rows.limit(limit)


def kv_seek(store: DataFrame, key: str, limit: int) -> DataFrame:
    """The first entries at or after a key."""
    return store.filter(F.col("key") >= key).orderBy("key").limit(limit)


def poll_changes(changes: DataFrame, cursor: int, most: int) -> DataFrame:
    """At most ``most`` changes from log position ``cursor`` on, oldest first. The next cursor is the last position plus one."""
    return changes.filter(F.col("lsn") >= cursor).orderBy("lsn").limit(most)
