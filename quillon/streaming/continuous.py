"""Continuous aggregates as streams, and change polling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.timeseries import floor_bucket, with_average


def bucket_stream(rows: DataFrame, width: int) -> DataFrame:
    """Tumbling bucket sums over a stream of (ts_ms, value). No watermark: rows of any lateness count, as the state keeps every bucket."""
    return rows.groupBy(floor_bucket(F.col("ts_ms"), width).alias("bucket_start")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


def bucket_stream_bounded(rows: DataFrame, width_text: str, lateness: str) -> DataFrame:
    """The same over a timestamp column ``ts``, with state bounded by a watermark: rows later than that are dropped."""
    return rows.withWatermark("ts", lateness).groupBy(F.window("ts", width_text)).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


def refresh(rows: DataFrame, width: int, path: str, checkpoint: str) -> None:
    """Brings the aggregate table at ``path`` up to date with all rows that have arrived, and stops. Each batch's updated buckets are appended with its number;
    ``current`` reads the newest of each, so a repeated batch changes nothing."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    bucket_stream(rows, width).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, path: str) -> DataFrame:
    """(bucket_start, total, n, average)"""
    updates = spark.read.parquet(f"{path}/batch=*")
    newest = updates.groupBy("bucket_start").agg(F.max_by(F.struct("total", "n"), "batch").alias("x"))
    return with_average(newest.select("bucket_start", "x.total", "x.n"))
