"""Time series over rows (ts_ms, value): chunks, ranges, retention, bucket aggregates, gap filling, backward as-of join, interval join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def floor_bucket(ts: Column, width: int) -> Column:
    """The start of the bucket of ``width`` that holds ts; right for negative times as well."""
    return ts - F.pmod(ts, F.lit(width))


def with_chunks(rows: DataFrame, width: int) -> DataFrame:
    """Adds chunk_start, by which a hypertable is partitioned on disk."""
    return rows.withColumn("chunk_start", floor_bucket(F.col("ts_ms"), width))


def write_hypertable(rows: DataFrame, path: str, width: int, mode: str = "append") -> None:
    """One folder per chunk. Rows are dealt by chunk and by a slice of each chunk's times, so a large chunk isn't one task's."""
    chunks = with_chunks(rows, width)
    slice_ = F.floor((F.col("ts_ms") - F.col("chunk_start")) * 8 / width)
    chunks.repartition("chunk_start", slice_).sortWithinPartitions("chunk_start", "ts_ms").write.mode(mode).partitionBy("chunk_start").parquet(path)


def _in_range(rows: DataFrame, t0: int, t1: int, width: int | None) -> DataFrame:
    out = rows.filter((F.col("ts_ms") >= t0) & (F.col("ts_ms") < t1))
    if width is not None and "chunk_start" in rows.columns:
        out = out.filter((F.col("chunk_start") > t0 - width) & (F.col("chunk_start") < t1))  # prunes folders
    return out


def query_range(rows: DataFrame, t0: int, t1: int, width: int | None = None) -> DataFrame:
    """Rows in [t0, t1) in time order."""
    return _in_range(rows, t0, t1, width).orderBy("ts_ms")


def sum_range(rows: DataFrame, t0: int, t1: int, width: int | None = None) -> DataFrame:
    """The sum over [t0, t1); 0.0 for no rows."""
    return _in_range(rows, t0, t1, width).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


def count_range(rows: DataFrame, t0: int, t1: int, width: int | None = None) -> DataFrame:
    return _in_range(rows, t0, t1, width).agg(F.count(F.lit(1)).alias("n"))


def drop_chunks_before(chunks: DataFrame, cutoff: int, width: int) -> DataFrame:
    """What retention leaves: chunks that end at or before the cutoff go whole, a chunk that only begins before it stays."""
    return chunks.filter(F.col("chunk_start") + width > cutoff)


def dropped_chunks(chunks: DataFrame, cutoff: int, width: int) -> DataFrame:
    gone = chunks.filter(F.col("chunk_start") + width <= cutoff)
    return gone.agg(F.countDistinct("chunk_start").alias("chunks"), F.count(F.lit(1)).alias("n"))


def drop_chunks(spark: SparkSession, path: str, cutoff: int, width: int) -> int:
    """Retention on a written hypertable: deletes the folders of chunks that end at or before the cutoff, without reading a row. The number of chunks deleted."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for status in fs.listStatus(p):
        name, equals, start = status.getPath().getName().partition("chunk_start=")
        if equals and not name and start.lstrip("-").isdigit() and int(start) + width <= cutoff:
            fs.delete(status.getPath(), True)
            gone += 1
    return gone


def gap_fill(buckets: DataFrame, width: int, *keys: str, fill: str = "null") -> DataFrame:
    """(keys,) bucket_start, total, n, average with a row for every bucket from each key's first to its last. Buckets without rows have n 0 and total 0; their average is null or, with fill ``last``, that of the bucket before."""
    spans = buckets.groupBy(*keys).agg(F.min("bucket_start").alias("low_"), F.max("bucket_start").alias("high_")).filter("low_ IS NOT NULL")
    every = spans.select(*[F.col(k).alias(f"{k}_") for k in keys], F.explode(F.sequence("low_", "high_", F.lit(width))).alias("at_"))
    same = F.col("at_") == F.col("bucket_start")
    for k in keys:
        same = same & F.col(f"{k}_").eqNullSafe(F.col(k))
    full = every.join(buckets.select(*keys, "bucket_start", "total", "n", "average"), same, "left")
    average = F.col("average")
    if fill == "last":
        average = F.last("average", ignorenulls=True).over(W.partitionBy(*[f"{k}_" for k in keys]).orderBy("at_").rowsBetween(W.unboundedPreceding, 0))
    return full.select(*[F.col(f"{k}_").alias(k) for k in keys], F.col("at_").alias("bucket_start"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"), average.alias("average"))


def interval_join(points: DataFrame, intervals: DataFrame, width: int, ts: str = "ts_ms", low: str = "low", high: str = "high") -> DataFrame:
    """Every point with every interval [low, high) that holds it, all columns of both. Both sides meet by bucket of ``width``, in an equality join: an interval goes to each bucket it touches, a point to its own, so a pair is found once."""
    first, last = floor_bucket(F.col(low), width), floor_bucket(F.col(high) - 1, width)
    spread = intervals.filter(F.col(high) > F.col(low)).withColumn("bucket_", F.explode(F.sequence(first, last, F.lit(width))))
    dealt = points.withColumn("point_bucket_", floor_bucket(F.col(ts), width))
    joined = dealt.join(spread, (F.col("point_bucket_") == F.col("bucket_")) & (F.col(ts) >= F.col(low)) & (F.col(ts) < F.col(high)))
    return joined.drop("bucket_", "point_bucket_")


def bucket_aggregate(rows: DataFrame, width: int, *keys: str) -> DataFrame:
    """A continuous aggregate from scratch: (keys,) bucket_start, total, n, average."""
    by = rows.groupBy(*keys, floor_bucket(F.col("ts_ms"), width).alias("bucket_start"))
    return with_average(by.agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n")))


def with_average(buckets: DataFrame) -> DataFrame:
    return buckets.withColumn("average", F.coalesce(F.try_divide("total", "n"), F.lit(0.0)))


def merge_buckets(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Adds the buckets of newly observed rows, however late, to those known."""
    both = old.select(*keys, "bucket_start", "total", "n").unionByName(new.select(*keys, "bucket_start", "total", "n"))
    return with_average(both.groupBy(*keys, "bucket_start").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))


def bucket_sum_range(buckets: DataFrame, t0: int, t1: int, width: int) -> DataFrame:
    """Sums whole buckets that start from the one that holds t0 up to, without, t1."""
    low = t0 - t0 % width
    return buckets.filter((F.col("bucket_start") >= low) & (F.col("bucket_start") < t1)).agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"))


def totals(buckets: DataFrame) -> DataFrame:
    return buckets.agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("buckets"))


def asof_join(left: DataFrame, right: DataFrame, ts: str = "ts_ms", by: str | None = None, order: str | None = None, span: int | None = None) -> DataFrame:
    """For each left row the last right row at or before its time; of equal times the last by ``order``. Left columns, then right_<column>s, has_right.

    Both sides are sorted once, as one stream. With ``by`` each key is its own stream. Without, time is cut into spans (of ``span``, by default about 1024 of the right side's whole range), which are
    sorted in parallel; what a span begins with is carried over from the spans before it. Carrying orders one row a span; it is joined to the spans by their number.
    """
    tie = F.col(f"`{order}`") if order else F.lit(0)
    r = right.select(F.col(ts).alias("ts_"), tie.alias("tie_"), F.struct(*[right[c] for c in right.columns]).alias("right_"))
    stream_r = r.withColumn("left_", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType))
    left_rows = left.select(F.col(ts).alias("ts_"), F.lit(None).cast(r.schema["tie_"].dataType).alias("tie_"), F.lit(None).cast(r.schema["right_"].dataType).alias("right_"), F.struct(*[left[c] for c in left.columns]).alias("left_"))
    both = stream_r.select("ts_", "tie_", "right_", "left_").unionByName(left_rows)
    side = F.col("left_").isNotNull().cast("int")  # a left row sorts after right rows of its time
    if by:
        both = both.withColumn("part_", F.coalesce(F.col(f"left_.{by}"), F.col(f"right_.{by}")))
        carried = None
    else:
        if span is None:
            low, high = right.agg(F.min(ts), F.max(ts)).first()
            span = max(1, ((high - low) // 1024 + 1) if low is not None else 1)
        both = both.withColumn("part_", F.floor(F.col("ts_") / span))
        last = both.groupBy("part_").agg(F.max_by("right_", F.when(F.col("right_").isNotNull(), F.struct("ts_", "tie_"))).alias("last_"))
        before = W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
        carried = last.select(F.col("part_").alias("span_"), F.last("last_", ignorenulls=True).over(before).alias("carry_"))
    w = W.partitionBy("part_").orderBy("ts_", side, "tie_").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("found_", F.last("right_", ignorenulls=True).over(w)).filter("left_ IS NOT NULL")
    if carried is not None:
        # rows before their span's first right row take the last one of the spans before
        out = out.join(carried, F.col("part_") == F.col("span_"), "left").withColumn("found_", F.coalesce("found_", "carry_"))
    names = [F.col(f"found_.{c}").alias(f"right_{c}") for c in right.columns]
    return out.select("left_.*", *names, F.col("found_").isNotNull().alias("has_right"))
