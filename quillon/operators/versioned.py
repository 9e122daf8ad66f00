"""Versioned rows (begin_ts, end_ts) and a secondary index with expiry, over plain DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN = (1 << 63) - 1


def visible(versions: DataFrame, snapshot: int) -> DataFrame:
    """The versions of a snapshot: begun at or before it, ended after it. Both conditions reach the scan, where min/max prune row groups."""
    return versions.filter((F.col("begin_ts") <= snapshot) & (F.col("end_ts") > snapshot))


def insert(versions: DataFrame, rows: DataFrame, at: int) -> DataFrame:
    return versions.unionByName(rows.withColumns({"begin_ts": F.lit(at).cast("long"), "end_ts": F.lit(OPEN).cast("long")}))


def delete(versions: DataFrame, where: Column, at: int) -> DataFrame:
    return versions.withColumn("end_ts", F.when((F.col("end_ts") == OPEN) & where, F.lit(at).cast("long")).otherwise(F.col("end_ts")))


def update(versions: DataFrame, where: Column, values: dict[str, Column], at: int) -> DataFrame:
    new = versions.filter((F.col("end_ts") == OPEN) & where).withColumns({**values, "begin_ts": F.lit(at).cast("long")})
    return delete(versions, where, at).unionByName(new)


def purge(versions: DataFrame, watermark: int, key: str = "key") -> DataFrame:
    """Versions that no snapshot from the watermark on sees go; deleted keys go whole."""
    return versions.filter(F.col("end_ts") > watermark)


def changes(versions: DataFrame, key: str = "key") -> DataFrame:
    """(lsn, key, op): the log of a version table; a begin where another version of the key ended is an update."""
    w = W.partitionBy(key).orderBy("begin_ts")
    v = versions.withColumn("prev_", F.lag("end_ts").over(w)).withColumn("next_", F.lead("begin_ts").over(w))
    begins = v.select(F.col("begin_ts").alias("lsn"), key, F.when(F.col("prev_") == F.col("begin_ts"), "update").otherwise("insert").alias("op"))
    ends = v.filter((F.col("end_ts") < OPEN) & ~F.coalesce(F.col("next_") == F.col("end_ts"), F.lit(False))).select(F.col("end_ts").alias("lsn"), key, F.lit("delete").alias("op"))
    return begins.unionByName(ends)


def index_lookup(index: DataFrame, key: int, now: int, expire_after: int = 0) -> DataFrame:
    return live(index, now, expire_after).filter(F.col("skey") == key)


def index_range(index: DataFrame, low: int, high: int, now: int, expire_after: int = 0) -> DataFrame:
    """Both ends included."""
    return live(index, now, expire_after).filter(F.col("skey").between(low, high))


def live(index: DataFrame, now: int, expire_after: int = 0) -> DataFrame:
    """Entries (skey, pk, created) that haven't expired; 0: none does."""
    return index if not expire_after else index.filter(F.col("created") + expire_after > now)
