"""Column parts: threshold sums with part statistics, run-length and dictionary encoding, merging.

A part is a file of a Parquet dataset. Spark prunes row groups by their min/max; ``scan_sum_less_than`` answers from a store's zone map what it can, and reads the other parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.ranking import global_rank


def sum_less_than(df: DataFrame, column: str, threshold) -> DataFrame:
    """The sum of the values below a threshold (0 for none); the comparison is pushed into the scan."""
    return df.filter(F.col(column) < threshold).agg(F.coalesce(F.sum(column), F.lit(0)).alias("total"))


def write_parts(df: DataFrame, path: str, column: str, part: str = "part") -> None:
    """A store: the rows in one folder per part, and beside them the zone map, a row per part: its least and greatest value, rows and sum."""
    df.repartition(part).write.partitionBy(part).parquet(f"{path}/rows")
    c = F.col(column)
    zones = df.sparkSession.read.parquet(f"{path}/rows").groupBy(part).agg(F.min(c).alias("low"), F.max(c).alias("high"), F.count(c).alias("n"), F.sum(c).alias("sum"))
    zones.write.parquet(f"{path}/zones")


def scan_sum_less_than(spark: SparkSession, path: str, column: str, threshold, part: str = "part") -> DataFrame:
    """One row: total, parts_total, parts_pruned (all at or above the threshold), parts_full (all below, answered by the zone map), rows_scanned: those of the other parts, the only folders that are read."""
    zones = spark.read.parquet(f"{path}/zones")
    pruned, full = F.coalesce(F.col("low") >= threshold, F.lit(True)), F.coalesce(F.col("high") < threshold, F.lit(False))
    figures = zones.agg(
        F.count(F.lit(1)).alias("parts_total"),
        F.count(F.when(pruned, 1)).alias("parts_pruned"),
        F.count(F.when(full, 1)).alias("parts_full"),
        F.coalesce(F.sum(F.when(~pruned & ~full, F.col("n"))), F.lit(0)).alias("rows_scanned"),
        F.coalesce(F.sum(F.when(full, F.col("sum"))), F.lit(0)).alias("known_"),
    )
    # the parts to read are found when the query runs: dynamic partition pruning by the zone map
    mixed = zones.filter(~pruned & ~full).select(F.col(part).alias("mixed_"))
    rows = spark.read.parquet(f"{path}/rows").join(F.broadcast(mixed) if figures.first()["parts_total"] <= 100_000 else mixed, F.col(part) == F.col("mixed_"), "left_semi")
    scanned = rows.filter(F.col(column) < threshold).agg(F.coalesce(F.sum(column), F.lit(0)).alias("scanned_"))
    both = figures.crossJoin(scanned)  # one row each
    return both.select((F.col("known_") + F.col("scanned_")).alias("total"), "parts_total", "parts_pruned", "parts_full", "rows_scanned")


def with_file_part(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.input_file_name())


def rle_encode(df: DataFrame, value: str, order: str, group: str | None = None) -> DataFrame:
    """Runs of equal values in the given order: (group,) run, start, value, length. With a group, each group's runs are found by themselves, in parallel.

    Without, rows are numbered by range partitioning and compared with the row before by a join on the number, so no task orders the whole table.
    """
    if group is None:
        rows = global_rank(df.select(F.col(order).alias("start"), F.col(value).alias("value")), "at", F.col("start").asc())
        before = rows.select((F.col("at") + 1).alias("at_"), F.col("value").alias("value_"))
        firsts = rows.join(before, F.col("at") == F.col("at_"), "left").filter(F.col("at_").isNull() | ~F.col("value").eqNullSafe(F.col("value_")))
        runs = global_rank(firsts.select("start", "value", "at"), "run", F.col("at").asc())
        following = runs.select((F.col("run") - 1).alias("run_"), F.col("at").alias("end_"))
        n = rows.count()
        length = F.coalesce("end_", F.lit(n + 1)) - F.col("at")
        return runs.join(following, F.col("run") == F.col("run_"), "left").select("run", "start", "value", length.alias("length"))
    w = W.partitionBy(group).orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    runs = df.withColumn("changed_", changed).withColumn("run", F.sum("changed_").over(w))
    return runs.groupBy(group, "run").agg(F.min(order).alias("start"), F.first(value).alias("value"), F.count(F.lit(1)).alias("length"))


def rle_decode(runs: DataFrame) -> DataFrame:
    """(group columns,) run, value: each value as often as its run is long."""
    return runs.select("*", F.explode(F.sequence(F.lit(1), F.col("length").cast("int"))).alias("k")).drop("k", "length")


def dictionary(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, code): codes by first appearance, from 0. Distinct values are numbered by range partitioning, so many of them are no task's burden."""
    firsts = df.groupBy(value).agg(F.min(order).alias("first_at"))
    return global_rank(firsts, "at_", F.col("first_at").asc(), F.col(value).asc()).select(value, (F.col("at_") - 1).cast("int").alias("code"))


def dictionary_encode(df: DataFrame, value: str, order: str) -> DataFrame:
    codes = dictionary(df, value, order).withColumnRenamed(value, "value_")
    return df.join(codes, df[value].eqNullSafe(F.col("value_"))).drop("value_")


def merge_parts(parts: list[DataFrame], *order: str) -> DataFrame:
    """All parts as one, range-sorted: written, this is one compacted, ordered dataset."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(*order)
