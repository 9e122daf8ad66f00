"""Row numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.sources.work import written


def global_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds 1-based row numbers by the order, which must be total. Rows are range-sorted once and written; only the partitions' row counts meet."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = df.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    rows = written(ranged.withColumn("pid_", F.shiftright(at, 33)).withColumn("pos_", at.bitwiseAND((1 << 33) - 1)), "ranked")
    counts = rows.groupBy("pid_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(W.orderBy("pid_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("pid_").alias("p_"), before.alias("before_"))  # one row a partition
    out = rows.join(F.broadcast(offsets), F.col("pid_") == F.col("p_"))
    return out.withColumn(name, F.col("before_") + F.col("pos_") + 1).drop("pid_", "pos_", "p_", "before_")
