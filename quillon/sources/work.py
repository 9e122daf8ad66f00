"""Intermediate tables in the folder that the driver and all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints/quillon")
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path."""
    return f"{_root(spark)}/quillon/{name}-{uuid.uuid4().hex}"


def kept_path(spark: SparkSession, name: str, df: DataFrame) -> str:
    """A path for something derived from all of a table's files: the same while these are the same, by name, size and time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for file in sorted(df.inputFiles()):
        p = jvm.org.apache.hadoop.fs.Path(file)
        status = p.getFileSystem(conf).getFileStatus(p)
        seen.append((file, status.getLen(), status.getModificationTime()))
    return f"{_root(spark)}/quillon/{name}-{hashlib.sha256(repr(seen).encode()).hexdigest()[:32]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once: written as Parquet and read back."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
