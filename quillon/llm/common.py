"""Shared parts of the training-data operators."""

from __future__ import annotations

import ctypes
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.connectors import table
from quillon.sources.work import work_path, written

__all__ = ["SPACE", "WORD", "apply_arrow", "filter_rows", "map_arrow", "needs", "posix_path", "row_id", "shuffle_partitions", "table", "work_path", "written"]

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def posix_path(path: str) -> str:
    """The plain path of a shared POSIX folder, for code that maps files into memory."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a shared POSIX folder, not {path}")
    return url.path


#: Texts are long: by Spark's default of 64 MB a batch, executor and worker would each hold several such batches.
BATCH_BYTES = "8m"
_DEFAULT_BATCH = "67108864b"


def _release() -> None:
    """Give freed memory back to the system: workers wait for their next task with what they have."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with small batches (unless the session says otherwise) and workers that give memory back after each task."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", _DEFAULT_BATCH) == _DEFAULT_BATCH:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            _release()

    return df.mapInArrow(run, schema)


def apply_arrow(df: DataFrame, key: str, function, schema: str) -> DataFrame:
    """``applyInArrow`` on the rows of each key, likewise."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return function(table)
        finally:
            _release()

    return df.groupBy(key).applyInArrow(run, schema)


def row_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """A 64-bit digest of id and text: rows that agree in both are one document, whatever their ids."""
    return F.xxhash64(df[f"`{id_col}`"].cast("long"), df[f"`{text_col}`"])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filter_rows(df: DataFrame, keeps, *more) -> DataFrame:
    """The rows, with all their columns, for which ``keeps(texts, *more)`` is true; it gets Arrow arrays of each batch's values of ``text`` and the columns ``more``.

    Columns are passed by place, so their names don't matter.
    """
    n, n_more = len(df.columns), len(more)
    shown = df.select("*", *[c.alias(f"more__{k}") for k, c in enumerate(more)])
    at = df.columns.index("text")
    types = df.schema
    names = [f.name for f in types]

    def run(batches):
        for batch in batches:
            mask = keeps(batch.column(at), *[batch.column(n + k) for k in range(n_more)])
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(n)], names=names).filter(pa.array(mask))

    return map_arrow(shown, run, types)


def needs(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; other columns, whatever their names, play no part."""
    return df.select(*[df[f"`{c}`"] for c in columns])
