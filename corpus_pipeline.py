"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of ``documents``. ``run`` writes each stage's rows as Parquet to the shared folder
and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common, decontaminate, language, mixing, near_duplicates, substring_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that are ambiguous though long enough to tell."""
    rows = common.needs(docs, "doc_id", "text", "lang")
    return language.accepted(docs, language.fit(rows.filter(~language.held_out(F.col("doc_id")))))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row stays: that with the least id (nulls last), of those one of the least row digest. Rows that agree in id and text are one document and stay once."""
    found = near_duplicates.near_duplicates(docs, by_row=True)
    verdicts = found.groupBy("row_id").agg(F.first(F.col("row_id") != F.col("class_row")).alias("gone__"), F.count(F.lit(1)).alias("rows__")).filter("gone__ OR rows__ > 1")
    verdicts = common.written(verdicts.withColumnRenamed("row_id", "told__"), "near-verdicts")
    rows = docs.withColumn("row__", common.row_id(docs))
    rows = rows.join(verdicts.hint("merge"), rows["row__"] == F.col("told__"), "left").filter("NOT coalesce(gone__, false)")
    once = rows.filter("told__ IS NOT NULL").dropDuplicates(["row__"])
    return rows.filter("told__ IS NULL").union(once).select(*[F.col(f"`{c}`") for c in docs.columns])


def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of all documents but the first that holds them."""
    cut = substring_dedup.remove(docs, substring_dedup.repeated_passages(docs))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, exact or edited, go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, mixed: the rows of ``op9_mixing``."""
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
