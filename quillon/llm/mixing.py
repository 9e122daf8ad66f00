"""Mixing sources to target weights, along a time-varying curriculum.

Targets: each source wants its weight's share of all sizes. A source gives ``max_epochs`` times its size at most; what it can't
give is shared again by weight among the others, until none is above (water filling, in one pass over the sources sorted by limit / weight).

Curriculum: a source's weight over training time t in [0, 1] is piecewise linear. Its integral, scaled to the source's target, is the cumulative
token demand D(t). A document's place in its source's stream of taken words is inverted, t = D^-1(place), which is its training position; documents
are range-sorted by position.

Within a source, documents stand in the order of a hash of id and text size. Prefix sums are two-level: small buckets of that order are summed by
(source, bucket), the buckets' totals are accumulated, and each bucket is accumulated by itself, so a source with a third of all rows is spread
over many tasks. ``mix`` gives each document the position of its first copy; ``training_order`` lists every copy at its own. All documents are taken whole ``floor(target / size)`` times; the remainder takes documents in order once more, the last in part.

Defined results: null text has size 0; null is a source of its own, last in order; a source without words has target 0 and takes 0; repeated rows count each;
an empty table gives no rows; other columns are ignored. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm import common

#: (t, weight) knots by the source's rank modulo their number: constant, ramping up, fading out.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.2), (0.5, 1.0), (1.0, 1.8)), ((0.0, 1.8), (0.6, 0.9), (1.0, 0.1)))
BUCKET_ROWS = 4096


def n_words(text: Column) -> Column:
    """The number of words: places where a word begins, counted by one pass of a regular expression."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size). One row per source, so the windows are small."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("rank", rank)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("limit", F.lit(float(max_epochs)) * F.col("source_size"))
    order = W.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("rank"))
    total = F.sum("source_size").over(W.partitionBy(F.lit(1)))
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("place", F.row_number().over(order)).withColumn("share", (total - before) / rest)
    # sources stand by rising limit / weight: once one stays under its limit, all later ones do, at the same level
    level = F.min(F.when(F.col("share") * F.col("weight") <= F.col("limit"), F.struct("place", "share"))).over(W.partitionBy(F.lit(1)))["share"]
    s = s.withColumn("target", F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit"))))
    return s.select("source", "source_size", "rank", "target")


def _schedule(rank: Column, schedules) -> Column:
    """The source's knots as array<struct<t, w, area>>, area: the weight's integral up to t."""
    options = []
    for knots in schedules:
        area, rows = 0.0, []
        for k, (t, w) in enumerate(knots):
            if k:
                area += (t - knots[k - 1][0]) * (w + knots[k - 1][1]) / 2
            rows.append(F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w"), F.lit(area).alias("area")))
        options.append(F.array(*rows))
    out = options[0]
    for k, option in enumerate(options[1:], 1):
        out = F.when(rank % len(options) == k, option).otherwise(out)
    return out


def invert(knots: Column, share: Column) -> Column:
    """The t in [0, 1] at which the integral of the piecewise linear weight has reached ``share`` of its whole."""
    wanted = share * F.element_at(knots, -1)["area"]

    def segment(k: Column) -> Column:
        a, b = F.get(knots, k), F.get(knots, k + 1)
        slope = (b["w"] - a["w"]) / (b["t"] - a["t"])
        need = F.greatest(wanted - a["area"], F.lit(0.0))
        # w*x + slope*x*x/2 = need, in the form that is stable for a slope near 0
        root = F.sqrt(F.greatest(a["w"] * a["w"] + 2 * slope * need, F.lit(0.0)))
        return F.when((wanted >= a["area"]) & (wanted <= b["area"] + 1e-12), F.least(a["t"] + F.when(need <= 0, F.lit(0.0)).otherwise(2 * need / (a["w"] + root)), b["t"]))

    found = F.transform(F.sequence(F.lit(0), F.size(knots) - 2), segment)
    return F.coalesce(F.array_min(found), F.lit(1.0))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3, schedules=SCHEDULES, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per document: id, source, size, source_size, target, taken, position (of its first copy; null if none is taken)."""
    spark = docs.sparkSession
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{source_col}`"].alias("source"), n_words(docs[f"`{text_col}`"]).alias("size"))
    rows = common.written(rows.withColumn("h", F.xxhash64("id", "size")), "mix-sizes")
    n = rows.count()
    buckets = max(1, n // BUCKET_ROWS)
    width = (1 << 64) // buckets + 1
    rows = rows.withColumn("bucket", F.floor((F.col("h").cast("double") + float(1 << 63)) / float(width)).cast("long"))
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    parts = common.written(parts, "mix-parts")
    targets = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, max_epochs)
    same = lambda a, b: a.eqNullSafe(b)
    before = F.coalesce(F.sum("part").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).drop("part").alias("p").join(targets.alias("t"), same(F.col("p.source"), F.col("t.source")))
    parts = parts.select("p.source", "bucket", "before", "source_size", "rank", "target")
    r, p = rows.alias("r"), parts.alias("p")
    all_ = r.join(p, same(F.col("r.source"), F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket"))).select("id", "r.source", "r.bucket", "size", "h", "before", "source_size", "rank", "target")
    inside = W.partitionBy("source", "bucket").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    place = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    all_ = all_.withColumn("place", place)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    all_ = all_.withColumn("whole", whole)
    rest = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    extra = F.least(F.greatest(rest - F.col("place"), F.lit(0)), F.col("size"))
    all_ = all_.withColumn("taken", F.col("whole") * F.col("size") + extra)
    # the first pass over the source is a whole one if there is any, else the partial one; its start is the document's own place
    position = F.when(F.col("taken") > 0, invert(_schedule(F.col("rank"), schedules), F.col("place") / F.col("target")))
    return all_.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "whole", "place", "rank", position.alias("position"))


def training_order(mixed: DataFrame, schedules=SCHEDULES, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per document and copy (id, source, epoch, words, position), range-sorted by training position."""
    copies = mixed.filter("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("taken") / F.col("size")) - 1, F.lit(0)).cast("int"))))
    start = F.col("place") + F.col("epoch") * F.col("source_size")
    words = F.least(F.col("taken") - F.col("epoch") * F.col("size"), F.col("size"))
    position = invert(_schedule(F.col("rank"), schedules), F.least(start / F.col("target"), F.lit(1.0)))
    rows = copies.select(id_col, source_col, "epoch", words.alias("words"), position.alias("position"))
    return rows.repartitionByRange(common.shuffle_partitions(mixed.sparkSession), "position", id_col).sortWithinPartitions("position", id_col)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(common.table(spark, sf_dir, "documents"))
    order = mixed.select("doc_id", "size", "source_size", "target", "taken", "position")
    return order.repartitionByRange(common.shuffle_partitions(spark), "position", "doc_id").sortWithinPartitions("position", "doc_id")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: its size and documents, target and taken words."""
    by = mix(common.table(spark, sf_dir, "documents")).groupBy("source", "source_size", F.round("target", 3).alias("target"))
    return by.agg(F.count(F.lit(1)).alias("documents"), F.sum("taken").alias("taken"))


QUERIES = {"op9_mixing": op9_mixing, "mixing_targets": mixing_targets}
# a source's taken words are its target to the nearest word
ORACLE_SQL = {
    "mixing_targets": """WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS documents, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, coalesce(sum(3.0 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM s),
l AS (SELECT *, (total - full_before) / open_weight AS share FROM o), m AS (SELECT arg_max(share, open_weight) AS level FROM l WHERE share * w <= 3.0 * source_size),
t AS (SELECT source, source_size, documents, least(3.0 * source_size, coalesce(level * w, 3.0 * source_size)) AS target FROM l, m)
SELECT source, source_size, round(CAST(target AS DOUBLE), 3) AS target, documents, CAST(CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) * source_size + round(target - floor(target / source_size) * source_size) END AS BIGINT) AS taken FROM t"""
}
