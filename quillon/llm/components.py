"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each task first replaces its own edges by a spanning forest. Every round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

ROUNDS = 60


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of some edges, by label spreading with pointer jumping."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, root = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b"))
        node, root = forest(np.concatenate([node, a]), np.concatenate([root, b]))
    keep = node != root
    for k in range(0, int(keep.sum()), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(node[keep][k : k + 100_000]), pa.array(root[keep][k : k + 100_000])], ["a", "b"])


def _written_least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour. It is written, so that both sides of the join with it are plain shuffles: AQE splits those where a node has very many neighbours."""
    return common.written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _written_least(both).select("u", F.least("m", "u").alias("m"))
    return both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _written_least(down)
    joined = down.join(least, F.col("a") == F.col("u"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of the edges (a, b), root being the least id of the component. Nodes in no edge aren't listed."""
    plain = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    now = common.written(common.map_arrow(plain, _contract, "a long, b long"), "edges")
    seen = None
    for _ in range(ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = common.written(_small_star(common.written(_large_star(now), "edges")), "edges")
    else:
        raise RuntimeError(f"no end of the components after {ROUNDS} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
