"""The graph index against exact search, and its defined results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import graph, vector
from quillon.sources.work import work_path


def vectors(spark, n, dim=16, seed=1, first=0, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, dim))
    if clusters:
        x = rng.random((clusters, dim))[rng.integers(0, clusters, n)] + 0.001 * x
    return spark.createDataFrame([(first + i, [float(a) for a in v], i % 7) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")


def pairs(found):
    return {(r.query_id, r.id) for r in found.collect()}


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall(spark, monkeypatch, clusters):
    monkeypatch.setattr(graph, "SHARD_ROWS", 1000)
    base = vectors(spark, 3000, clusters=clusters).persist()
    queries = base.filter("vec_id % 50 = 0")
    index = graph.GraphIndex.build(base, work_path(spark, "graph"), codes=8, attributes=("label",))
    assert spark.read.parquet(index.path).count() == 3
    exact = pairs(vector.knn(base, queries, 10))
    assert len(pairs(index.search(queries, 10)) & exact) >= 0.95 * len(exact)
    assert len(pairs(index.search(queries, 10, ef=20)) & exact) >= 0.85 * len(exact)
    assert len(pairs(index.search_by_codes(base, queries, 10)) & exact) >= 0.9 * len(exact)
    some = pairs(vector.knn(base.filter("label < 3"), queries, 10))
    found = pairs(index.search(queries, 10, where=lambda row: row["label"] < 3))
    assert len(found) == len(some) and len(found & some) >= 0.95 * len(some)
    # distances are exact, in order, and those of the rows named
    rows = index.search(queries, 10).collect()
    v = {r.vec_id: np.array(r.embedding) for r in base.collect()}
    for r in rows:
        assert abs(r.distance - np.linalg.norm(v[r.id] - v[r.query_id])) < 1e-5
    base.unpersist()


def test_every_row_is_reached():
    """Far apart groups, equal rows, and a walk that keeps one row: the ring leads on."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros((60, 4)), 1000 + rng.random((60, 4)), np.full((5, 4), -1e4)])
    links = graph.link(x, 4)
    assert links.shape == (125, 9) and (links < 125).all() and not (links[:, :4] == np.arange(125)[:, None]).any()
    reached, edge = {0}, [0]
    while edge:
        edge = [int(b) for a in edge for b in links[a] if b >= 0 and b not in reached and not reached.add(int(b))]
    assert len(reached) == 125
    assert graph.link(x[:1], 4).tolist() == [[-1] * 9] and sorted(set(graph.link(x[:2], 4)[0].tolist())) == [-1, 1]


def test_added_rows_and_few_that_pass(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARD_ROWS", 300)
    base, more = vectors(spark, 600), vectors(spark, 200, seed=2, first=10_000).withColumn("label", F.lit(99))
    index = graph.GraphIndex.build(base, work_path(spark, "graph"), attributes=("label",))
    index.add(more)
    queries = base.filter("vec_id % 100 = 0")
    exact = pairs(vector.knn(base.union(more), queries, 5))
    assert len(pairs(index.search(queries, 5)) & exact) >= 0.95 * len(exact)
    # a filter that few rows pass gives exactly what exact search does, k hits whenever k rows match
    rare = F.col("vec_id").isin([10_001, 10_002, 10_003])
    ids = graph.GraphIndex.build(base.union(more).withColumn("key", F.col("vec_id")), work_path(spark, "graph"), attributes=("key",))
    assert pairs(ids.search(queries, 5, where=lambda row: row["key"].isin([10_001, 10_002, 10_003]))) == pairs(vector.knn(more.filter(rare), queries, 5))
    assert len(index.search(queries, 7, where=lambda row: row["label"] == 99, ef=1).collect()) == 7 * 6
    assert not index.search(queries, 5, where=lambda row: row["label"].cast("string") == "none").collect()


def test_a_walk_that_meets_too_few_measures_all_that_pass(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.random((400, 8)), 100 + rng.random((30, 8))])
    base = spark.createDataFrame([(i, [float(a) for a in v], i >= 400) for i, v in enumerate(x)], "vec_id long, embedding array<float>, far boolean")
    index = graph.GraphIndex.build(base, work_path(spark, "graph"), attributes=("far",))
    queries = base.filter("vec_id < 20")
    assert pairs(index.search(queries, 10, ef=10, where=lambda row: row["far"])) == pairs(vector.knn(base.filter("far"), queries, 10))


def test_defined_results(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(1, [0.0, 1.0], 1), (2, None, 1), (3, [0.0, 1.0], None), (4, [5.0, 1.0], 2)]
    index = graph.GraphIndex.build(spark.createDataFrame(rows, schema), work_path(spark, "graph"), attributes=("label",))
    queries = spark.createDataFrame([(9, [0.0, 1.0], 0), (10, None, 0)], schema)
    assert [(r.query_id, r.id, r.rank) for r in index.search(queries, 5).orderBy("rank").collect()] == [(9, 1, 1), (9, 3, 2), (9, 4, 3)]
    assert [r.id for r in index.search(queries, 5, where=lambda row: row["label"] < 9).orderBy("rank").collect()] == [1, 4]
    empty = graph.GraphIndex.build(spark.createDataFrame([], schema), work_path(spark, "graph"), codes=2)
    assert not empty.search(queries, 5).collect()
    assert not index.search(queries.limit(0), 5).collect()
    with pytest.raises(ValueError, match="dimensions differ"):
        graph.GraphIndex.build(spark.createDataFrame([(1, [1.0], 1), (2, [1.0, 2.0], 1)], schema), work_path(spark, "graph"))
    with pytest.raises(ValueError, match="without codes"):
        index.search_by_codes(spark.createDataFrame(rows, schema), queries, 5)
