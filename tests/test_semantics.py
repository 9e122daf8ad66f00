"""Null, tie and border rules on small hand-made frames."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.functions import types
from quillon.functions.ranking import global_rank
from quillon.operators import json_docs, text, timeseries, vector, versioned
from quillon.plans.sqltext import normalized, rewrite, split_statements
from quillon.sources import columnar, connectors
from quillon.sources.work import work_path
from quillon.streaming import continuous


def test_null_groups_sums_and_order(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (None, 3.0), (None, None), (2, None)], "k int, v double")
    got = {r.k: r.s for r in df.groupBy("k").agg(types.total(F.col("v")).alias("s")).collect()}
    assert got == {1: 2.0, None: 3.0, 2: None}
    assert [r.k for r in df.select("k").distinct().orderBy(types.ascending("k")).collect()] == [1, 2, None]
    assert [r.k for r in df.select("k").distinct().orderBy(types.descending("k")).collect()] == [None, 2, 1]
    assert df.filter("false").agg(types.total(F.col("v")).alias("s")).first().s is None
    assert df.select(types.ratio(F.lit(1), F.lit(0)).alias("r")).first().r is None
    with pytest.raises(ValueError):
        types.spark_type("point")
    assert types.spark_type("VARCHAR(32) NOT NULL") == "string"


def test_rewrite():
    assert rewrite("SELECT 0.5, 2, 'a''0.5' FROM t ORDER BY a, b DESC LIMIT 3") == "SELECT 0.5D, 2, 'a''0.5' FROM t ORDER BY a NULLS LAST, b DESC NULLS FIRST LIMIT 3"
    assert rewrite('SELECT sum(a * (b + 1)) AS "x y" FROM t') == "SELECT SUM(CAST((a * (b + 1)) AS DOUBLE)) AS `x y` FROM t"
    assert rewrite("SELECT * FROM (SELECT a FROM t ORDER BY a) ORDER BY 1 NULLS FIRST") == "SELECT * FROM (SELECT a FROM t ORDER BY a NULLS LAST) ORDER BY 1 NULLS FIRST"
    assert split_statements("a 'x;y'; b -- c;d\n; ") == ["a 'x;y'", "b -- c;d"]
    assert normalized("SELECT  1 FROM T where x='a'") == normalized("select 22 from t WHERE X = 'bb'")


def test_floor_bucket_negative(spark):
    df = spark.createDataFrame([(-1,), (-10,), (-11,), (0,), (9,), (10,)], "t long")
    assert [r.b for r in df.select(timeseries.floor_bucket(F.col("t"), 10).alias("b")).collect()] == [-10, -10, -20, 0, 0, 10]


def test_asof_ties_and_unmatched(spark):
    left = spark.createDataFrame([(1,), (10,), (20,), (30,)], "ts_ms long")
    right = spark.createDataFrame([(5, 50.0, 0), (15, 150.0, 1), (15, 151.0, 2), (25, 250.0, 3)], "ts_ms long, value double, seq int")
    for span in (None, 4, 1000):
        got = timeseries.asof_join(left, right, order="seq", span=span).orderBy("ts_ms").collect()
        assert [(r.ts_ms, r.right_value, r.has_right) for r in got] == [(1, None, False), (10, 50.0, True), (20, 151.0, True), (30, 250.0, True)]
    empty = timeseries.asof_join(left, right.filter("false"), order="seq").collect()
    assert len(empty) == 4 and not any(r.has_right for r in empty)


def test_series(spark):
    rows = spark.range(100_000).select(F.col("id").alias("ts_ms"), F.col("id").cast("double").alias("value"))
    chunks = timeseries.with_chunks(rows, 10_000)
    left = timeseries.drop_chunks_before(chunks, 50_000, 10_000)
    assert (left.count(), left.select("chunk_start").distinct().count()) == (50_000, 5)
    assert timeseries.drop_chunks_before(chunks, 50_001, 10_000).count() == 50_000
    assert timeseries.sum_range(rows, 200_000, 300_000).first().total == 0.0
    buckets = timeseries.bucket_aggregate(rows, 1000)
    assert timeseries.bucket_sum_range(buckets, 1500, 3000, 1000).first().total == sum(range(1000, 3000))


def test_stream_equals_rebuild(spark):
    rows = spark.createDataFrame([(i * 37 % 1000 - 500, float(i)) for i in range(300)], "ts_ms long, value double")
    source, path, check = (work_path(spark, x) for x in ("in", "out", "cp"))
    for part in (0, 1, 2):
        rows.filter(F.pmod("ts_ms", F.lit(3)) == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts_ms long, value double").parquet(source)
        continuous.refresh(stream, 100, path, check)
    want = timeseries.bucket_aggregate(rows, 100)
    assert sorted(continuous.current(spark, path).collect()) == sorted(want.collect())


def test_columnar(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 1, 1, 2, 3, 3, 1])], "i int, v int")
    runs = columnar.rle_encode(df, "v", "i").orderBy("start").collect()
    assert [(r.value, r.length) for r in runs] == [(1, 3), (2, 1), (3, 2), (1, 1)]
    assert columnar.rle_decode(columnar.rle_encode(df, "v", "i")).count() == 7
    coded = columnar.dictionary_encode(df, "v", "i").orderBy("i").collect()
    assert [r.code for r in coded] == [0, 0, 0, 1, 2, 2, 0]
    parts = spark.range(100_000).select("id", F.floor(F.col("id") / 30_000).alias("part"))
    store = work_path(spark, "store-test")
    columnar.write_parts(parts, store, "id")
    got = columnar.scan_sum_less_than(spark, store, "id", 35_000).first()
    assert (got.total, got.parts_total, got.parts_pruned, got.parts_full, got.rows_scanned) == (sum(range(35_000)), 4, 2, 1, 30_000)
    assert columnar.sum_less_than(parts, "id", 0).first().total == 0


def test_kv(spark):
    kv = connectors.values(spark, [("a1", "x"), ("a2", "y"), ("b", "z")], "key string, value string")
    assert [r.key for r in connectors.kv_scan(kv, "a").collect()] == ["a1", "a2"]
    assert [r.key for r in connectors.kv_seek(kv, "a2", 5).collect()] == ["a2", "b"]
    assert connectors.kv_get(kv, "zz").count() == 0


def test_json(spark):
    rows = [
        (1, '{"name":"a","age":3,"tags":["x","y"],"addr":{"city":"B"}}'), (2, '{"age":3.0,"name":null,"tags":[]}'), (3, "not json"), (4, None), (5, '[{"k":1},{"k":2}]'),
    ]
    df = spark.createDataFrame(rows, "id long, doc string")
    ids = lambda part: sorted(r.id for r in json_docs.contains(df, "doc", part).collect())
    assert ids({"age": 3}) == [1, 2] and ids({"tags": ["y"]}) == [1] and ids({"addr": {"city": "B"}}) == [1] and ids([{"k": 2}]) == [5] and ids({"name": None}) == [2] and ids({"age": "3"}) == []
    got = {r.id: (r.a, r.b, r.c) for r in df.select("id", json_docs.get_text(F.col("doc"), "name").alias("a"), json_docs.get(F.col("doc"), "tags", 0).alias("b"), json_docs.get_text(F.col("doc"), "addr", "city").alias("c")).collect()}
    assert got[1] == ("a", '"x"', "B") and got[2] == ("null", "null", "null") and got[3][1] == "null"
    index = json_docs.posting_lists(df, "id", "doc")
    for part in ({"age": 3}, {"tags": ["y"]}, {"addr": {"city": "B"}}, [{"k": 2}], {"name": None}, {"none": 1}):
        assert sorted(r.id for r in json_docs.indexed_contains(df, index, "id", "doc", part).collect()) == ids(part)
    two = spark.createDataFrame([('{"a":1,"b":[1.0,2]}', '{"b":[1,2.0],"a":1.0}', '{"a":"1.0"}', '{"a":"1"}')], "x string, y string, u string, v string")
    assert tuple(two.select(json_docs.equal(F.col("x"), F.col("y")), json_docs.equal(F.col("u"), F.col("v"))).first()) == (True, False)


def test_text(spark):
    docs = spark.createDataFrame([(1, "Vector database, vector!"), (2, None), (3, ""), (4, "Iechä Vector"), (5, "other words")], "doc_id long, text string")
    assert docs.select(text.tokenize(F.lit("Iechä-X9 é")).alias("t")).first().t == ["iech", "x9"]
    found = text.bm25_search(text.Index.of(docs), "vector Vector search", 10).collect()
    assert [r.doc_id for r in found][:2] == [1, 4] and [r.doc_id for r in found][2:] == [2, 3, 5] and found[2].bm25 == 0
    assert text.bm25_scores(text.Index.of(docs), "", text.SearchConfig()).agg(F.sum("bm25")).first()[0] == 0
    dense = spark.createDataFrame([(5, 0.9), (1, 0.1)], "doc_id long, dense double")
    rrf = {r.doc_id: r.score for r in text.hybrid_search(text.Index.of(docs), "vector", dense, 10, text.SearchConfig(mode="rrf")).collect()}
    assert abs(rrf[1] - (0.5 / 61 + 0.5 / 62)) < 1e-12 and abs(rrf[4] - 0.5 / 62) < 1e-12 and abs(rrf[5] - (0.5 / 65 + 0.5 / 61)) < 1e-12
    weighted = {r.doc_id: r for r in text.hybrid_search(text.Index.of(docs), "nothing", dense, 10).collect()}
    assert weighted[5].score == 0.5 and weighted[2].dense == 0.1 and weighted[2].score == 0
    assert text.fnv1a64("a") == 0xAF63DC4C8601EC8C


def test_vectors(spark):
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.a, r.b) for r in zero.select("vec_id", vector.cosine_distance(F.col("embedding"), vector.vector([1, 0])).alias("a"), vector.l2(F.col("embedding"), vector.vector([0, 0])).alias("b")).collect()}
    assert got[1] == (1.0, 0.0) and abs(got[2][0] - 0.4) < 1e-12 and got[2][1] == 5.0
    same = spark.createDataFrame([(i, [1.0, float(i // 3)]) for i in range(9)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vector.nearest(same, [1.0, 0.0], 4).collect()] == [0, 1, 2, 3]
    assert [r.vec_id for r in vector.nearest(same, [1.0, 0.0], 2, where=F.col("vec_id") > 4).collect()] == [5, 6]
    lo, hi = vector.sq8_ranges(same)
    codes = [list(r[0]) for r in same.orderBy("vec_id").select(vector.sq8_encode(F.col("embedding"), lo, hi)).collect()]
    assert codes[0] == [0, 0] and codes[8] == [0, 255]
    assert (vector.auto_ef(10_000, 10), vector.autotune_ef(10_000, 10, 0.1), vector.prefer_inverted_lists(50_000)) == (100, 200, True)


def test_inverted_list_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32)) * 3
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32))).astype(np.float32)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    queries = base.filter("vec_id % 100 = 0")
    exact = {(r.query_id, r.id) for r in vector.knn(base, queries, 10).collect()}
    assert len(exact) == 400
    ivf = vector.InvertedLists.fit(base, m=16)
    found = {(r.query_id, r.id) for r in ivf.search(ivf.index(base), queries, 10, n_probe=max(8, len(ivf.centres) // 8)).collect()}
    assert len(found & exact) / len(exact) >= 0.9
    blocks = {(r.query_id, r.id) for r in vector.knn(base, queries, 10, block=7).collect()}
    assert blocks == exact


def test_versions(spark):
    start = spark.createDataFrame([], "key string, value int, begin_ts long, end_ts long")
    v = versioned.insert(start, spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int"), 1)
    v = versioned.update(v, F.col("key") == "a", {"value": F.lit(10)}, 2)
    v = versioned.delete(v, F.col("key") == "b", 3)
    state = [sorted((r.key, r.value) for r in versioned.visible(v, s).collect()) for s in range(4)]
    assert state == [[], [("a", 1), ("b", 2)], [("a", 10), ("b", 2)], [("a", 10)]]
    assert versioned.purge(v, 3).count() == 1
    assert sorted((r.lsn, r.key, r.op) for r in versioned.changes(v).collect()) == [(1, "a", "insert"), (1, "b", "insert"), (2, "a", "update"), (3, "b", "delete")]
    index = spark.createDataFrame([(1, 7, 100), (2, 8, 200)], "skey int, pk int, created int")
    assert versioned.index_lookup(index, 1, 150).count() == 1 and versioned.index_lookup(index, 1, 150, 50).count() == 0 and versioned.index_range(index, 1, 2, 150, 60).count() == 2


def test_global_rank(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = global_rank(df, "rank", F.col("x").desc(), F.col("id").asc()).collect()
    assert all(r["rank"] == 1000 - r.x for r in got)


def test_deep_json(spark):
    deep = "[" * 200_000 + "]" * 200_000
    df = spark.createDataFrame([(1, deep), (2, '{"a": [[1e2]]}'), (3, '{"it\'s": 12345678901234567890123}')], "id long, doc string")
    assert [r.id for r in json_docs.contains(df, "doc", {"a": [[100]]}).collect()] == [2]
    assert [r.id for r in json_docs.contains(df, "doc", {"it's": 12345678901234567890123}).collect()] == [3]
    assert json_docs.contains(df, "doc", {"it's": 12345678901234567890124}).count() == 0
    assert {r.doc_id for r in json_docs.posting_lists(df, "id", "doc").collect()} == {2, 3}


def test_text_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common word{i % 7} rare{i}") for i in range(300)], "doc_id long, text string")
    index = text.Index.of(docs, f"file://{tmp_path}/index")
    again = text.Index.of(docs.limit(0), f"file://{tmp_path}/index")  # opened, not built
    assert (again.n, again.average) == (300, 3.0) == (index.n, index.average)
    scores, most = index.scores("rare5 word3")
    assert most == 43 and scores.count() == 44
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and "PushedFilters: [In(term" in plan
    assert [r.doc_id for r in text.bm25_search(index, "rare299 nothing", 3).collect()] == [299, 0, 1]


def test_product_quantizer():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    pq = vector.ProductQuantizer.fit(x, 8)
    codes = pq.encode(x)
    assert codes.shape == (3000, 8) and codes.dtype == np.uint8
    near = pq.decode(codes)
    assert ((x - near) ** 2).sum() < 0.1 * (x**2).sum()
    # no other centre of a slice is nearer, and distances by tables are those to the decoded vectors
    for k, (part, book) in enumerate(zip(np.split(x, 8, axis=1), pq.codebooks, strict=True)):
        own = ((part - book[codes[:, k]]) ** 2).sum(1)
        assert (own[:, None] <= ((part[:, None, :] - book[None]) ** 2).sum(2) + 1e-9).all()
    q = rng.normal(size=16)
    assert np.allclose(pq.distances(codes, pq.tables(q)), ((near - q) ** 2).sum(1))


def test_search_picks_its_way(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    base = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>")
    queries = base.filter("vec_id % 100 = 0")
    exact = {(r.query_id, r.id) for r in vector.search(base, queries, 5, F.col("label") == 1).collect()}
    d = ((x[:, None, :] - x[None, ::100]) ** 2).sum(2)
    d[np.arange(1500) % 3 != 1] = np.inf
    assert exact == {(100 * k, int(i)) for k in range(15) for i in np.argsort(d[:, k], kind="stable")[:5]}
    monkeypatch.setattr(vector, "prefer_inverted_lists", lambda n: True)
    found = {(r.query_id, r.id) for r in vector.search(base, queries, 5, F.col("label") == 1).collect()}
    assert len(found) == len(exact) and len(found & exact) / len(exact) >= 0.9


def test_gaps_and_intervals(spark):
    rows = spark.createDataFrame([(-30, 1.0, "a"), (5, 2.0, "a"), (25, 4.0, "a"), (100, 1.0, "b")], "ts_ms long, value double, k string")
    full = timeseries.gap_fill(timeseries.bucket_aggregate(rows, 10, "k"), 10, "k", fill="last").collect()
    assert sorted((r.k, r.bucket_start, r.total, r.n, r.average) for r in full) == [("a", -30, 1.0, 1, 1.0), ("a", -20, 0.0, 0, 1.0), ("a", -10, 0.0, 0, 1.0), ("a", 0, 2.0, 1, 2.0), ("a", 10, 0.0, 0, 2.0), ("a", 20, 4.0, 1, 4.0), ("b", 100, 1.0, 1, 1.0)]
    assert timeseries.gap_fill(timeseries.bucket_aggregate(rows.limit(0), 10), 10).count() == 0
    spans = spark.createDataFrame([(1, -40, 6), (2, 5, 5), (3, 5, 26), (4, 0, 1000)], "id int, low long, high long")
    got = timeseries.interval_join(rows, spans, 10).collect()
    assert sorted((r.id, r.ts_ms) for r in got) == [(1, -30), (1, 5), (3, 5), (3, 25), (4, 5), (4, 25), (4, 100)]


def test_retention_deletes_folders(spark, tmp_path):
    rows = spark.createDataFrame([(t, float(t)) for t in range(-20, 100, 5)], "ts_ms long, value double")
    path = f"file://{tmp_path}/hypertable"
    timeseries.write_hypertable(rows, path, 10)
    assert timeseries.drop_chunks(spark, path, 35, 10) == 5
    assert sorted(p.name for p in (tmp_path / "hypertable").glob("chunk_start=*")) == [f"chunk_start={k}" for k in range(30, 100, 10)]
    assert spark.read.parquet(path).agg(F.min("ts_ms")).first()[0] == 30 and timeseries.drop_chunks(spark, path, 35, 10) == 0


def test_equal_parts_give_equal_bm25_scores(spark):
    """Forty documents with the same words, whose postings come in different orders: all ranks go by id."""
    rng, terms = random.Random(3), ["ab", "cd", "ef", "gh", "ij"]
    rows = [(k, term, tf, 61) for k in range(40) for term, tf in rng.sample([*zip(terms, (1, 3, 2, 7, 5), strict=True)], 5)] + [(99, "ab", 1, 9), (98, "cd", 1, 9)]
    found = spark.createDataFrame(rows, "doc_id long, term string, tf long, len int").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(text.BUCKETS)).cast("int")).coalesce(1)
    lengths = spark.createDataFrame([(k, 61) for k in range(40)] + [(99, 9), (98, 9)], "doc_id long, len int")
    index = text.Index(found, lengths, 42, 58.5)
    scores = {r.doc_id: r.bm25 for r in text.bm25_scores(index, " ".join(terms)).collect()}
    assert len({scores[k] for k in range(40)}) == 1
    dense = spark.createDataFrame([], "doc_id long, dense double")
    fused = text.hybrid_search(index, " ".join(terms), dense, 40, text.SearchConfig(mode="rrf")).collect()
    assert [r.doc_id for r in fused] == list(range(40))


def test_postings_need_no_shuffle(spark, monkeypatch):
    """Odd texts, split into parts anywhere, give what ``tokenize`` gives; lists are made where documents are read."""
    rng = random.Random(4)
    signs = [*"abzABZ019 -_.\n", "é", "ſ", "K", "İ", "日", "\0", "😀"]
    rows = [(f"d{k}", None if k % 50 == 1 else "".join(rng.choice(signs) for _ in range(k % 40))) for k in range(400)]
    docs = spark.createDataFrame(rows, "name string, body string")
    tokens = {r.name: r.t for r in docs.select("name", text.tokenize(F.col("body")).alias("t")).collect()}
    want = sorted((d, term, tf, len(t)) for d, t in tokens.items() for term, tf in Counter(t).items())
    found = text.postings(docs, "name", "body")
    assert sorted(map(tuple, found.collect())) == want
    assert "Exchange" not in text.postings(docs, "name", "body")._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.len for r in text.document_lengths(docs, "name", "body").collect()} == {d: len(t) for d, t in tokens.items()}
    assert sorted(map(tuple, text.postings_with_frequency(docs, "name", "body").drop("df").collect())) == want
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([t and t.encode() for _, t in rows], pa.binary())], ["id", "text"])
    for size in (1, 30, 1000):
        monkeypatch.setattr(text, "PART_BYTES", size)
        parts = [text._lists(*part).to_pylist() for part in text._parts(iter([batch.slice(0, 150), batch.slice(150, 0), batch.slice(150)]))]
        assert len(parts) > 5
        assert sorted((d, r["term"], tf, n) for part in parts for r in part for d, tf, n in zip(r["docs"], r["tfs"], r["lens"], strict=True)) == want


def test_frequencies_join_lists(spark):
    """Lists, not a row for each document, are joined with the frequencies; never by broadcast, whose figures say nothing of larger tables."""
    docs = spark.createDataFrame([(k, f"all {'some' if k % 3 else 'few'} own{k}") for k in range(300)], "doc_id long, text string")
    found = text.postings_with_frequency(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") and "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    df = {"all": 300, "some": 200, "few": 100}
    assert sorted((r.doc_id, r.term, r.tf, r.len, r.df) for r in found.collect()) == sorted((k, term, 1, 3, df.get(term, 1)) for k in range(300) for term in ("all", "some" if k % 3 else "few", f"own{k}"))
