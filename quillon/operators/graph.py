"""Graph index: approximate nearest neighbours by walks over graphs of near vectors, with filters evaluated on the way.

Rows are dealt to shards by a hash of their id, so a shard has a bounded number of rows however many there are and whatever clusters they form. A shard's graph is built by one task and
is one row of the index: ids, vectors, links, optional product-quantised codes, and the columns that filters may use. A search reads the index without a shuffle; each task walks the graphs
of its shards for a block of queries, and the shards' best meet in one window per query. Rows added later become shards of their own.

Two searches: ``search`` walks by exact distances. ``search_by_codes`` reads links and codes alone, not the vectors, and measures the best ``rerank`` of each query exactly in a join with the table.

Defined results: null vectors aren't indexed; vectors of different lengths are an error; equal distances are ordered by id; with a filter there are k hits whenever k rows match; rows for which the filter is null don't
match; an empty table gives an index that finds nothing. Distances are Euclidean.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.vector import CELLS, SAMPLE_ROWS, ProductQuantizer, _matrix, auto_ef, autotune_ef, best_k, l2, sample_vectors

#: Rows and bytes of vectors a shard has in the mean.
SHARD_ROWS = 8192
SHARD_BYTES = 16 << 20
QUERY_BLOCK = 512
#: Rows that pass a filter are all measured where there are no more than this.
FEW = 64
#: One row in so many belongs to the upper level, where every walk begins.
UPPER = 16
#: Nodes of a walk whose links are followed in one step.
STEP = 4


def _others(x: np.ndarray, width: int) -> np.ndarray:
    """Each row's ``width`` nearest other rows, the nearest first."""
    out, sq = np.empty((len(x), width), np.int32), (x**2).sum(1)
    step = max(1, CELLS // len(x))
    for a in range(0, len(x), step):
        d = sq[None, :] - 2 * x[a : a + step] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        at = np.argpartition(d, width - 1, axis=1)[:, :width]
        out[a : a + step] = np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, 1), axis=1, kind="stable"), 1)
    return out


def _diverse(x: np.ndarray, near: np.ndarray, m: int) -> np.ndarray:
    """m of each row's near rows: first those nearer to it than to any nearer one chosen before, then the nearest of the rest."""
    out, width = np.empty((len(x), m), np.int32), near.shape[1]
    step = max(1, CELLS // (width * max(width, x.shape[1])))
    for a in range(0, len(x), step):
        own = near[a : a + step]
        v = x[own]
        sq = (v**2).sum(2)
        between = sq[:, :, None] + sq[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
        to_row = ((v - x[a : a + step, None, :]) ** 2).sum(2)
        chosen, left = np.zeros(own.shape, bool), np.full(own.shape, np.inf)
        for k in range(width):
            chosen[:, k] = left[:, k] > to_row[:, k]
            left = np.where(chosen[:, k, None], np.minimum(left, between[:, k]), left)
        out[a : a + step] = np.take_along_axis(own, np.argsort(~chosen, axis=1, kind="stable")[:, :m], 1)
    return out


def link(x: np.ndarray, m: int) -> np.ndarray:
    """[n, 2m + 1] rows that each row leads to, -1 where there are fewer: m chosen ones, up to m that chose it, and its successor in a ring of all rows, so that each can be reached from any."""
    n = len(x)
    out = np.full((n, 2 * m + 1), -1, np.int32)
    if n < 2:
        return out
    m = min(m, n - 1)
    chosen = _diverse(x, _others(x, min(n - 1, 3 * m)), m)
    out[:, :m] = chosen
    to, of = chosen.reshape(-1).astype(np.int64), np.repeat(np.arange(n), m)
    new = ~np.isin(to * n + of, of * n + to)
    to, of, nearness = to[new], of[new], np.tile(np.arange(m), n)[new]
    order = np.lexsort((of, nearness, to))
    to, of = to[order], of[order]
    place = np.arange(len(to)) - np.searchsorted(to, to)
    fits = place < m
    out[to[fits], m + place[fits]] = of[fits]
    out[:, -1] = np.roll(np.arange(n), -1)
    return out


def walk(distance: Callable[[np.ndarray, np.ndarray], np.ndarray], links: np.ndarray, n_queries: int, ef: int, passes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of up to ef rows per query, -1 and infinity where there are fewer; only rows that pass, but the walk leads through all.

    distance: of the given queries to the given rows, [q, w] for rows [q, w] or [1, w].
    """
    n = len(links)
    upper = np.arange(min(n, max(ef, n // UPPER)))
    every = np.arange(n_queries)
    seen = np.zeros((n_queries, n), bool)
    seen[:, : len(upper)] = True
    d = distance(every, upper[None, :])
    rows = np.broadcast_to(upper, d.shape)

    def best(rows: np.ndarray, d: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
        at = np.argpartition(d, ef - 1, axis=1)[:, :ef] if d.shape[1] > ef else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        return [np.take_along_axis(a, at, 1) for a in (rows, d, *more)]

    def passing(rows: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.where(passes[rows] & np.isfinite(d), d, np.inf)

    found = best(rows, passing(rows, d)) if passes is not None else None
    beam, beam_d, done = best(rows, d, np.zeros(d.shape, bool))
    while True:
        open_ = np.where(done, np.inf, beam_d)
        active = np.flatnonzero(np.isfinite(open_.min(1)))
        if not len(active):
            break
        own = open_[active]
        pick = np.argpartition(own, STEP - 1, axis=1)[:, :STEP] if own.shape[1] > STEP else np.broadcast_to(np.arange(own.shape[1]), own.shape)
        real = np.isfinite(np.take_along_axis(own, pick, 1))
        done[active[:, None], pick] |= real
        next_ = np.where(real[:, :, None], links[beam[active[:, None], pick]], -1).reshape(len(active), -1)
        next_.sort(axis=1)
        new = (next_ >= 0) & ~seen[active[:, None], next_]
        new[:, 1:] &= next_[:, 1:] != next_[:, :-1]
        width = max(1, int(new.sum(1).max()))
        next_ = np.take_along_axis(next_, np.argsort(~new, axis=1, kind="stable")[:, :width], 1)
        new = np.arange(width)[None, :] < new.sum(1)[:, None]
        next_ = np.where(new, next_, 0)
        at, place = np.nonzero(new)
        seen[active[at], next_[at, place]] = True
        d = np.where(new, distance(active, next_), np.inf)
        if found is not None:
            more = best(np.concatenate([found[0][active], next_], 1), np.concatenate([found[1][active], passing(next_, d)], 1))
            found = [_widened(f, m, active, fill) for f, m, fill in zip(found, more, (0, np.inf), strict=True)]
        state = best(np.concatenate([beam[active], next_], 1), np.concatenate([beam_d[active], d], 1), np.concatenate([done[active], ~new], 1))
        beam, beam_d, done = (_widened(b, s, active, fill) for b, s, fill in zip((beam, beam_d, done), state, (0, np.inf, True), strict=True))
    rows, d = found if found is not None else (beam, beam_d)
    return np.where(np.isfinite(d), rows, -1), d


def _widened(array: np.ndarray, part: np.ndarray, at: np.ndarray, fill) -> np.ndarray:
    """``array`` with ``part`` in the rows ``at``, as wide as the wider one."""
    out = np.full((len(array), max(array.shape[1], part.shape[1])), fill, array.dtype)
    out[:, : array.shape[1]] = array
    out[at] = fill
    out[at[:, None], np.arange(part.shape[1])[None, :]] = part
    return out


@dataclass(frozen=True)
class GraphIndex:
    """A folder with one row per shard."""

    path: str
    m: int = 16
    quantizer: ProductQuantizer | None = None
    id_col: str = "vec_id"
    vec_col: str = "embedding"
    attributes: tuple[str, ...] = ()

    @classmethod
    def build(cls, base: DataFrame, path: str, m: int = 16, codes: int | None = None, attributes: tuple[str, ...] = (), id_col: str = "vec_id", vec_col: str = "embedding") -> GraphIndex:
        """codes: the number of slices to quantise, if searches by codes are wanted (codebooks come from a bounded sample). attributes: the columns that filters may use."""
        quantizer = None
        if codes:
            sample = sample_vectors(base, SAMPLE_ROWS, vec_col, id_col)
            quantizer = ProductQuantizer.fit(sample, codes) if len(sample) else None
        index = cls(path, m, quantizer, id_col, vec_col, tuple(attributes))
        index.add(base)
        return index

    def add(self, rows: DataFrame) -> None:
        """Index more rows, in shards of their own."""
        shown = rows.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.vec_col).cast("array<float>").alias("v"), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in self.attributes]).alias("attrs")).filter("v IS NOT NULL")
        r = shown.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.min(F.size("v")).alias("least")).first()
        if r["n"] and r["dim"] != r["least"]:
            raise ValueError("dimensions differ")
        n = max(1, math.ceil(r["n"] / SHARD_ROWS), math.ceil(r["n"] * 4 * (r["dim"] or 0) / SHARD_BYTES))
        attrs = shown.schema["attrs"].dataType
        m, quantizer = self.m, self.quantizer

        def graph(table: pa.Table) -> pa.Table:
            ids, x = table.column("id").to_numpy(), _matrix(table.column("v"))
            order = np.argsort((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), kind="stable")  # the first rows are any rows: the upper level
            ids, x = ids[order], x[order]
            own = table.column("attrs").combine_chunks().take(pa.array(order))
            own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
            own = pa.StructArray.from_arrays(own.flatten(), fields=[f.with_nullable(True) for f in own.type])
            code = quantizer.encode(x).tobytes() if quantizer else b""
            blobs = [ids.tobytes(), x.astype(np.float32).tobytes(), link(x, m).tobytes(), code]
            return pa.table([pa.array([len(ids)], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), own)], ["n", "ids", "vectors", "links", "codes", "attrs"])

        dealt = shown.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n))).repartition(n, "shard")
        schema = f"n long, ids binary, vectors binary, links binary, codes binary, attrs array<{attrs.simpleString()}>"
        dealt.groupBy("shard").applyInArrow(graph, schema).write.mode("append").parquet(self.path)

    def _found(self, queries: DataFrame, k: int, keep: int, ef: int | None, where: Callable[[Column], Column] | None, by_codes: bool):
        """Per block of queries: (the block, (query_id, id, distance) of up to ``keep`` rows per query and shard)."""
        spark = queries.sparkSession
        index = spark.read.parquet(self.path)
        passes = F.transform("attrs", lambda a: F.coalesce(where(a), F.lit(False))) if where is not None else F.lit(None).cast("array<boolean>")
        shown = index.select("n", "ids", "links", F.col("codes" if by_codes else "vectors").alias("data"), passes.alias("passes"))
        total, matching = index.select(F.sum("n"), F.sum(F.size(F.filter(passes, lambda p: p)) if where is not None else F.col("n"))).first()
        total, matching = total or 0, matching or 0
        width = ef or max(auto_ef(total, k), autotune_ef(total, k, matching / total) if where is not None and total else 0, 1)
        width = max(width, keep)
        quantizer = self.quantizer
        wanted = queries.select(F.col(self.id_col).cast("long").alias("query_id"), F.col(self.vec_col).cast("array<float>").alias("q")).filter("q IS NOT NULL")
        n_blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
        for b in range(n_blocks):
            block = wanted.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b)
            own = block.toArrow().sort_by("query_id")
            shared = spark.sparkContext.broadcast((own.column("query_id").to_numpy(), _matrix(own.column("q"))))

            def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                query_ids, q = shared.value
                tables = np.stack([quantizer.tables(v) for v in q]) if by_codes and len(q) else None
                for batch in batches:
                    for row in range(len(batch)) if len(q) else ():
                        n = batch.column("n")[row].as_py()
                        blob = lambda name, t, row=row, n=n, batch=batch: np.frombuffer(batch.column(name)[row].as_buffer(), t).reshape(n, -1)
                        ids, data, links = blob("ids", np.int64)[:, 0], blob("data", np.uint8 if by_codes else np.float32), blob("links", np.int32)
                        if not by_codes and data.shape[1] != q.shape[1]:
                            raise ValueError("dimensions differ")

                        def distance(at: np.ndarray, rows: np.ndarray, data=data) -> np.ndarray:
                            step, parts = max(1, CELLS // (rows.shape[1] * data.shape[1])), []
                            for a in range(0, len(at), step):
                                who, x = at[a : a + step], data[rows if len(rows) == 1 else rows[a : a + step]]
                                if by_codes:
                                    parts.append(tables[who[:, None, None], np.arange(data.shape[1])[None, None, :], x].sum(2))
                                else:
                                    parts.append(((x - q[who][:, None, :]) ** 2).sum(2))
                            return np.sqrt(np.concatenate(parts))

                        allowed = None
                        if batch.column("passes")[row].is_valid:
                            allowed = batch.column("passes")[row].values.to_numpy(zero_copy_only=False).astype(bool)
                        few = np.flatnonzero(allowed) if allowed is not None else np.arange(n)
                        if not len(few):
                            continue
                        if len(few) <= max(FEW, width if allowed is not None else 0):
                            d = distance(np.arange(len(q)), few[None, :])
                            at = np.broadcast_to(few, d.shape).copy()
                        else:
                            at, d = walk(distance, links, len(q), width, allowed)
                            lacking = np.flatnonzero((at >= 0).sum(1) < min(k, len(few)))
                            if len(lacking):  # the walk met too few that pass: these queries measure all that do
                                exact = distance(lacking, few[None, :])
                                cut = np.argsort(exact, axis=1, kind="stable")[:, :width]
                                at, d = _widened(at, few[cut], lacking, -1), _widened(d, np.take_along_axis(exact, cut, 1), lacking, np.inf)
                        found = np.where(at >= 0, ids[at], np.iinfo(np.int64).max)
                        order = np.lexsort((found, d), axis=1)[:, :keep]
                        found, d = np.take_along_axis(found, order, 1), np.take_along_axis(d, order, 1)
                        who, place = np.nonzero(np.isfinite(d))
                        yield pa.RecordBatch.from_arrays([pa.array(query_ids[who]), pa.array(found[who, place]), pa.array(d[who, place])], ["query_id", "id", "distance"])

            yield block, shown.mapInArrow(search, "query_id long, id long, distance double")

    def search(self, queries: DataFrame, k: int, ef: int | None = None, where: Callable[[Column], Column] | None = None) -> DataFrame:
        """(query_id, id, distance, rank). where: a condition on the struct of attributes, like ``lambda row: row["label"] == 3``. ef: rows a walk keeps; more are slower and more exact."""
        out = None
        for _, found in self._found(queries, k, k, ef, where, False):
            out = found if out is None else out.union(found)
        return best_k(out, k)

    def search_by_codes(self, base: DataFrame, queries: DataFrame, k: int, ef: int | None = None, rerank: int = 100, where: Callable[[Column], Column] | None = None) -> DataFrame:
        """(query_id, id, distance, rank): walks by quantised distances; the ``rerank`` best of each query are measured exactly. ``base`` has the indexed rows.

        What is broadcast is at most QUERY_BLOCK * rerank pairs and QUERY_BLOCK query vectors at a time.
        """
        if self.quantizer is None and queries.sparkSession.read.parquet(self.path).limit(1).count():
            raise ValueError("the index was built without codes")
        rerank, out = max(rerank, k), None
        vectors = base.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.vec_col).cast("array<float>").alias("v"))
        for block, found in self._found(queries, k, rerank, ef, where, True):
            pairs = best_k(found, rerank).select("query_id", "id").join(F.broadcast(block), "query_id")
            exact = vectors.join(F.broadcast(pairs), "id").select("query_id", "id", l2(F.col("v"), F.col("q")).alias("distance"))
            out = exact if out is None else out.union(exact)
        return best_k(out, k)
