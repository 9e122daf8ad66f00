"""Vector search: exact and filtered nearest neighbours, inverted lists, scalar and product quantisation with exact re-ranking.

Expressions (``l2``, ``cosine_distance``) serve single queries inside Spark's code generation. Batches of queries go through Arrow: a block of queries is
broadcast, each task keeps its own best k per query, and these few rows meet in one window per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.sources.work import written

QUERY_BLOCK = 4096
SAMPLE_ROWS = 20_000
#: Distances held at once by a task.
CELLS = 1 << 20


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def squared_l2(a: Column, b: Column) -> Column:
    """In double; an error if the dimensions differ."""
    d = _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    return F.when(F.size(a) == F.size(b), d).otherwise(F.raise_error("dimensions differ").cast("double"))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if a vector is zero."""
    dot = lambda x, y: _sum(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 1.0).otherwise(1 - F.least(F.greatest(dot(a, b) / norm, F.lit(-1.0)), F.lit(1.0)))


def vector(values) -> Column:
    return F.array(*[F.lit(float(v)).cast("float") for v in values])


def nearest(base: DataFrame, query, k: int, where: Column | None = None, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, distance): the k nearest of the rows that pass the filter, by distance, then id. The filter runs first, so there are k hits whenever k rows match."""
    rows = base if where is None else base.filter(where)
    d = (l2 if metric == "l2" else cosine_distance)(F.col(vec_col), vector(query))
    return rows.select(id_col, d.alias("distance")).orderBy("distance", id_col).limit(k)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _exact(queries: np.ndarray, base: np.ndarray, at: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each query to its rows ``at``, from the differences themselves."""
    x = base[at]
    if metric == "l2":
        return np.sqrt(((x - queries[:, None, :]) ** 2).sum(2))
    norm = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(x, axis=2)
    return np.where(norm == 0, 1.0, 1 - np.clip(np.divide((x * queries[:, None, :]).sum(2), norm, out=np.zeros_like(norm), where=norm > 0), -1, 1))


def _nearest_rows(queries: np.ndarray, base: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of each query, its k nearest among them: found by one product of matrices, then measured exactly. More than k where rounding or ties leave it open which they are."""
    if queries.shape[1] != base.shape[1]:
        raise ValueError("dimensions differ")
    if len(base) <= k:
        at = np.broadcast_to(np.arange(len(base)), (len(queries), len(base)))
        return at, _exact(queries, base, at, metric)
    q2, b2 = (queries**2).sum(1)[:, None], (base**2).sum(1)[None, :]
    if metric == "l2":
        near = q2 + b2 - 2 * queries @ base.T
        slack = 1e-9 * (q2 + b2.max())
    else:
        norm = np.sqrt(q2 * b2)
        near = np.where(norm == 0, 1.0, 1 - np.divide(queries @ base.T, norm, out=np.zeros_like(norm), where=norm > 0))
        slack = np.full((len(queries), 1), 1e-9)
    least = np.partition(near, k - 1, axis=1)[:, k - 1 : k] + slack
    width = int((near <= least).sum(1).max())
    at = np.argpartition(near, width - 1, axis=1)[:, :width] if width < len(base) else np.broadcast_to(np.arange(len(base)), near.shape)
    step = max(1, CELLS // max(1, width * base.shape[1]))
    parts = [_exact(queries[a : a + step], base, at[a : a + step], metric) for a in range(0, len(queries), step)]
    return at, np.concatenate(parts)


def best_k(found: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, rank): each query's k best of the tasks' own bests."""
    w = W.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """Exact nearest neighbours of every query among all rows: (query_id, id, distance, rank). Queries come in blocks, each one pass over the base."""
    spark = base.sparkSession
    rows = base.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter("v IS NOT NULL")
    wanted = queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter("v IS NOT NULL")
    n_blocks = max(1, -(-wanted.count() // block))
    out = None
    for b in range(n_blocks):
        own = wanted.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).toArrow().sort_by("id")
        shared = spark.sparkContext.broadcast((own.column("id").to_numpy(), _matrix(own.column("v"))))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best_d, best_i = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                if not len(batch) or not len(ids):
                    continue
                x, rid, step = _matrix(batch.column("v")), batch.column("id").to_numpy(), max(k, CELLS // len(ids))
                for a in range(0, len(x), step):
                    near, d = _nearest_rows(q, x[a : a + step], k, metric)
                    best_d = np.concatenate([best_d, d], 1)
                    best_i = np.concatenate([best_i, rid[a : a + step][near]], 1)
                    order = np.lexsort((best_i, best_d), axis=1)[:, :k]
                    best_d, best_i = np.take_along_axis(best_d, order, 1), np.take_along_axis(best_i, order, 1)
            if best_d.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_d.shape[1])), pa.array(best_i.reshape(-1)), pa.array(best_d.reshape(-1))], ["query_id", "id", "distance"])

        found = rows.mapInArrow(search, "query_id long, id long, distance double")
        out = found if out is None else out.union(found)
    return best_k(out, k)


def auto_ef(n: int, k: int, default: int = 64) -> int:
    """A search width that grows with the square root of the table's size."""
    return min(max(default, k, math.ceil(k * math.sqrt(n) / 10)), 1024, n)


def autotune_ef(n: int, k: int, selectivity: float) -> int:
    """A search width for a filter that lets this share of the rows pass."""
    return min(max(32, min(1024, math.ceil(k / max(selectivity, 1e-9) * 2))), n)


def prefer_inverted_lists(n: int) -> bool:
    return n >= 50_000


def search(base: DataFrame, queries: DataFrame, k: int, where: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", exact: bool = False) -> DataFrame:
    """(query_id, id, distance, rank): exact search of small tables, inverted lists for large ones. A filter runs first, so there are k hits whenever k rows match; it widens what is measured exactly as few rows pass.

    exact: the very nearest at any size. Lists only ever give most of them.
    """
    if exact:
        return knn(base if where is None else base.filter(where), queries, k, id_col=id_col, vec_col=vec_col)
    total = base.count()
    rows = base if where is None else base.filter(where)
    n = total if where is None else rows.count()
    if not prefer_inverted_lists(n):
        return knn(rows, queries, k, id_col=id_col, vec_col=vec_col)
    width = auto_ef(n, k) if where is None else max(auto_ef(n, k), autotune_ef(n, k, n / max(total, 1)))
    lists = InvertedLists.fit(rows, id_col=id_col, vec_col=vec_col)
    index = written(lists.index(rows, id_col, vec_col).repartition("cell"), "inverted-lists")
    return lists.search(index, queries, k, n_probe=lists.half(), rerank=max(200, width), id_col=id_col, vec_col=vec_col)


# --- scalar quantisation ---------------------------------------------------------------------------------------------


def sq8_ranges(base: DataFrame, vec_col: str = "embedding") -> tuple[list[float], list[float]]:
    """Each dimension's least and greatest value, from all rows: one aggregation, as many figures as dimensions."""
    cells = base.select(F.posexplode(vec_col).alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("dim").collect()
    return [float(r["lo"]) for r in cells], [float(r["hi"]) for r in cells]


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def sq8_encode(v: Column, lo: list[float], hi: list[float]) -> Column:
    """array<int> of 0..255; a dimension without spread gives 0."""
    scale = [255 / (h - x) if h > x else 0.0 for x, h in zip(lo, hi, strict=True)]
    scaled = F.zip_with(F.zip_with(v, _doubles(lo), lambda a, m: a.cast("double") - m), _doubles(scale), lambda a, s: a * s)
    return F.transform(scaled, lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int"))


def sq8_decode(codes: Column, lo: list[float], hi: list[float]) -> Column:
    step = [(h - x) / 255 for x, h in zip(lo, hi, strict=True)]
    return F.zip_with(F.zip_with(codes, _doubles(step), lambda c, s: c * s), _doubles(lo), lambda a, m: a + m)


def sq8_search(base: DataFrame, query, k: int, rerank: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Coarse search over the codes of all rows, exact distances for the best ``rerank``."""
    lo, hi = sq8_ranges(base, vec_col)
    decoded = sq8_decode(sq8_encode(F.col(vec_col), lo, hi), lo, hi)
    coarse = base.select(id_col, vec_col, squared_l2(decoded, vector(query)).alias("coarse")).orderBy("coarse", id_col).limit(max(rerank, k))
    return nearest(coarse, query, k, id_col=id_col, vec_col=vec_col)


# --- k-means, inverted lists, product quantisation --------------------------------------------------------------------------


def sample_vectors(base: DataFrame, rows: int, vec_col: str, id_col: str) -> np.ndarray:
    """About ``rows`` vectors, chosen by a hash of the id: the bound on what the driver gets."""
    n = base.count()
    share = min(1.0, rows / max(n, 1))
    picked = base.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_003)) <= int(share * 1_000_003)).select(id_col, vec_col).filter(F.col(vec_col).isNotNull())
    return _matrix(picked.toArrow().sort_by(id_col).column(vec_col))


def k_means(x: np.ndarray, k: int, rounds: int = 15, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest_centre(x, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


@dataclass
class ProductQuantizer:
    """Codebooks of up to 256 centres for each of m equal slices of the dimensions."""

    codebooks: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, m: int, seed: int = 42) -> ProductQuantizer:
        return cls([k_means(part, 256, seed=seed + k) for k, part in enumerate(np.array_split(x, m, axis=1))])

    def _slices(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, np.cumsum([c.shape[1] for c in self.codebooks])[:-1], axis=1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([_nearest_centre(p, c) for p, c in zip(self._slices(x), self.codebooks, strict=True)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, k]] for k, c in enumerate(self.codebooks)], 1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of one query's slices to all centres, [m, 256]."""
        out = np.full((len(self.codebooks), 256), np.inf)
        for k, (p, c) in enumerate(zip(self._slices(q[None, :]), self.codebooks, strict=True)):
            out[k, : len(c)] = ((c - p) ** 2).sum(1)
        return out

    def distances(self, codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return tables[np.arange(tables.shape[0])[None, :], codes].sum(1)


@dataclass
class InvertedLists:
    """Cells around k-means centres, with product-quantised residuals. Centres and codebooks come from a bounded sample; every row is indexed."""

    centres: np.ndarray
    quantizer: ProductQuantizer

    @classmethod
    def fit(cls, base: DataFrame, n_cells: int | None = None, m: int = 16, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> InvertedLists:
        x = sample_vectors(base, sample_rows, vec_col, id_col)
        n = n_cells or min(4096, max(1, int(4 * math.sqrt(base.count()))), max(1, len(x) // 8))
        centres = k_means(x, n)
        return cls(centres, ProductQuantizer.fit(x - centres[_nearest_centre(x, centres)], m))

    def half(self) -> int:
        """The number of cells to probe for a recall of over 0.9 on vectors without clusters."""
        return max(1, -(-len(self.centres) // 2))

    def index(self, base: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """(id, cell, code, v). Written with partitionBy("cell"), a search reads the probed cells only."""
        shared = base.sparkSession.sparkContext.broadcast(self)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            me = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                x = _matrix(batch.column("v"))
                cell = _nearest_centre(x, me.centres)
                code = me.quantizer.encode(x - me.centres[cell])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), batch.column("v")], ["id", "cell", "code", "v"])

        rows = base.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter("v IS NOT NULL")
        return rows.mapInArrow(assign, "id long, cell int, code binary, v array<float>")

    def search(self, index: DataFrame, queries: DataFrame, k: int, n_probe: int | None = None, rerank: int = 200, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 1024) -> DataFrame:
        """(query_id, id, distance, rank): the ``rerank`` best by quantised distance in the n_probe nearest cells, ranked by exact distance."""
        spark = index.sparkSession
        n_probe = n_probe or max(1, math.ceil(len(self.centres) / 8))
        wanted = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter("v IS NOT NULL")
        n_blocks = max(1, -(-wanted.count() // block))
        out = None
        for b in range(n_blocks):
            own = wanted.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).toArrow().sort_by("id")
            q = _matrix(own.column("v"))
            near = ((self.centres**2).sum(1)[None, :] - 2 * q @ self.centres.T).argsort(1, kind="stable")[:, :n_probe] if len(q) else np.zeros((0, n_probe), int)
            shared = spark.sparkContext.broadcast((self, own.column("id").to_numpy(), q, near))
            cells = sorted(set(near.reshape(-1).tolist()))

            def probe(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                me, ids, q, near = shared.value
                asks = {c: np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
                best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
                for batch in batches:
                    cell = batch.column("cell").to_numpy()
                    if not len(cell):
                        continue
                    x, rid = _matrix(batch.column("v")).astype(np.float32), batch.column("id").to_numpy()
                    code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(batch), -1)
                    for c in np.unique(cell):
                        at = np.flatnonzero(cell == c)
                        for k_ in asks.get(c, ()):
                            coarse = me.quantizer.distances(code[at], me.quantizer.tables(q[k_] - me.centres[c]))
                            have = best.get(k_, (np.zeros(0), np.zeros(0, np.int64), x[:0]))
                            d, i, v = (np.concatenate(p) for p in zip(have, (coarse, rid[at], x[at]), strict=True))
                            keep = np.lexsort((i, d))[:rerank]
                            best[k_] = (d[keep], i[keep], v[keep])
                # what the codes say is best is measured exactly, and nothing else
                for k_, (d, i, v) in best.items():
                    exact = np.sqrt(((v.astype(np.float64) - q[k_]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), ids[k_])), pa.array(i), pa.array(d), pa.array(exact)], ["query_id", "id", "coarse", "distance"])

            found = index.filter(F.col("cell").isin(cells)).mapInArrow(probe, "query_id long, id long, coarse double, distance double")
            out = found if out is None else out.union(found)
        w = W.partitionBy("query_id").orderBy("coarse", "id")
        coarse = out.withColumn("r_", F.row_number().over(w)).filter(F.col("r_") <= rerank).drop("r_", "coarse")
        return best_k(coarse, k)
