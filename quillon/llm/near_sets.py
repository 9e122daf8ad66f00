"""Links between near-equal sets: MinHash bands, then Bayesian pruning on incrementally compared MinHash values, then exact Jaccard.

Candidates are pairs that share a bucket (one band's hash). A bucket is compared by itself, as pairs of blocks of bounded size; a pair that shares several buckets is compared in the first. MinHash
values are compared ``STEP`` at a time; a pair is dropped once the posterior probability (uniform prior) that its similarity reaches the threshold is below the tolerance. What is left
ties sets into groups. All pairs of a group are verified on the whole sets, again as pairs of blocks, each group's sets being sent once per block. What comes out grows
with the number of sets, not of pairs: for each set its number of links within the block pair, and a spanning forest of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common, packed
from quillon.llm.components import components, forest
from quillon.llm.words import U, mix, runs_hash

STEP = 15
TOLERANCE = 1e-6
BLOCK_SETS = 512
BLOCK_BYTES = 8 << 20
#: Groups of so many sets at most are compared together, so many pairs at a time.
SMALL = 32
PAIRS = 1 << 17


def tune(threshold: float, recall: float, rows: int) -> int:
    """The number of bands of ``rows`` values at which a pair at the threshold shares one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


@lru_cache(maxsize=8)
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) | U(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minhash(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """uint32[len(starts), n]; set k is values[starts[k]:starts[k+1]], none empty."""
    out = np.empty((len(starts), n), np.uint32)
    if len(starts):
        for k, (a, x) in enumerate(zip(*_hashes(n), strict=True)):
            out[:, k] = np.minimum.reduceat((values ^ x) * a, starts) >> U(32)
    return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64[sets, bands]"""
    out = np.empty((len(signatures), bands), np.int64)
    for b in range(bands):
        h = np.full(len(signatures), b + 1, U)
        for k in range(b * rows, (b + 1) * rows):
            h = mix(h * U(0x9E3779B97F4A7C15) + signatures[:, k].astype(U))
        out[:, b] = h.view(np.int64)
    return out


def distinct_sets(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values sorted and distinct within each owner, owners that have any, their starts, a 64-bit digest of each set)."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.append(True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])) if len(v) else np.zeros(0, bool)
    v, o = v[new], o[new]
    starts = np.flatnonzero(np.append(True, o[1:] != o[:-1])) if len(o) else np.zeros(0, np.int64)
    return v, o[starts], starts, runs_hash(v, starts, np.append(starts[1:], len(v)))


@lru_cache(maxsize=32)
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The least number of equal values among n at which P(similarity >= threshold) isn't below the tolerance."""
    j = (np.arange(40_000) + 0.5) / 40_000
    for m in range(n + 1):
        log = m * np.log(j) + (n - m) * np.log1p(-j)
        p = np.exp(log - log.max())
        if p[j >= threshold].sum() / p.sum() >= tolerance:
            return m
    return n


def _sizes_fit(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9


def pruned_pairs(sig_a, size_a, sig_b, size_b, threshold: float, same: bool, skip=()) -> tuple[np.ndarray, np.ndarray]:
    """Places (p, q) of the pairs of a set of A and one of B that may reach the threshold; same: A is B, pairs p < q only. skip: (values of A, values of B); a pair with an equal value is left out."""
    alive = _sizes_fit(size_a[:, None], size_b[None, :], threshold)
    if same:
        alive &= np.arange(len(size_a))[:, None] < np.arange(len(size_b))[None, :]
    for a, b in skip:
        if not alive.any():
            break
        alive &= a[:, None] != b[None, :]
    total, at = sig_a.shape[1], 0
    equal = np.zeros(alive.shape, np.int16)
    while at < total and alive.any() and alive.sum() * 8 > alive.size:
        for k in range(at, min(at + STEP, total)):
            equal += sig_a[:, k][:, None] == sig_b[:, k][None, :]
        at = min(at + STEP, total)
        alive &= equal >= least_matches(at, threshold, TOLERANCE)
    p, q = np.nonzero(alive)
    e = equal[p, q].astype(np.int64)
    while at < total and len(p):
        to = min(at + STEP, total)
        e += (sig_a[p, at:to] == sig_b[q, at:to]).sum(1)
        keep = e >= least_matches(to, threshold, TOLERANCE)
        p, q, e, at = p[keep], q[keep], e[keep], to
    return p, q


def similar_pairs(sig_a, sets_a, sig_b, sets_b, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (p, q) of all pairs of a set of A and one of B with Jaccard >= threshold."""
    size_a, size_b = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
    p, q = pruned_pairs(sig_a, size_a, sig_b, size_b, threshold, same)
    if not len(p):
        return p, q
    common_ = _intersections(sets_a, sets_b, p, q)
    ok = common_ >= threshold * (size_a[p] + size_b[q] - common_) - 1e-9
    return p[ok], q[ok]


def _intersections(sets_a, sets_b, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    if len(p) > 1000:
        every = np.concatenate([*sets_a, *sets_b])
        words, place = np.unique(every, return_inverse=True)
        n, m = len(sets_a), len(sets_b)
        if (n + m) * len(words) <= 8_000_000:
            x = np.zeros((n + m, len(words)), np.float32)
            x[np.repeat(np.arange(n + m), [len(s) for s in (*sets_a, *sets_b)]), place] = 1
            return np.rint(x[:n] @ x[n:].T).astype(np.int64)[p, q]
    return np.array([len(np.intersect1d(sets_a[i], sets_b[k], assume_unique=True)) for i, k in zip(p, q, strict=True)], np.int64)


def _counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, n, len(found)).astype(np.int64)


def _signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Binary values of equal length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column, n = column.cast(pa.large_binary()), len(column)
    if not n:
        return np.zeros((0, 0), np.uint32)
    cuts = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.uint8, int(cuts[-1] - cuts[0]), int(cuts[0])).copy().view(np.uint32).reshape(n, -1)


def _by_group(ids: tuple[str, ...], compare):
    """Over rows sorted by ``ids``: compare is called with the batches of one group at a time, and its result, if any, is a batch of the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ids], 1)
            cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1), len(own)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                now = tuple(own[a])
                if now != last and held:
                    if (out := compare(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                last = now
                held.append(batch.slice(a, b - a))
        if held and (out := compare(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def _by_groups(ids: tuple[str, ...], compare):
    """Likewise, but compare gets tables of many whole groups, and gives batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            own = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ids], 1)
            cut = int(np.flatnonzero((own != own[-1]).any(1)).max(initial=-1)) + 1
            if cut:
                yield from compare(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and last != tuple(own[-1]):
                yield from compare(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
            last = tuple(own[-1])
        if held:
            yield from compare(pa.Table.from_batches(held))

    return run


def _block_pairs(rows: DataFrame, group: str, key: str, *columns: str) -> DataFrame:
    """Rows (group, blocks, key, columns) dealt to pairs of blocks (i, j), sorted: a row goes to each pair with its own block."""
    block = F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    dealt = rows.withColumn("block", block).withColumn("other", other)
    dealt = dealt.select(group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", key, *columns)
    return dealt.repartition(common.shuffle_partitions(rows.sparkSession), group, "i", "j").sortWithinPartitions(group, "i", "j", "block", key)


def _places(table: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(rows with another key than the row before, their blocks, i, j)"""
    keys, block = table.column(key).to_numpy(), table.column("block").to_numpy()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return first, block[first], table.column("i")[0].as_py(), table.column("j")[0].as_py()


def candidate_groups(classes: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """(id, root) of the sets tied by pairs that share a bucket and survive the pruning, from a written table (key, size, signature)."""

    def hashed(batch: pa.RecordBatch) -> np.ndarray:
        return band_hashes(_signatures(batch.column("signature")), bands, rows)

    def one_each(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        if len(batch):
            h = hashed(batch).reshape(-1)
            yield h, np.ones(len(h), np.int64)

    def several(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys[n > 1]), pa.array(n[n > 1])], ["key", "n"])

    signed = classes.select("key", "signature")
    buckets = packed.shuffle(signed, one_each, _counted, several, (np.int64, np.int64), "key long, n long")
    buckets = common.written(buckets.withColumn("blocks", F.ceil(F.col("n") / BLOCK_SETS)), "near-buckets")

    def members(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        if len(batch):
            yield hashed(batch).reshape(-1), np.repeat(batch.column("key").to_numpy(), bands), np.tile(np.arange(bands, dtype=np.int16), len(batch))

    found = packed.look_up(signed, members, (np.int64, np.int64, np.int16), ["bucket", "id", "band"], buckets, (np.int64,), "bucket long, id long, band short, blocks long")
    found = common.written(found, "near-candidates").join(classes.select(F.col("key").alias("id_"), "size", "signature"), F.col("id") == F.col("id_"))

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, i, j, block, band, key, size = (t.column(c).to_numpy() for c in ("bucket", "i", "j", "block", "band", "id", "size"))
        sig = _signatures(t.column("signature"))
        hashes = band_hashes(sig, bands, rows)
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(key)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # many small groups at once, large ones one by one
        for n in np.unique(count[(count > 1) & (count <= SMALL)]):
            x, y = np.triu_indices(n, 1)
            s = start[count == n]
            step = max(1, PAIRS // len(x))
            for k in range(0, len(s), step):
                p, q = (np.add.outer(s[k : k + step], z).reshape(-1) for z in (x, y))
                ok = ((i[p] == j[p]) | (block[p] != block[q])) & _sizes_fit(size[p], size[q], threshold)
                p, q = p[ok], q[ok]
                ok = (hashes[p] == hashes[q]).argmax(1) == band[p]  # pairs that share several buckets are compared in the first
                p, q = p[ok], q[ok]
                e = np.zeros(len(p), np.int64)
                for at in range(0, sig.shape[1], STEP):
                    e += (sig[p, at : at + STEP] == sig[q, at : at + STEP]).sum(1)
                    ok = e >= least_matches(min(at + STEP, sig.shape[1]), threshold, TOLERANCE)
                    p, q, e = p[ok], q[ok], e[ok]
                a.append(p)
                b.append(q)
        for s, n in zip(start[count > SMALL], count[count > SMALL], strict=True):
            own = slice(s, s + n)
            x, y = (np.arange(s, s + n),) * 2 if i[s] == j[s] else (s + np.flatnonzero(block[own] == i[s]), s + np.flatnonzero(block[own] == j[s]))
            p, q = pruned_pairs(sig[x], size[x], sig[y], size[y], threshold, i[s] == j[s], [(h[x], h[y]) for h in hashes.T[: band[s]]])
            a.append(x[p])
            b.append(y[q])
        p, q = np.concatenate(a), np.concatenate(b)
        if len(p):
            node, root = forest(key[p], key[q])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

    pairs = _block_pairs(found, "bucket", "id", "band", "size", "signature")
    return components(common.map_arrow(pairs, _by_groups(("bucket", "i", "j"), compare), "a long, b long"))


def with_blocks(groups: DataFrame, size: str) -> DataFrame:
    """Adds blocks, the number of blocks of the row's group, to rows (key, root, <size>: values in the set)."""
    n = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n_"), F.sum(size).alias("v_"))
    n = n.select(F.col("root").alias("root_"), F.greatest(F.ceil(F.col("n_") / BLOCK_SETS), F.ceil(8 * F.col("v_") / BLOCK_BYTES)).cast("int").alias("blocks"))
    return groups.join(common.written(n, "near-blocks"), F.col("root") == F.col("root_")).drop("root_")


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """(key, links, root) from rows (root, blocks, key, copies, signature, items): links to other keys, weighed by their copies, and edges of a spanning forest.

    A key has a row for each block pair in which it has links.
    """

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        first, block, i, j = _places(t, "key")
        if len(first) < 2:
            return None
        key, copies, sig = t.column("key").to_numpy()[first], t.column("copies").to_numpy()[first], _signatures(t.column("signature").take(pa.array(first)))
        sets = [np.frombuffer(t.column("items")[int(k)].as_buffer(), U) for k in first]
        if i == j:
            p, q = similar_pairs(sig, sets, sig, sets, threshold, True)
        else:
            a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(a) or not len(b):
                return None
            p, q = similar_pairs(sig[a], [sets[x] for x in a], sig[b], [sets[x] for x in b], threshold, False)
            p, q = a[p], b[q]
        if not len(p):
            return None
        links = np.zeros(len(key), np.int64)
        np.add.at(links, p, copies[q])
        np.add.at(links, q, copies[p])
        node, root = forest(key[p], key[q])
        at = np.flatnonzero(links)  # keys are sorted within a block only
        order = at[np.argsort(key[at])]
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links[order]), pa.array(root)], ["key", "links", "root"])

    rows = _block_pairs(members, "root", "key", "copies", "signature", "items")
    return common.map_arrow(rows, _by_group(("root", "i", "j"), compare), "key long, links long, root long")
