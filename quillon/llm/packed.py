"""A shuffle of numpy columns: tasks combine their rows, cut them by shard, and send each shard's part as one binary value; a shard's task gets the columns back.

It costs a fraction of shuffling the rows one by one. Combining before sending bounds what a hot key sends to one row per task and flush; a join with a table of keys deals the rows of
its commonest keys to all shards.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common
from quillon.llm.words import U, mix

#: Rows a task holds before it sends; a worker needs some 200 bytes for each.
FLUSH_ROWS = 500_000
SHARD_BYTES = 8 << 20
UNKNOWN_BYTES = 1 << 53
#: Keys with over max(HOT_ROWS, all rows / HOT_KEYS) rows are hot, so there are HOT_KEYS at most.
HOT_KEYS = 100_000
HOT_ROWS = 2048


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: memoryview, *types) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(blob, np.int64, n, 8), 8 * (n + 1), []
    for size, t in zip(sizes, types, strict=True):
        out.append(np.frombuffer(blob, t, int(size), at))
        at += int(size) * np.dtype(t).itemsize
    return out


def n_shards(rows: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """At least the session's shuffle partitions; more for larger inputs, by the planner's estimate of their size, so that a shard stays small."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < UNKNOWN_BYTES  # the planner takes a source of unknown size for nearly 2**63 bytes
    return max(common.shuffle_partitions(rows.sparkSession), size // shard_bytes if known else 1)


def _sender(n: int, produce, combine, dealt=None):
    """The map side: (shard, blob) of the combined rows. dealt: true for the rows that go to any shard instead of their key's."""

    def parts(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        columns = combine(*columns)
        shard = columns[0].view(U) % U(n)
        if dealt is not None:
            any_ = dealt(columns[0])
            shard[any_] = mix(columns[0][any_].view(U) ^ mix(columns[1][any_].view(U))) % U(n)
        order = np.argsort(shard, kind="stable")
        shard, columns = shard[order].astype(np.int64), [c[order] for c in columns]
        present = np.unique(shard)
        cuts = np.append(np.searchsorted(shard, present), len(shard))
        blobs = [pack(*(c[a:b] for c in columns)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for columns in produce(batch):
                held.append(columns)
                size += len(columns[0])
                if size >= FLUSH_ROWS:
                    columns = tuple(map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
                    yield parts(columns)
        if size:
            yield parts(tuple(map(np.concatenate, zip(*held, strict=True))))

    return send


def shuffle(
    rows: DataFrame,
    produce: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]],
    combine: Callable[..., tuple[np.ndarray, ...]],
    reduce: Callable[..., pa.RecordBatch],
    types: tuple,
    schema: str,
) -> DataFrame:
    """produce: columns from a batch, the first one the key (int64). combine: fewer rows with the same meaning. reduce: a shard's result from all its combined columns."""
    n = n_shards(rows)

    def receive(table: pa.Table) -> pa.Table:
        blobs = [unpack(memoryview(b.as_buffer()), *types) for b in table.column("blob")]
        return pa.Table.from_batches([reduce(*combine(*map(np.concatenate, zip(*blobs, strict=True))))])

    sent = common.map_arrow(rows, _sender(n, produce, combine), "shard int, blob binary").repartitionById(n, "shard")
    return common.apply_arrow(sent, "shard", receive, schema)


def look_up(rows: DataFrame, produce: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]], types: tuple, names: list[str], known: DataFrame, known_types: tuple, schema: str) -> DataFrame:
    """The rows whose key is in ``known``, with its columns: an inner join.

    produce: the key and at least one more int64 column first, then others, of ``types`` and ``names``. known: a written table, one row per key: key, n (its rows), then columns of known_types.
    Rows of a key meet in one shard, but those of hot keys: these keys, HOT_KEYS at most, are told to all tasks, and their rows go to any shard.
    """
    n, spark = n_shards(rows), rows.sparkSession
    total = known.agg(F.sum("n")).first()[0] or 0
    more = known.columns[2:]
    least = max(HOT_ROWS, math.ceil(total / HOT_KEYS))
    hot = known.filter(F.col("n") > least).drop("n").toArrow().sort_by("key")
    told = spark.sparkContext.broadcast([hot.column(c).to_numpy() for c in hot.column_names])

    def is_hot(keys: np.ndarray) -> np.ndarray:
        at, listed = np.searchsorted(told.value[0], keys), told.value[0]
        at[at == len(listed)] = 0
        return listed[at] == keys if len(listed) else np.zeros(len(keys), bool)

    def listed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        yield tuple(batch.column(c).to_numpy() for c in ("key", *more))

    same = lambda *columns: columns
    kinds = (np.int64, *known_types)
    sent = common.map_arrow(rows, _sender(n, produce, same, is_hot), "shard int, blob binary").withColumn("kind", F.lit(0))
    other = common.map_arrow(known.filter(F.col("n") <= least).drop("n"), _sender(n, listed, same), "shard int, blob binary").withColumn("kind", F.lit(1))

    def receive(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        blobs = table.column("blob")
        mine = [[unpack(memoryview(blobs[int(k)].as_buffer()), *t) for k in np.flatnonzero(kind == which)] for which, t in ((0, types), (1, kinds))]
        row, key = [[np.concatenate([b[k] for b in part] or [np.zeros(0, t)]) for k, t in enumerate(ts)] for part, ts in zip(mine, (types, kinds), strict=True)]
        key = [np.concatenate([a, b.astype(a.dtype)]) for a, b in zip(key, told.value, strict=True)]
        order = np.argsort(key[0], kind="stable")
        key = [k[order] for k in key]
        at = np.searchsorted(key[0], row[0])
        at[at == len(key[0])] = 0
        found = np.flatnonzero(key[0][at] == row[0]) if len(key[0]) else np.zeros(0, np.int64)
        at = at[found]
        return pa.table([*(pa.array(c[found]) for c in row), *(pa.array(k[at]) for k in key[1:])], names=[*names, *more])

    return common.apply_arrow(sent.union(other).repartitionById(n, "shard"), "shard", receive, schema)
