"""N-gram Jaccard join of documents, with Bayesian candidate pruning.

Words are compared as they are, in windows of five (a text of one to four words is one window). Documents with equal window sets form a class of copies: only one of them is
compared, and a class's copies count as links of each other. Window sets are compared by 64-bit hashes, classes told apart by a 64-bit digest of the set.

Texts are read twice: for signatures, then, joined by digest to the candidates, for the whole sets of those alone.

Defined results: null, empty and blank texts have no window: they link to nothing and are their own class; repeated rows are copies; rows with a null id are
compared like others (class id null if all of the class are null); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common
from quillon.llm import near_sets as N
from quillon.llm.components import components
from quillon.llm.words import blocks, shingles

WIDTH = 5
THRESHOLD = 0.8
ROWS = 5
RECALL = 0.99999


def _signed(batch: pa.RecordBatch, n_hashes: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some texts at a time: (rows that have windows, set digests, values, starts, signatures)."""
    for block in blocks(batch.column("text")):
        values, owners, starts, digest = N.distinct_sets(*shingles(block, width))
        yield block.rows[owners], digest.view(np.int64), values, starts, N.minhash(values, starts, n_hashes)


def _binary(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values that are the bytes between the cuts (in items) of a contiguous array."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, rows: int = ROWS, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", by_row: bool = False) -> DataFrame:
    """Per row: id, class_id (the least id of its component of links), n_links (other rows with Jaccard >= threshold). by_row: also row_id (``common.row_id``) and class_row, the row
    of the class's least id; where several rows have it, the least row_id of them."""
    bands = N.tune(threshold, recall, rows)
    n_hashes = bands * rows
    text = docs[f"`{text_col}`"]
    texts = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"), common.row_id(docs, id_col, text_col).alias("row"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            key, size, sig = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, n_hashes), np.uint32)
            for at, digest, values, starts, signatures in _signed(batch, n_hashes, width):
                key[at], size[at], sig[at] = digest, np.diff(np.append(starts, len(values))), signatures
            signature = _binary(sig.reshape(-1), np.arange(n + 1) * n_hashes)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "digest", "row")), pa.array(key), pa.array(size), signature], ["id", "digest", "row", "key", "size", "signature"])

    signed = common.written(common.map_arrow(texts, sign, "id long, digest long, row long, key long, size long, signature binary"), "near-signed")
    # nulls come last: a class has a null id if it has no other
    first = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = signed.filter("size > 0").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(first).alias("rep"), F.first("size").alias("size"), F.first("signature").alias("signature"), F.min("digest").alias("digest"))
    classes = common.written(classes, "near-classes")
    groups = N.candidate_groups(classes, threshold, bands, rows)
    wanted = classes.select("key", "copies", "digest", "size").join(groups.withColumnRenamed("id", "key"), "key")
    wanted = common.written(N.with_blocks(common.written(wanted, "near-grouped"), "size").drop("size"), "near-wanted")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["root", "blocks", "key", "copies"]
        sent: set[int] = set()
        for batch in batches:
            fresh = [k for k, x in enumerate(batch.column("key").to_pylist()) if x not in sent and not sent.add(x)]
            batch = batch.take(pa.array(fresh, pa.int64()))
            for at, _, values, starts, signatures in _signed(batch, n_hashes, width):
                kept = batch.select(names).take(pa.array(at))
                items, signature = _binary(values, np.append(starts, len(values))), _binary(signatures.reshape(-1), np.arange(len(at) + 1) * n_hashes)
                yield pa.RecordBatch.from_arrays([*kept.columns, signature, items], [*names, "signature", "items"])

    # the same text in many rows is taken once by each task; the join is the same at every size
    chosen = texts.select("digest", "text").join(wanted.withColumnRenamed("digest", "digest_").hint("merge"), F.col("digest") == F.col("digest_")).select("root", "blocks", "key", "copies", "text")
    members = common.map_arrow(chosen, gather, "root long, blocks int, key long, copies long, signature binary, items binary")
    found = common.written(N.verify(members, threshold), "near-links")
    linked = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")).distinct()).select(F.col("id").alias("key"), "root")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = common.written(classes.select("key", "copies", "rep").join(linked, "key").join(links, "key", "left"), "near-known")
    least = common.written(known.groupBy("root").agg(F.min("rep").alias("least")), "near-least")
    known = known.join(least, "root").select("key", "least", "links")
    state = classes.select("key", "copies", "rep").join(known, "key", "left")
    state = state.select("key", F.coalesce("least", "rep").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # most classes are one document without links and need no look-up
    state = common.written(state.filter("n_links > 0"), "near-state").withColumnRenamed("key", "key_")
    out = signed.select("id", "row", "key", "size").join(state, (F.col("key") == F.col("key_")) & (F.col("size") > 0), "left")
    linked = F.col("n_links") > 0
    more = [F.col("row").alias("row_id"), F.when(linked, F.col("least.row")).otherwise(F.col("row")).alias("class_row")] if by_row else []
    return out.select(F.col("id").alias(id_col), F.when(linked, F.col("least.id")).otherwise(F.col("id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *more)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


QUERIES = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
