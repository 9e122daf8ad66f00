"""Token counts through a digest cache.

Content is keyed by the SHA-256 of its normalised form (null becomes the empty text; nothing that could change a count
is altered) and by the SHA-256 of the tokenizer's file. Stored counts are joined to the documents' digests; only distinct
contents without a stored count are encoded, and their counts are appended to the cache.

Texts cross the network once, as misses, after each task has dropped the copies it has seen itself: a text that a third of
all rows hold arrives at its partition once per task. The joins carry digests only.

Defined results: null and empty text have 0 bytes and 0 tokens; repeated rows and ids each keep their row; other columns
are ignored; an empty table gives an empty result. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
_encoders: dict[str, object] = {}


def _counter(kind: str, model: bytes, version: str):
    """The counting function of a tokenizer, built once in each worker."""
    if version not in _encoders:
        if kind == "model":
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_proto=model)
            _encoders[version] = lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(model.decode())
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _encoders[version] = lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return _encoders[version]


def _slices(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


class TokenCache:
    """Counts kept by content digest and tokenizer digest, as a Parquet table that is only appended to."""

    def __init__(self, spark: SparkSession, path: str, tokenizer_path: str):
        model = Path(tokenizer_path).read_bytes()
        self.spark, self.path, self.model = spark, path, model
        self.kind = "model" if str(tokenizer_path).endswith(".model") else "json"
        self.version = hashlib.sha256(model).hexdigest()

    def stored(self) -> DataFrame:
        """digest, n_tokens for this tokenizer's version; a version's rows are found by partition."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        exists = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        if not exists:
            return self.spark.createDataFrame([], "digest binary, n_tokens long")
        table = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path)
        return table.filter(F.col("tokenizer") == self.version).select("digest", "n_tokens")

    def append_misses(self, contents: DataFrame) -> None:
        """Encode the distinct contents (digest, text) that have no stored count, and append their counts."""
        kind, model, version = self.kind, self.model, self.version

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for batch in batches:
                new = []
                for i, d in enumerate(batch.column("digest").to_pylist()):
                    if d not in seen:
                        seen.add(d)
                        new.append(i)
                yield batch.take(pa.array(new, pa.int64()))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = _counter(kind, model, version)
            for batch in once(batches):
                counts = [n for part in _slices(batch.column("text").to_pylist()) for n in count(part)]
                yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

        distinct = common.map_arrow(contents, once, "digest binary, text string")
        misses = distinct.join(self.stored(), "digest", "left_anti")
        counts = common.map_arrow(misses.repartition(common.shuffle_partitions(self.spark), "digest"), encode, "digest binary, n_tokens long")
        counts.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(self.path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit). cache_path: a cache to use and extend; by default a fresh one."""
    spark = docs.sparkSession
    cache = TokenCache(spark, cache_path or common.work_path(spark, "token-cache"), tokenizer_path)
    content = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    cache.append_misses(docs.select(digest.alias("digest"), content.alias("text")))
    keys = docs.select(docs[f"`{id_col}`"].alias(id_col), digest.alias("digest"), F.octet_length(content).cast("long").alias("n_bytes"))
    # appends of two jobs at once may store a content twice, with the same count. Written, so that both sides of the join are plain shuffles, which AQE splits where many rows hold one content
    stored = common.written(cache.stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return keys.join(stored, "digest", "left").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE_SQL: dict[str, str] = {}
