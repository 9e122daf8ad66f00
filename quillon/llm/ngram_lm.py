"""Interpolated modified Kneser-Ney word n-gram model, counted in Spark and scored from memory-mapped sorted hash arrays. Its order is a parameter (2 or more).

Tasks turn texts into n-grams (context words, word), add up equal ones, and send them packed by shard. A shard's task merges them, writes its sorted n-gram hashes and counts to the shared folder, and sends on,
again packed: what it knows of each context (total and how many followers occur once, twice, more often), and the n-grams without their first word, whose counts at the next lower order are the numbers of words before
them (and, beside, their occurrences). At order 2 what is left are words: count and number of distinct contexts. These and the contexts are added up and written by shards of their own. A context's n-grams are
spread over SPREAD shards, or a 32nd of all if that is more, so however many shards there are, the commonest word's aren't much larger than others; counts are added up before they are sent, so copies of a text weigh little.

Texts begin with order - 1 begin marks. Discounts come from the counts of counts of each order. The lowest order interpolates continuation counts with the uniform chance 1 / (V + 1), so all words and one unknown word sum to 1.

Scoring maps the files into each worker's memory (pages are shared by the workers of a machine) and looks up sorted batches of hashes by binary search. Files are written under
another name and renamed, so a repeated task leaves the same files. The shared folder must be a POSIX path on all machines.

Defined results: null or empty text is its end token alone; repeated rows count and score each; without training text every chance is that of the uniform model over one unknown
word (score 0); words are compared by 64-bit hash; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common
from quillon.llm.packed import n_shards, pack, unpack
from quillon.llm.words import U, Block, blocks, mix

BEGIN, END = U(0x51ED270B13C7F0AD), U(0xA3C59AC2F1D40E67)
ORDER = 2
SPREAD = 8
FLUSH_TOKENS = 2_000_000
SHARD_BYTES = 16 << 20
WORD_STATS = np.dtype([("total", "u8"), ("n1", "u4"), ("n2", "u4"), ("n3", "u4"), ("contexts", "u4"), ("count", "u8")])
CONTEXT_STATS = np.dtype([("total", "u8"), ("n1", "u4"), ("n2", "u4"), ("n3", "u4")])
#: Kinds of packed rows: contexts, n-grams or words, and from here on counts of counts by order.
CONTEXTS, GRAMS, FIGURES = 0, 1, 10


def grams(block: Block, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(context words, the oldest first, token, first token of each text): each text's words and its end, after the order - 1 words or begin marks before."""
    h, first = block.hashes, block.first
    starts = first[:-1] + np.arange(len(first) - 1)
    before = [np.insert(h, first[:-1], BEGIN)]
    for _ in range(order - 2):
        older = np.roll(before[0], 1)
        older[starts] = BEGIN
        before.insert(0, older)
    return before, np.insert(h, first[1:], END), starts


def pair_keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(context * U(0xD1342543DE82EF95) + (token ^ (token >> U(29))))


def context_key(words: list[np.ndarray]) -> np.ndarray:
    """A single word is its own key."""
    return reduce(pair_keys, words)


def pair_shards(context: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    return ((context >> U(33)) + (token % U(max(SPREAD, n // 32))) * U(0x9E3779B1)) % U(n)


def word_shards(word: np.ndarray, n: int) -> np.ndarray:
    """By range, so that shards in order hold all words in order."""
    return ((word >> U(32)) * U(n)) >> U(32)


def _blobs(table: pa.Table, kind: int) -> list[memoryview]:
    return [memoryview(b.as_buffer()) for k, b in zip(table.column("kind").to_pylist(), table.column("blob"), strict=True) if k == kind]


def _joined(parts: list, k: int, t=np.int64) -> np.ndarray:
    return np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys and each value's sums; without values, their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    if not values:
        return keys[starts], np.diff(np.append(starts, len(keys)))
    return keys[starts], *(np.add.reduceat(v[order], starts) if len(keys) else v for v in values)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{name}-{os.getpid()}-{os.urandom(4).hex()}.npy"
    np.save(own, array)
    os.replace(own, f"{folder}/{name}.npy")


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.array([int((counts == k).sum()) for k in (1, 2, 3, 4)], np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """D(0..3+) of modified Kneser-Ney from the numbers of counts 1 to 4; where these say nothing, absolute discounting by a half."""
    n1, n2, n3, n4 = (float(x) for x in n)
    out = np.array([0.0, 0.5, 0.5, 0.5])
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        out[1] = 1 - 2 * y * n2 / n1
        out[2] = 2 - 3 * y * n3 / n2 if n3 else out[1]
        out[3] = 3 - 4 * y * n4 / n3 if n3 and n4 else out[2]
    return np.clip(out, 0, [0, 1, 2, 3])


@dataclass(frozen=True)
class NgramModel:
    """Where the files are, how many, and the corpus-wide figures; gram_discounts: of the orders from 2 on."""

    folder: str
    order: int
    n_shards: int
    n_words: int
    tokens: int
    vocabulary: int
    gram_discounts: tuple[tuple[float, ...], ...]
    word_discounts: tuple[float, ...]
    continuations: int
    word_left: float


@lru_cache(maxsize=4096)
def _mapped(path: str) -> np.ndarray | None:
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


def _find(folder: str, kind: str, value: str, shard: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(which queries are there, their rows)."""
    keys = _mapped(f"{folder}/{kind}-{shard}.npy")
    if keys is None or not len(keys):
        return None
    at = np.searchsorted(keys, queries)
    at[at == len(keys)] = 0
    there = keys[at] == queries
    return there, np.asarray(_mapped(f"{folder}/{value}-{shard}.npy")[at[there]])


class Scorer:
    def __init__(self, model: NgramModel):
        self.m = model

    def stats(self, kind: str, value: str, type_: np.dtype, distinct: np.ndarray) -> np.ndarray:
        """The rows of sorted words or contexts; zeros for unknown ones."""
        out = np.zeros(len(distinct), type_)
        shard = word_shards(distinct, self.m.n_words).astype(np.int64)
        cuts = np.searchsorted(shard, np.arange(self.m.n_words + 1))
        for s in np.unique(shard):
            a, b = cuts[s], cuts[s + 1]
            if (found := _find(self.m.folder, kind, value, s, distinct[a:b])) is not None:
                out[a:b][found[0]] = found[1]
        return out

    def gram_counts(self, order: int, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        keys, shard = pair_keys(context, token), pair_shards(context, token, self.m.n_shards).astype(np.int64)
        by = np.argsort((shard.astype(U) << U(44)) | (keys >> U(20)), kind="stable")
        out, cuts = np.zeros(len(keys), np.int64), np.searchsorted(shard[by], np.arange(self.m.n_shards + 1))
        for s in np.unique(shard):
            own = by[cuts[s] : cuts[s + 1]]
            if (found := _find(self.m.folder, f"grams{order}", f"counts{order}", s, keys[own])) is not None:
                out[own[found[0]]] = found[1]
        return out

    def score(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, known tokens, base score, model score."""
        m = self.m
        before, token, first = grams(block, m.order)
        distinct, place = np.unique(np.concatenate([token, before[-1]]), return_inverse=True)
        stats = self.stats("words", "stats", WORD_STATS, distinct)
        t, c = stats[place[: len(token)]], stats[place[len(token) :]]
        p = np.maximum(t["contexts"] - np.take(m.word_discounts, np.minimum(t["contexts"], 3)), 0) / max(m.continuations, 1) + m.word_left / (m.vocabulary + 1)
        for order, d in enumerate(m.gram_discounts, 2):
            context = context_key(before[1 - order :])
            if order > 2:
                distinct, place = np.unique(context, return_inverse=True)
                c = self.stats(f"contexts{order}", f"context-stats{order}", CONTEXT_STATS, distinct)[place]
            n = self.gram_counts(order, context, token) if m.tokens else np.zeros(len(token), np.int64)
            total = np.maximum(c["total"], 1).astype(float)
            left = np.where(c["total"] > 0, (d[1] * c["n1"] + d[2] * c["n2"] + d[3] * c["n3"]) / total, 1.0)
            p = np.maximum(n - np.take(d, np.minimum(n, 3)), 0) / total + left * p
        base = np.log10((t["count"] + 1.0) / (m.tokens + m.vocabulary + 1.0))
        lengths = np.diff(np.append(first, len(token)))
        return lengths, np.add.reduceat((t["count"] > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)


def train(texts: DataFrame, folder: str, order: int = ORDER) -> NgramModel:
    """texts: one column ``text``. Writes the model's files to ``folder``."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    path = common.posix_path(folder)
    n = n_shards(texts, SHARD_BYTES)
    n_words = max(1, n // 2)
    schema = "shard int, kind int, blob binary"
    i8, u4 = np.int64, np.uint32

    def rows(shards, kinds, blobs) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "kind", "blob"])

    def packed(before: list[np.ndarray], token: np.ndarray, *values: np.ndarray) -> tuple[list, list, list]:
        """Distinct n-grams by shard, a context's words once for its n-grams."""
        context = context_key(before)
        shard = pair_shards(context, token, n)
        by = np.argsort((shard << U(44)) | (context >> U(20)), kind="stable")
        before, token, context, shard = [w[by] for w in before], token[by], context[by], shard[by].astype(i8)
        values = [v[by].astype(u4) if not len(v) or v.max() < 1 << 32 else v[by] for v in values]
        present = np.unique(shard)
        cuts = np.append(np.searchsorted(shard, present), len(shard))
        blobs = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            c = context[a:b]
            starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            wide = [np.array([v.itemsize for v in values], i8)]
            blobs.append(pack(*wide, *(w[a:b][starts] for w in before), np.diff(np.append(starts, b - a)).astype(u4), token[a:b], *(v[a:b] for v in values)))
        return present.tolist(), [GRAMS] * len(present), blobs

    def unpacked(blob: memoryview, level: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
        n_values = 1 if level == order else 2
        wide = np.frombuffer(blob, i8, n_values, 8 * (1 + int(np.frombuffer(blob, i8, 1)[0])))
        _, *columns = unpack(blob, i8, *[U] * (level - 1), u4, U, *(np.dtype(f"u{w}") for w in wide))
        runs = columns[level - 1]
        return [np.repeat(w, runs) for w in columns[: level - 1]], columns[level], [v.astype(i8) for v in columns[level + 1 :]]

    def counted(before: list[np.ndarray], token: np.ndarray) -> pa.RecordBatch:
        _, at, counts = np.unique(pair_keys(context_key(before), token), return_index=True, return_counts=True)
        return rows(*packed([w[at] for w in before], token[at], counts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_ = [], 0
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                before, t, _ = grams(block, order)
                held.append((*before, t))
                size_ += len(t)
                if size_ >= FLUSH_TOKENS:
                    *before, t = map(np.concatenate, zip(*held, strict=True))
                    held, size_ = [], 0
                    yield counted(before, t)
        if held:
            *before, t = map(np.concatenate, zip(*held, strict=True))
            yield counted(before, t)

    def by_range(kind: int, keys: np.ndarray, values: list[np.ndarray], offset: int) -> tuple[list, list, list]:
        """Sorted keys and their values, by shard."""
        own = word_shards(keys, n_words).astype(i8)
        present = np.unique(own)
        cuts = [np.searchsorted(own, [s, s + 1]) for s in present]
        return (present + offset).tolist(), [kind] * len(present), [pack(keys[a:b], *(v[a:b] for v in values)) for a, b in cuts]

    def merge_grams(table: pa.Table, level: int, shard: int) -> list[tuple[list, list, list]]:
        parts = [unpacked(b, level) for b in _blobs(table, GRAMS)]
        before = [np.concatenate([p[0][k] for p in parts]) for k in range(level - 1)]
        token = np.concatenate([p[1] for p in parts])
        values = [np.concatenate(v) for v in zip(*(p[2] for p in parts), strict=True)]
        del parts
        keys = pair_keys(context_key(before), token)
        by = np.argsort(keys, kind="stable")
        keys = keys[by]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, at = keys[starts], by[starts]
        values = [np.add.reduceat(v[by], starts) for v in values]
        before, token, counts, occurs = [w[at] for w in before], token[at], values[0], values[-1]
        _save(path, f"grams{level}-{shard}", keys)
        _save(path, f"counts{level}-{shard}", counts.astype(u4) if counts.max() < 1 << 32 else counts)
        ks, *vs = _sum_by(context_key(before), counts, *((counts == k).astype(i8) for k in (1, 2)), (counts > 2).astype(i8))
        out = [([0], [FIGURES + level], [pack(_counts_of_counts(counts))]), by_range(CONTEXTS, ks, vs, 0 if level == 2 else n)]
        if level == 2:
            ks, *vs = _sum_by(token, np.ones(len(token), i8), occurs)
            return [*out, by_range(GRAMS, ks, vs, 0)]
        # the same n-grams without their first word, each counted once for each such word
        lower = pair_keys(context_key(before[1:]), token)
        _, first = np.unique(lower, return_index=True)
        _, *vs = _sum_by(lower, np.ones(len(token), i8), occurs)
        return [*out, packed([w[first] for w in before[1:]], token[first], *vs)]

    def merge_contexts(table: pa.Table, level: int, shard: int) -> None:
        parts = [unpack(b, U, i8, i8, i8, i8) for b in _blobs(table, CONTEXTS)]
        keys, *values = _sum_by(_joined(parts, 0, U), *(_joined(parts, k) for k in (1, 2, 3, 4)))
        stats = np.zeros(len(keys), CONTEXT_STATS)
        for name, v in zip(CONTEXT_STATS.names, values, strict=True):
            stats[name] = v
        _save(path, f"contexts{level}-{shard}", keys)
        _save(path, f"context-stats{level}-{shard}", stats)

    def merge(level: int):
        """Shards below n hold n-grams of this level (and shard 0 figures), the others contexts of the level above."""

        def run(table: pa.Table) -> pa.Table:
            shard, kinds = table.column("shard")[0].as_py(), set(table.column("kind").to_pylist())
            if CONTEXTS in kinds:
                merge_contexts(table, level + 1, shard - n)
            out = merge_grams(table, level, shard) if GRAMS in kinds else []
            batches = [rows(*o) for o in out]
            empty = rows([], [], [])
            figures = table.filter(pc.greater_equal(table.column("kind"), FIGURES)).select(empty.schema.names).cast(empty.schema)
            return pa.Table.from_batches([*batches, *figures.to_batches()], empty.schema)

        return run

    def merge_words(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        contexts = [unpack(b, U, i8, i8, i8, i8) for b in _blobs(table, CONTEXTS)]
        tokens = [unpack(b, U, i8, i8) for b in _blobs(table, GRAMS)]
        gram_counts = [sum((unpack(b, i8)[0] for b in _blobs(table, FIGURES + level)), np.zeros(4, i8)) for level in range(2, order + 1)]
        cw, *cv = _sum_by(_joined(contexts, 0, U), *(_joined(contexts, k) for k in (1, 2, 3, 4)))
        tw, *tv = _sum_by(_joined(tokens, 0, U), *(_joined(tokens, k) for k in (1, 2)))
        words = np.union1d(cw, tw)
        stats = np.zeros(len(words), WORD_STATS)
        at = np.searchsorted(words, cw)
        for name, v in zip(("total", "n1", "n2", "n3"), cv, strict=True):
            stats[name][at] = v
        at = np.searchsorted(words, tw)
        for name, v in zip(("contexts", "count"), tv, strict=True):
            stats[name][at] = v
        _save(path, f"words-{shard}", words)
        _save(path, f"stats-{shard}", stats)
        several = stats["contexts"][stats["contexts"] > 0].astype(i8)
        figures = [stats["count"].sum(), len(several), several.sum(), *_counts_of_counts(several), (several > 2).sum(), *np.concatenate(gram_counts)]
        return pa.table({f"x{k}": pa.array([int(v)], pa.int64()) for k, v in enumerate(figures)})

    sent = common.map_arrow(texts.select("text"), count, schema).repartitionById(n, "shard")
    for level in range(order, 1, -1):
        sent = common.apply_arrow(sent, "shard", merge(level), schema).repartitionById(n_words if level == 2 else n + n_words, "shard")
    n_figures = 8 + 4 * (order - 1)
    figures = common.apply_arrow(sent, "shard", merge_words, ", ".join(f"x{k} long" for k in range(n_figures)))
    r = figures.agg(*[F.coalesce(F.sum(f"x{k}"), F.lit(0)).alias(f"x{k}") for k in range(n_figures)]).first()
    tokens, vocabulary, continuations = r["x0"], r["x1"], r["x2"]
    word_n = [r[f"x{k}"] for k in range(3, 7)]
    gram_n = [[r[f"x{8 + 4 * g + k}"] for k in range(4)] for g in range(order - 1)]
    wd = discounts(np.array(word_n))
    left = (wd[1] * word_n[0] + wd[2] * word_n[1] + wd[3] * r["x7"]) / continuations if continuations else 1.0
    return NgramModel(path, order, n, n_words, tokens, vocabulary, tuple(tuple(discounts(np.array(g))) for g in gram_n), tuple(wd), continuations, float(left))


def score(docs: DataFrame, model: NgramModel, *keep: Column, text_col: str = "text") -> DataFrame:
    """The kept columns, n_tokens, n_known, train_tokens, base_score, score and perplexity of every whole text."""
    kept = docs.select(*keep, docs[f"`{text_col}`"].alias("text__"))
    names = [f.name for f in kept.schema if f.name != "text__"]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema if f.name != "text__")
    more = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            parts = [scorer.score(b) for b in blocks(batch.column("text__"), lower=True)]
            if not parts:
                continue
            n, known, base, own = map(np.concatenate, zip(*parts, strict=True))
            out = [n.astype(np.int64), known.astype(np.int64), np.full(len(n), model.tokens, np.int64), base, own, 10 ** np.minimum(-own / n, 300)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *map(pa.array, out)], [*names, *more])

    return common.map_arrow(kept, run, f"{ddl}n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.needs(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    out = held_out(F.col("doc_id"))
    model = train(docs.filter(~out).select("text"), common.work_path(spark, "ngram-model"))
    return score(docs, model, F.col("doc_id"), out.alias("held_out"))


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
