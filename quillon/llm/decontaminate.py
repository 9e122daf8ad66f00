"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased (A-Z) and compared by hash. Seeds are an item's windows of SEED_WORDS words, or its words where a copy need not hold such a window. ``least_seeds`` is the number of an item's seeds that every passage
of the asked similarity holds, whatever its edits. Seeds are counted over all documents: an item keeps those that occur, but for its most frequent ones, of which so many go that every such passage still holds one to FEW_SEEDS others.
Where a document holds that many close to one diagonal, the words around them are aligned with the whole item: match 1, mismatch and gap -0.5, local. The score divided by the item's length is the
similarity; a copy with a quarter of its words changed still scores above 0.6. So what is found is what aligning every document with every item would find.

Items are broadcast in blocks, bounded by their number and bytes; PASS_BLOCKS blocks share one pass over the documents for the counts and one for the alignment, larger benchmarks take more passes. Nothing
is shuffled but the seeds' counts.

Items of fewer than LEAST_WORDS words would match every text that uses these words; they are left out, and ``left_out`` lists them.

Defined results: null or blank items and texts match nothing; repeated items and documents each give their rows; null ids are carried; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common
from quillon.llm.words import U, blocks, runs_hash

SEED_WORDS = 2
FEW_SEEDS = 4
SIMILARITY = 0.6
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
PASS_BLOCKS = 4
MISMATCH = GAP = 0.5
LEAST_WORDS = 5


def least_seeds(length: int, similarity: float) -> tuple[int, int]:
    """(seed words, seeds that any alignment of that similarity holds). With m equal words and e edits the score is m - e / 2, and the equal words form at most e + 1 runs, so m - e - 1 pairs of them are neighbours."""
    need = similarity * length
    least = max(1, int(np.ceil(need - 1e-9)))
    pairs = min((m - 1 - min(m - 1, int(2 * (m - need) + 1e-9)) for m in range(least, length + 1)), default=0)
    return (SEED_WORDS, pairs) if pairs > 0 else (1, least)


class Items:
    """A block of benchmark items: word hashes, and seeds (hash, item, place) sorted by hash."""

    def __init__(self, ids: list[int | None], texts: pa.Array, similarity: float = SIMILARITY):
        self.ids, self.words = ids, []
        for block in blocks(texts, lower=True):
            self.words += [block.hashes[a:b] for a, b in zip(block.first[:-1], block.first[1:], strict=True)]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        #: No alignment of that similarity has more gaps.
        self.slack = (2 * (1 - similarity) * self.lengths + 1e-9).astype(np.int64)
        widths, self.need = (np.array(x, np.int64) for x in zip(*[least_seeds(len(w), similarity) for w in self.words], strict=True)) if self.words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        h, item, place = [], [], []
        for k, w in enumerate(self.words):
            if len(w):
                width = int(widths[k])
                s = np.arange(len(w) - width + 1)
                h.append(runs_hash(w, s, s + width))
                item.append(np.full(len(s), k))
                place.append(s)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        h, item, place = join(h, U), join(item, np.int64), join(place, np.int64)
        order = np.argsort(h, kind="stable")
        self.seeds, self.item, self.place = h[order], item[order], place[order]
        self.widths = sorted(set(widths[self.lengths > 0].tolist()))

    def keep_rare(self, counts: dict[int, int]) -> None:
        n = np.array([counts.get(int(s), 0) for s in self.seeds.view(np.int64)], np.int64)
        order = np.lexsort((self.place, -n, self.item))
        new = np.append(True, np.diff(self.item[order]) != 0)[: len(order)]
        rank = np.zeros(len(n), np.int64)
        rank[order] = np.arange(len(n)) - np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))
        left = np.minimum(self.need, FEW_SEEDS)
        keep = (n > 0) & (rank >= (self.need - left)[self.item])
        self.need = left
        self.seeds, self.item, self.place = self.seeds[keep], self.item[keep], self.place[keep]

    def hits(self, block) -> tuple[np.ndarray, np.ndarray]:
        """(place in the block's words, seed hash) of all windows that are some seed's."""
        n = len(block.hashes)
        text = np.searchsorted(block.first, np.arange(n), "right") - 1
        left = block.first[text + 1] - np.arange(n)
        at, found = [], []
        for width in self.widths:
            s = np.flatnonzero(left >= width)
            h = runs_hash(block.hashes, s, s + width)
            k = np.searchsorted(self.seeds, h)
            k[k == len(self.seeds)] = 0
            ok = self.seeds[k] == h if len(self.seeds) else np.zeros(len(h), bool)
            at.append(s[ok])
            found.append(h[ok])
        return (np.concatenate(at), np.concatenate(found)) if at else (np.zeros(0, np.int64), np.zeros(0, U))


def align(items: np.ndarray, lengths: np.ndarray, windows: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Smith-Waterman scores of many (item, window) pairs at once; rows are padded, with their lengths given."""
    n, width = windows.shape
    inside = np.arange(width)[None, :] < spans[:, None]
    ramp = GAP * np.arange(width)[None, :]
    above, best = np.zeros((n, width)), np.zeros(n)
    for i in range(items.shape[1]):
        real = i < lengths
        diagonal = np.zeros((n, width))
        diagonal[:, 1:] = above[:, :-1]
        now = np.maximum(diagonal + np.where((windows == items[:, i][:, None]) & inside, 1.0, -MISMATCH), np.maximum(above - GAP, 0))
        now = np.maximum.accumulate(now + ramp, 1) - ramp  # gaps along the window
        above = np.where(real[:, None], now, above)
        best = np.maximum(best, np.where(real, now.max(1), 0))
    return best


def _seed_counts(docs: DataFrame, shared: list) -> DataFrame:
    """(block, seed, n) of all blocks' seeds that occur, in one pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(s.value, np.unique(s.value.seeds)) for s in shared]
        totals = [np.zeros(len(distinct), np.int64) for _, distinct in own]
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                for (items, distinct), total in zip(own, totals, strict=True):
                    total += np.bincount(np.searchsorted(distinct, items.hits(block)[1]), minlength=len(distinct))[: len(distinct)]
        for k, ((_, distinct), total) in enumerate(zip(own, totals, strict=True)):
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k, np.int32)), pa.array(distinct[seen].view(np.int64)), pa.array(total[seen])], ["block", "seed", "n"])

    return common.map_arrow(docs.select("text"), count, "block int, seed long, n long").groupBy("block", "seed").agg(F.sum("n").alias("n"))


def _candidates(items: Items, block) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first word, word after) to align; near seeds of one diagonal band are one window."""
    at, seed = items.hits(block)
    if not len(at):
        return
    low, high = np.searchsorted(items.seeds, seed), np.searchsorted(items.seeds, seed, "right")
    n = high - low
    k = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(at, n)
    text, item, diagonal = np.searchsorted(block.first, at, "right") - 1, items.item[k], at - items.place[k]
    order = np.lexsort((diagonal, item, text))
    text, item, diagonal = text[order], item[order], diagonal[order]
    slack = items.slack[item]
    # a passage's seeds lie within slack diagonals; what has too few of them there is none
    pair = np.cumsum(np.append(False, (np.diff(text) != 0) | (np.diff(item) != 0)))
    line = pair * (diagonal.max() - diagonal.min() + slack.max() + 1) + diagonal - diagonal.min()
    after = np.searchsorted(line, line + slack, "right")
    enough = after - np.arange(len(line)) >= items.need[item]
    live = np.cumsum(np.bincount(np.flatnonzero(enough), minlength=len(line) + 1) - np.bincount(after[enough], minlength=len(line) + 1))[:-1] > 0
    if not live.any():
        return
    text, item, diagonal, slack, line = (x[live] for x in (text, item, diagonal, slack, line))
    length = items.lengths[item]
    new = np.append(True, np.diff(line) > slack[1:])
    new[1:] |= (np.diff(text) != 0) | (np.diff(item) != 0)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(text)) - 1
    first = np.maximum(diagonal[starts] - slack[starts], block.first[text[starts]])
    after = np.minimum(diagonal[ends] + length[starts] + slack[starts], block.first[text[starts] + 1])
    yield from zip(text[starts].tolist(), item[starts].tolist(), first.tolist(), after.tolist(), strict=True)


def _scores(items: Items, block, found: list[tuple[int, int, int, int]], cells: int = 1 << 18) -> Iterator[tuple[int, int, float, int, int]]:
    found = sorted(found, key=lambda c: (c[2] - c[3], -len(items.words[c[1]])))  # the longest first: they set a batch's width
    k = 0
    while k < len(found):
        part = found[k : k + max(1, min(128, cells // max(1, found[k][3] - found[k][2])))]
        k += len(part)
        lengths, spans = np.array([len(items.words[c[1]]) for c in part]), np.array([c[3] - c[2] for c in part])
        a, b = np.zeros((len(part), lengths.max()), U), np.zeros((len(part), spans.max()), U)
        for r, (_, i, s, e) in enumerate(part):
            a[r, : lengths[r]], b[r, : e - s] = items.words[i], block.hashes[s:e]
        for (t, i, s, e), score in zip(part, align(a, lengths, b, spans) / lengths, strict=True):
            yield t, i, float(score), s, e


def _hits(items: Items, texts: pa.Array, similarity: float) -> dict[tuple[int, int], list]:
    """(row, item) -> [best similarity, number of passages]"""
    best: dict[tuple[int, int], list] = {}
    for block in blocks(texts, lower=True):
        for t, i, score, _, _ in _scores(items, block, list(_candidates(items, block))):
            if score >= similarity:
                had = best.setdefault((int(block.rows[t]), i), [0.0, 0])
                had[0], had[1] = max(had[0], score), had[1] + 1
    return best


def _too_short(text):
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)) < LEAST_WORDS, F.lit(True))


def left_out(benchmark: DataFrame, item_text: str = "text") -> DataFrame:
    """The items, with all columns, that are too short to be looked for: null, blank, or of fewer than LEAST_WORDS words."""
    return benchmark.filter(_too_short(benchmark[f"`{item_text}`"]))


def _item_blocks(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, block_items: int, similarity: float) -> list:
    """For each pass, its broadcast blocks of items with their rare seeds; docs: one column ``text``."""
    spark = docs.sparkSession
    wanted = benchmark.select(benchmark[f"`{item_id}`"].cast("long").alias("item"), benchmark[f"`{item_text}`"].alias("text")).filter(~_too_short(F.col("text")))
    items, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n, out = max(-(-items // block_items), -(-size // BLOCK_BYTES)), []
    for first in range(0, n, PASS_BLOCKS):
        blocks_ = []
        for k in range(first, min(first + PASS_BLOCKS, n)):
            own = wanted.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toArrow().sort_by([("item", "ascending"), ("text", "ascending")])
            blocks_.append(Items(own.column("item").to_pylist(), own.column("text"), similarity))
        shared = [spark.sparkContext.broadcast(x) for x in blocks_]
        counted = _seed_counts(docs, shared).toArrow().to_pydict()
        counts: list[dict[int, int]] = [{} for _ in blocks_]
        for b, seed, many in zip(counted["block"], counted["seed"], counted["n"], strict=True):
            counts[b][seed] = many
        for x, c in zip(blocks_, counts, strict=True):
            x.keep_rare(c)
        out.append([spark.sparkContext.broadcast(x) for x in blocks_])
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, similarity, n_passages) of the documents and items that align."""
    texts = docs.select(docs[f"`{doc_id}`"].alias("id"), docs[f"`{doc_text}`"].alias("text"))
    names = [doc_id, item_id, "similarity", "n_passages"]
    ddl = f"{doc_id} {texts.schema['id'].dataType.simpleString()}, {item_id} long, similarity double, n_passages long"
    out = docs.sparkSession.createDataFrame([], ddl)
    for k, shared in enumerate(_item_blocks(texts.select("text"), benchmark, item_id, item_text, block_items, similarity)):

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in shared:
                    items = block.value
                    if best := _hits(items, batch.column("text"), similarity):
                        at = pa.array([t for t, _ in best])
                        columns = [pa.array([items.ids[i] for _, i in best], pa.int64()), pa.array([s for s, _ in best.values()]), pa.array([n for _, n in best.values()], pa.int64())]
                        yield pa.RecordBatch.from_arrays([batch.column("id").take(at), *columns], names)

        found = common.map_arrow(texts, search, ddl)
        out = out.union(found) if k else found
    return out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows, with all columns, that align with no item."""
    out = docs
    for shared in _item_blocks(docs.select("text"), benchmark, "item_id", "text", BLOCK_ITEMS, similarity):

        def keeps(texts: pa.Array, shared=shared) -> np.ndarray:
            mask = np.ones(len(texts), bool)
            for block in shared:
                mask[[t for t, _ in _hits(block.value, texts, similarity)]] = False
            return mask

        out = common.filter_rows(out, keeps)
    return out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE_SQL: dict[str, str] = {}
