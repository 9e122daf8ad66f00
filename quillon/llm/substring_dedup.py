"""Substring deduplication: paragraph MinHash banding, exact Jaccard on passages extended word by word, clusters by components, removal of later copies.

Paragraphs are of two kinds. Lines of PASSAGE_WORDS words or more, shorter successive lines being joined, give the values of MinHash bands tuned for high recall at Jaccard 0.8. Short paragraphs
give one value, that of all their words: they are cut at words that are the least by hash among REACH successive ones, so any PASSAGE_WORDS words hold a whole one, wherever and in whatever text they stand,
with or without punctuation.

Paragraphs of different documents that agree in a value collide. Each is joined to the first document that has the value (the first itself to the second one); first is the least id, nulls last, then the least row
digest. Where the holders of a value differ in their surroundings, each is also joined to the first that has its own surroundings, and where there are three surroundings or more, one holder of each is compared
with all others: by all stretches of PASSAGE_WORDS words around a short paragraph, each being joined to the first document that has it, and long ones by exact Jaccard of all pairs that the pruning of ``near_sets`` leaves,
each being joined to the earliest that reaches the threshold. Successive paragraphs joined to the same stretch of the same document are one candidate. It is verified on the words of both documents around it: runs of equal word windows are extended to
their ends, runs with few words between are bridged, and what has PASSAGE_WORDS words or more and Jaccard >= 0.8 on word windows is a repeated passage. A verified passage is linked to the place where it was found again, and to what
passages of that document hold the place; clusters are components of these links. A passage joined to an earlier document is removed, so the first copy stays.

Texts are read three times. What is shuffled are hashes, and the texts with candidates once; the commonest values' rows are dealt to all tasks (``packed.look_up``), and a document with very many copies is in
plain joins only, which AQE splits.

Defined results: null, empty and blank texts have no paragraph; rows that agree in id and text are one document, so they aren't copies of each other, and all are cut alike; rows with the same id or a null id and other
texts are documents of their own; repeats inside one document alone are left; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm import common, packed
from quillon.llm import near_sets as N
from quillon.llm.components import components
from quillon.llm.words import Block, U, blocks, blocks_raw, mix, runs_hash, shingles

PASSAGE_WORDS = 50
WIDTH = 5
THRESHOLD = 0.8
ROWS = 4
RECALL = 0.995
#: Words by which a place for a cut is picked, successive ones of which one is picked, and the least words of a short paragraph: GRAM + 2 * REACH - 1 <= PASSAGE_WORDS.
GRAM = 3
REACH = 24
SHORT_WORDS = 10
#: Words between runs that a passage may bridge; words between paragraphs of one candidate; words read beyond a candidate's paragraphs.
BRIDGE_WORDS = 16
CHAIN_WORDS = 60
AROUND = 50
NO_ID = (1 << 63) - 1
_LOW = U(0xFFFFFFFF)


def cuts(block: Block) -> np.ndarray:
    """The words that begin the least GRAM words by hash among REACH successive ones of a text."""
    m = len(block.hashes) - GRAM + 1
    if m < REACH:
        return np.zeros(0, np.int64)
    at = np.arange(m)
    least = (runs_hash(block.hashes, at, at + GRAM) & ~_LOW) | at.astype(U)
    size = 1
    while 2 * size <= REACH:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: m - REACH + 1], least[REACH - size :])
    text = np.repeat(np.arange(len(block)), np.diff(block.first))
    first = at[: m - REACH + 1]
    place = (least & _LOW).astype(np.int64)[text[first] == text[first + REACH + GRAM - 2]]
    return place[np.append(True, place[1:] != place[:-1])] if len(place) else place


def short_paragraphs(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(first words, words after): from each cut to the end of the next one, of SHORT_WORDS words at least; of more where cuts stand close, and of PASSAGE_WORDS where one word goes on for so long."""
    c = cuts(block)
    if len(c) < 2:
        return c[:0], c[:0]
    text = np.searchsorted(block.first, c, "right") - 1
    ok = text[1:] == text[:-1]
    a, b = c[:-1][ok], c[1:][ok]
    least = np.where(b - a <= GRAM, PASSAGE_WORDS - REACH + 1, SHORT_WORDS)
    other = np.append(np.flatnonzero(block.hashes[1:] != block.hashes[:-1]) + 1, len(block.hashes))
    least[other[np.searchsorted(other, a, "right")] - a >= PASSAGE_WORDS] = PASSAGE_WORDS
    return a, np.minimum(np.maximum(b + GRAM, a + least), block.first[text[:-1][ok] + 1])


def long_paragraphs(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(first words, words after): lines of PASSAGE_WORDS words or more, and successive shorter ones joined until they pass a multiple of that; a long line ends the joining, so the
    cuts depend on the text since the last long line only. A rest of fewer words is skipped."""
    n = len(block.hashes)
    if not n:
        return (np.zeros(0, np.int64),) * 2
    new_text = np.zeros(n, bool)
    new_text[block.first[:-1][np.diff(block.first) > 0]] = True
    lines = np.append(0, np.cumsum(block.data == 10))
    new = new_text.copy()
    new[1:] |= lines[block.starts[1:]] > lines[block.ends[:-1]]
    a = np.flatnonzero(new)
    size = np.diff(np.append(a, n))
    alone = np.append(True, (size[:-1] >= PASSAGE_WORDS) | (size[1:] >= PASSAGE_WORDS) | new_text[a[1:]])
    total = np.cumsum(size)
    since = (total - size) - np.maximum.accumulate(np.where(alone, total - size, 0))
    passed = np.append(True, (since[:-1] + size[:-1]) // PASSAGE_WORDS > since[:-1] // PASSAGE_WORDS)
    a = a[alone | passed]
    b = np.append(a[1:], n)
    long = b - a >= PASSAGE_WORDS
    return a[long], b[long]


def _minhash(block: Block, a: np.ndarray, b: np.ndarray, n_hashes: int) -> np.ndarray:
    n = b - a - WIDTH + 1
    starts = np.cumsum(n) - n
    s = np.repeat(a - starts, n) + np.arange(n.sum())
    return N.minhash(runs_hash(block.hashes, s, s + WIDTH), starts, n_hashes)


def collision_keys(block: Block, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, first word in it, words, surroundings) for all paragraphs of a block. surroundings: a digest of the words in all stretches of PASSAGE_WORDS words that hold a short paragraph (even),
    and of all words of a long one (odd); paragraphs that agree in it and the key are copies."""
    a, b = short_paragraphs(block)
    c, d = long_paragraphs(block)
    text = np.searchsorted(block.first, a, "right") - 1
    more = np.maximum(PASSAGE_WORDS - (b - a), 0)
    before, after = runs_hash(block.hashes, np.maximum(a - more, block.first[text]), a), runs_hash(block.hashes, b, np.minimum(b + more, block.first[text + 1]))
    keys, around = [runs_hash(block.hashes, a, b).view(np.int64)], [mix(before ^ mix(after)) & ~U(1)]
    if len(c):
        keys.append(N.band_hashes(_minhash(block, c, d, bands * rows), bands, rows).reshape(-1))
        around.append(np.repeat(runs_hash(block.hashes, c, d) | U(1), bands))
        a, b = np.append(a, np.repeat(c, bands)), np.append(b, np.repeat(d, bands))
    text = np.searchsorted(block.first, a, "right") - 1
    return np.concatenate(keys), text, (a - block.first[text]).astype(np.int32), (b - a).astype(np.int32), np.concatenate(around).view(np.int64)


def _two_first(key, id_, row, place, n, around, mixed):
    """Of each key, the rows of the two first documents; the first one's n is the number of all of the key, its mixed whether they differ in their surroundings."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else order
    size = np.diff(np.append(start, len(k)))
    one, more = order[start[size == 1]], order[np.repeat(size > 1, size)]
    more = more[np.lexsort((place[more], row[more], id_[more], key[more]))]
    k, r = key[more], row[more]
    if not len(more):
        return tuple(x[one] for x in (key, id_, row, place, n, around, mixed))
    new_key = np.append(True, k[1:] != k[:-1])
    fresh = new_key | np.append(True, r[1:] != r[:-1])
    starts = np.flatnonzero(new_key)
    total = np.add.reduceat(n[more], starts)
    differ = np.maximum.reduceat(mixed[more], starts) | (np.minimum.reduceat(around[more], starts) != np.maximum.reduceat(around[more], starts))
    rank = np.cumsum(fresh) - np.maximum.accumulate(np.where(new_key, np.cumsum(fresh), 0))
    kept = np.flatnonzero(fresh & (rank < 2))
    count = np.where(new_key[kept], total[np.cumsum(new_key)[kept] - 1], 0)
    chosen = np.append(one, more[kept])
    told = np.where(new_key[kept], differ[np.cumsum(new_key)[kept] - 1], 0).astype(np.int8)
    return (*(x[chosen] for x in (key, id_, row, place)), np.append(n[one], count), around[chosen], np.append(mixed[one], told))


def _shared(key, id_, row, place, n, around, mixed) -> pa.RecordBatch:
    """The keys of two documents or more; combined rows of a key stand next to each other, the first one first."""
    first = np.flatnonzero(key[1:] == key[:-1])
    columns = [key[first], n[first], n[first], row[first], place[first], row[first + 1], place[first + 1], mixed[first] * (n[first] > 2)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "n", "copies", "row1", "place1", "row2", "place2", "mixed"])


def _chains(row, place, words, other, there, gone, key, copies) -> pa.RecordBatch:
    """Candidates: successive paragraphs joined to the same stretch of the same document; of each, the rarest paragraph is where the two documents are laid together."""
    order = np.lexsort((key, place, other, row))
    row, place, words, other, there, gone, key, copies = (x[order] for x in (row, place, words, other, there, gone, key, copies))
    place, words, there = (x.astype(np.int64) for x in (place, words, there))
    if len(row):
        fresh = np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1]) | (key[1:] != key[:-1]))
        row, place, words, other, there, gone, key, copies = (x[fresh] for x in (row, place, words, other, there, gone, key, copies))
    n = len(row)
    pair = np.append(True, (row[1:] != row[:-1]) | (other[1:] != other[:-1]))[:n]
    group = np.cumsum(pair) << 32
    reach = np.maximum.accumulate(group + place + words)
    new = pair.copy()
    new[1:] |= (group + place)[1:] > reach[:-1] + CHAIN_WORDS
    new[1:] |= np.abs(np.diff(there - place)) > CHAIN_WORDS
    first = np.flatnonzero(new)
    chain = np.cumsum(new) - 1
    best = np.lexsort((key, copies, chain))[first] if n else first
    end = np.maximum.reduceat(place + words, first) if n else first
    columns = [row[first], place[first], end, other[first], place[best], there[best], gone[first] > 0]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row", "first", "after", "other", "here", "there", "gone"])


_CHAIN = "row long, first long, after long, other long, here long, there long, gone boolean"


_TIES = ["key", "row", "place", "words", "copies", "row1", "place1", "row2", "place2"]


def _copies(mixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of paragraphs whose key has several surroundings: ties of those that agree in both to the first document that has them, and (row, place, words, long) of the first of each where the key has
    three surroundings or more. Of two, the one is tied to the other by the key itself."""
    # successive paragraphs of a text that agree in both, as in a run of a few words repeated, are one; around holds all words of a paragraph, so words is the same for all that agree
    own = W.partitionBy("key", "around", "row").orderBy("place")
    new = F.coalesce((F.col("place") >= F.lag(F.col("place") + F.col("words")).over(own)).cast("int"), F.lit(0))
    runs = mixed.withColumn("new", new).withColumn("run", F.sum("new").over(own)).groupBy("key", "around", "row", "run")
    same = [F.first(c).alias(c) for c in ("id", "row1", "place1", "row2", "place2")]
    runs = runs.agg(F.min("place").alias("place"), (F.max("place") - F.min("place") + F.first("words")).alias("words"), F.first("words").alias("each"), F.count(F.lit(1)).alias("times"), *same)
    runs = common.written(runs.drop("run"), "paragraph-runs")
    where = F.struct("id", "row", "place")
    one = common.written(runs.groupBy("key", "around").agg(F.min(where).alias("one"), F.first("each").alias("words1")), "paragraph-firsts")
    named = one.select(F.col("key").alias("key_"), F.col("around").alias("around_"), "one")
    held = common.written(runs.join(named, (F.col("key") == F.col("key_")) & (F.col("around") == F.col("around_"))).drop("key_", "around_"), "paragraph-copies")
    two = held.filter(F.col("row") != F.col("one.row")).groupBy("key", "around").agg(F.min(where).alias("two"), F.sum("times").alias("others"))
    two = common.written(two.withColumnsRenamed({"key": "key_", "around": "around_"}), "paragraph-seconds")
    told = (F.col("one.row") == F.col("row1")) & (F.col("one.place") == F.col("place1")) & (F.col("two.row") == F.col("row2")) & (F.col("two.place") == F.col("place2"))
    ties = held.join(two, (F.col("key") == F.col("key_")) & (F.col("around") == F.col("around_"))).filter(~told)
    ties = ties.select(F.xxhash64("key", "around").alias("key"), "row", "place", "words", (F.col("others") + 1).alias("copies"), F.col("one.row").alias("row1"), F.col("one.place").alias("place1"), F.col("two.row").alias("row2"), F.col("two.place").alias("place2"))
    several = common.written(one.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").select(F.col("key").alias("key_")), "paragraph-crowds")
    rest = one.join(several, F.col("key") == F.col("key_")).select("one.row", "one.place", F.col("words1").alias("words"), (F.col("around").bitwiseAND(1) == 1).alias("long"))
    # written, as the planner takes a join for the product of its sides and packed.shuffle would cut it into as many shards
    return common.written(ties, "paragraph-ties"), rest.distinct()


_PIECE = "row long, id long, long boolean, first int, after int, start long, end long, text string"


def _pieces(texts: DataFrame, rest: DataFrame) -> DataFrame:
    """The words of long paragraphs, and those of all stretches of PASSAGE_WORDS words that hold a short one, stretches that overlap being one."""
    wanted = common.written(rest.groupBy(F.col("row").alias("row_")).agg(F.collect_list(F.struct("place", "words", "long")).alias("wants")), "piece-wants")
    seen: set[int] = set()
    names = ["row", "id", "long", "first", "after", "start", "end", "text"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

    def stretches(wants: list[dict], n: int) -> Iterator[tuple[bool, int, int]]:
        last = None
        for place, words in sorted((w["place"], w["words"]) for w in wants if not w["long"]):
            more = max(PASSAGE_WORDS - words, 0)
            a, b = max(place - more, 0), min(place + words + more, n)
            if last is not None and a <= last[1]:
                last = (last[0], max(b, last[1]))
                continue
            if last is not None:
                yield False, *last
            last = (a, b)
        if last is not None:
            yield False, *last
        yield from ((True, w["place"], w["place"] + w["words"]) for w in wants if w["long"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
        for batch in batches:
            rows, ids = batch.column("row").to_pylist(), batch.column("id").to_pylist()
            for block in blocks(batch.column("text")):
                for k, r in enumerate(block.rows):
                    if rows[r] in seen:
                        continue
                    seen.add(rows[r])
                    low, n, base = int(block.first[k]), int(block.first[k + 1] - block.first[k]), int(block.offsets[k])
                    for long, a, b in stretches(batch.column("wants")[int(r)].as_py(), n):
                        start, end = int(block.starts[low + a]), int(block.ends[low + b - 1])
                        held.append((rows[r], ids[r], long, a, b, start - base, end - base, block.data[start:end].tobytes().decode()))
                        size += end - start
                        if size > 4 << 20:
                            yield flush()
                            held, size = [], 0
        if held:
            yield flush()

    return common.written(common.map_arrow(texts.join(wanted, F.col("row") == F.col("row_")).select("row", "id", "text", "wants"), cut, _PIECE), "paragraph-pieces")


def _same_words(pieces: DataFrame) -> DataFrame:
    """Ties of all stretches of PASSAGE_WORDS words of the pieces that stand in two documents or more to the first that has them."""

    def stretches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        row, id_, first = (batch.column(c).to_numpy() for c in ("row", "id", "first"))
        for block in blocks(batch.column("text")):
            n = np.maximum(np.diff(block.first) - PASSAGE_WORDS + 1, 0)
            owner = np.repeat(np.arange(len(n)), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, at = block.first[:-1][owner] + within, block.rows[owner]
            yield runs_hash(block.hashes, a, a + PASSAGE_WORDS).view(np.int64), id_[at], row[at], (first[at] + within).astype(np.int32)

    def holders(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for key, id_, row, place in stretches(batch):
            yield key, id_, row, place, np.ones(len(key), np.int64), np.zeros(len(key), np.int64), np.zeros(len(key), np.int8)

    def places(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for key, _, row, place in stretches(batch):
            yield key, row, place, np.full(len(key), PASSAGE_WORDS, np.int32)

    i8, i4, i1 = np.int64, np.int32, np.int8
    short = pieces.filter("NOT long").select("row", "id", "first", "text")
    shared = common.written(packed.shuffle(short, holders, _two_first, _shared, (i8, i8, i8, i4, i8, i8, i1), _SHARED).drop("mixed"), "stretch-keys")
    schema = "key long, row long, place int, words int, copies long, row1 long, place1 int, row2 long, place2 int"
    return common.written(packed.look_up(short, places, (i8, i8, i4, i4), ["key", "row", "place", "words"], shared, (i8, i8, i4, i8, i4), schema), "stretch-places")


def _near_paragraphs(pieces: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """(row, id, first, after, start, end, key, row1, id1, first1, gone): each long paragraph of the pieces with another document's of exact Jaccard >= threshold, the earliest of all such ones; gone: that one is the earlier one."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "id", "first", "after", "start", "end"]
        for batch in batches:
            for block in blocks(batch.column("text")):
                values, owners, starts, _ = N.distinct_sets(*shingles(block, WIDTH))
                cuts = np.append(starts, len(values))
                signature, items = N.minhash(values, starts, bands * rows), [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                kept = batch.select(names).take(pa.array(block.rows[owners]))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.diff(cuts)), pa.array([x.tobytes() for x in signature], pa.binary()), pa.array(items, pa.binary())], [*names, "size", "signature", "items"])

    long = pieces.filter("long").select("row", "id", "first", "after", "start", "end", "text")
    signed = common.map_arrow(long, sign, "row long, id long, first int, after int, start long, end long, size long, signature binary, items binary")
    signed = common.written(signed.withColumn("key", F.xxhash64("row", "first")).dropDuplicates(["key"]), "piece-sets")
    groups = N.candidate_groups(signed.select("key", "size", "signature"), threshold, bands, rows)
    groups = common.written(groups.withColumnRenamed("id", "key_").join(signed.select("key", "size"), F.col("key_") == F.col("key")).select("key", "root", "size"), "piece-grouped")
    groups = common.written(N.with_blocks(groups, "size").drop("size").withColumnRenamed("key", "key_"), "piece-groups")
    members = signed.join(groups, F.col("key") == F.col("key_")).select("root", "blocks", "key", "id", "row", "signature", "items")

    def earliest(t: pa.Table) -> pa.RecordBatch | None:
        key, block, id_, row = (t.column(c).to_numpy() for c in ("key", "block", "id", "row"))
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        sig, items = N._signatures(t.column("signature")), t.column("items")
        sets = [np.frombuffer(items[k].as_buffer(), U) for k in range(len(key))]
        a, b = (np.arange(len(key)),) * 2 if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
        if not len(a) or not len(b):
            return None
        p, q = N.similar_pairs(sig[a], [sets[x] for x in a], sig[b], [sets[x] for x in b], threshold, i == j)
        p, q = a[p], b[q]
        p, q = p[row[p] != row[q]], q[row[p] != row[q]]
        if not len(p):
            return None
        own, other = np.append(p, q), np.append(q, p)
        order = np.lexsort((key[other], row[other], id_[other], own))
        order = order[np.append(True, own[order][1:] != own[order][:-1])]
        own, other = own[order], other[order]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[own], id_[other], row[other], key[other])], ["own", "id", "row", "key"])

    found = common.map_arrow(N._block_pairs(members, "root", "key", "id", "row", "signature", "items"), N._by_group(("root", "i", "j"), earliest), "own long, id long, row long, key long")
    found = common.written(found.groupBy("own").agg(F.min(F.struct("id", "row", "key")).alias("best")), "piece-partners")
    known = signed.select("row", "id", "first", "after", "start", "end", "key")
    partner = common.written(known.select(F.col("key").alias("key_"), F.col("first").alias("first1")), "piece-places")
    near = known.join(found, F.col("key") == F.col("own")).join(partner, F.col("best.key") == F.col("key_"))
    gone = (F.col("best.id") < F.col("id")) | ((F.col("best.id") == F.col("id")) & (F.col("best.row") < F.col("row")))
    return common.written(near.select("row", "id", "first", "after", "start", "end", "key", F.col("best.row").alias("row1"), F.col("best.id").alias("id1"), "first1", gone.alias("gone")), "near-paragraphs")


_SHARED = "key long, n long, copies long, row1 long, place1 int, row2 long, place2 int, mixed byte"


def _candidates(texts: DataFrame, threshold: float, recall: float, rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Candidates, and the near paragraphs among them that are known to reach the threshold."""
    bands = N.tune(threshold, recall, rows)

    def paragraphs(batch: pa.RecordBatch, sent: set[int]) -> Iterator[tuple[np.ndarray, ...]]:
        ids = batch.column("row").to_numpy()
        fresh = np.array([x not in sent and not sent.add(x) for x in ids.tolist()], bool)
        if not fresh.all():
            batch = batch.filter(pa.array(fresh))
        ids, first = batch.column("row").to_numpy(), batch.column("id").to_numpy()
        for block in blocks(batch.column("text")):
            key, text, place, words, around = collision_keys(block, bands, rows)
            at = block.rows[text]
            yield key, first[at], ids[at], place, words, around

    counted, listed = set(), set()  # each task has its own

    def holders(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for key, id_, row, place, _, around in paragraphs(batch, counted):
            yield key, id_, row, place, np.ones(len(key), np.int64), around, np.zeros(len(key), np.int8)

    def places(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for key, id_, row, place, words, around in paragraphs(batch, listed):
            yield key, row, place, words, id_, around

    i8, i4, i1 = np.int64, np.int32, np.int8
    shared = common.written(packed.shuffle(texts, holders, _two_first, _shared, (i8, i8, i8, i4, i8, i8, i1), _SHARED), "paragraph-keys")
    schema = "key long, row long, place int, words int, id long, around long, copies long, row1 long, place1 int, row2 long, place2 int, mixed byte"
    found = packed.look_up(texts, places, (i8, i8, i4, i4, i8, i8), ["key", "row", "place", "words", "id", "around"], shared, (i8, i8, i4, i8, i4, i1), schema)
    mixed = F.col("mixed") == 1
    found = common.written(found.withColumn("id", F.when(mixed, F.col("id"))).withColumn("around", F.when(mixed, F.col("around"))), "paragraph-places")
    ties, near = found.select(*_TIES), None
    # whom the first document of a key doesn't resemble is tied to the first copy of its surroundings, and these to each other
    some = found.filter(mixed)
    if some.head(1):
        copies, rest = _copies(some)
        ties = ties.union(copies.select(*_TIES))
        rest = common.written(rest, "paragraph-rest")
        if rest.head(1):
            pieces = _pieces(texts, rest)
            near = _near_paragraphs(pieces, threshold, bands, rows)
            ends = [F.when(F.col("gone"), F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("row1", "row", "row1"), ("first1", "first", "place1"), ("row", "row1", "row2"), ("first", "first1", "place2"))]
            told = near.select("key", "row", F.col("first").alias("place"), (F.col("after") - F.col("first")).alias("words"), F.lit(2).cast("long").alias("copies"), *ends)
            ties = ties.union(_same_words(pieces).select(*_TIES)).union(told.select(*_TIES))

    def joined(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        c = {name: batch.column(name).to_numpy() for name in batch.schema.names}
        own = c["row"] == c["row1"]
        yield c["row"], c["place"], c["words"], np.where(own, c["row2"], c["row1"]), np.where(own, c["place2"], c["place1"]), (~own).astype(np.int8), c["key"], c["copies"]

    same = lambda *columns: columns
    return common.written(packed.shuffle(ties, joined, same, _chains, (i8, i4, i4, i8, i4, i1, i8, i8), _CHAIN), "passage-candidates"), near


_SLICE = "own boolean, row long, id long, base long, first long, other long, here long, there long, gone boolean, text string"


def _slices(texts: DataFrame, chains: DataFrame) -> DataFrame:
    """The words of candidates and around (own), and those that others are laid to."""
    here, around = F.col("here"), F.lit(AROUND)
    own = chains.select("row", F.struct(F.lit(True).alias("own"), (F.col("first") - around).alias("first"), (F.col("after") + around).alias("after"), "other", "here", "there", "gone").alias("want"))
    # a document's paragraphs bound its slices, however many candidates are laid to one; similar stretches differ in length by a quarter at most
    there = chains.groupBy("other", "there").agg(F.max(here - F.col("first")).alias("left"), F.max(F.col("after") - here).alias("right"))
    first = (F.col("there") - F.col("left") * 5 / 4).cast("long") - around
    after = (F.col("there") + F.col("right") * 5 / 4).cast("long") + around
    none = F.lit(0).cast("long")
    laid = there.select(F.col("other").alias("row"), F.struct(F.lit(False).alias("own"), first.alias("first"), after.alias("after"), none.alias("other"), none.alias("here"), "there", F.lit(False).alias("gone")).alias("want"))
    wanted = common.written(own.union(laid).groupBy(F.col("row").alias("row_")).agg(F.collect_list("want").alias("wants")), "passage-wants")
    seen: set[int] = set()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("own", pa.bool_()), ("row", pa.int64()), ("id", pa.int64()), ("base", pa.int64()), ("first", pa.int64()), *((c, pa.int64()) for c in ("other", "here", "there")), ("gone", pa.bool_()), ("text", pa.string())])
        held, size = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
        for batch in batches:
            rows, ids = batch.column("row").to_pylist(), batch.column("id").to_pylist()
            for block in blocks(batch.column("text")):
                for k, r in enumerate(block.rows):
                    if rows[r] in seen:
                        continue
                    seen.add(rows[r])
                    low, n, base = int(block.first[k]), int(block.first[k + 1] - block.first[k]), int(block.offsets[k])
                    for w in batch.column("wants")[int(r)].as_py():
                        a, b = max(w["first"], 0), min(w["after"], n)
                        if a >= b:
                            continue
                        start, end = int(block.starts[low + a]), int(block.ends[low + b - 1])
                        held.append((w["own"], rows[r], ids[r], start - base, a, w["other"], w["here"], w["there"], w["gone"], block.data[start:end].tobytes().decode()))
                        size += end - start
                        if size > 4 << 20:
                            yield flush()
                            held, size = [], 0
        if held:
            yield flush()

    return common.written(common.map_arrow(texts.join(wanted, F.col("row") == F.col("row_")).select("row", "id", "text", "wants"), cut, _SLICE), "passage-slices")


def _runs(i: np.ndarray, j: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """From equal windows i of one text and j of the other: (first and last window here, first and last there) of the passages."""
    new = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1
    first, last = np.append(0, new), np.append(new, len(i)) - 1
    now = None
    for a, b, c, d in zip(i[first].tolist(), i[last].tolist(), j[first].tolist(), j[last].tolist(), strict=True):
        if now is not None:
            s, e, t, u, m = now
            low, high, both = min(t, c), max(u, d), m + b - a + 1
            near = a - e - 1 <= BRIDGE_WORDS + WIDTH - 1 and abs(c - u - 1) <= BRIDGE_WORDS + WIDTH - 1
            if near and both >= threshold * ((b - s + 1) + (high - low + 1) - both):
                now = (s, b, low, high, both)
                continue
            yield s, e, t, u
        now = (a, b, c, d, b - a + 1)
    if now is not None:
        yield now[:4]


def _whole(text: pa.Array) -> Block:
    """One block of a few texts."""
    (found,) = blocks_raw(text, 1 << 62)
    return Block(found[3], found[2], np.arange(len(text)), False)


def passages(here: pa.Array, there: pa.Array, shift: np.ndarray, threshold: float = THRESHOLD, least: int = PASSAGE_WORDS) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(pair, first word, word after, first byte, byte after) in ``here`` of the passages that two texts share, and the middle word of each in ``there``; word k of here is laid to word k + shift of there."""
    x, y = _whole(here), _whole(there)

    def windows(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.maximum(np.diff(block.first) - WIDTH + 1, 0)
        owner = np.repeat(np.arange(len(n)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        s = block.first[:-1][owner] + within
        # a window is compared with those of its own pair only
        return mix(runs_hash(block.hashes, s, s + WIDTH) + owner.astype(U) * U(0x9E3779B97F4A7C15)), owner, within

    (hx, ox, wx), (hy, _, wy) = windows(x), windows(y)
    if not len(hx) or not len(hy):
        return
    order = np.argsort(hy, kind="stable")
    k = np.searchsorted(hy[order], hx)
    k[k == len(hy)] = 0
    k = order[k]
    j = np.where(hy[k] == hx, wy[k], -1)
    count = np.maximum(np.diff(y.first) - WIDTH + 1, 0)
    base = np.cumsum(count) - count
    straight = wx + shift[ox]
    inside = (straight >= 0) & (straight < count[ox])
    on = np.zeros(len(hx), bool)
    on[inside] = hy[base[ox[inside]] + straight[inside]] == hx[inside]
    j = np.where(on, straight, np.where(np.abs(j - straight) <= CHAIN_WORDS, j, -1))
    cut = np.searchsorted(ox, np.arange(len(here) + 1))
    for pair in range(len(here)):
        mine = j[cut[pair] : cut[pair + 1]]
        i = np.flatnonzero(mine >= 0)
        if not len(i):
            continue
        for s, e, t, u in _runs(i, mine[i], threshold):
            if e - s + WIDTH < least:
                continue
            a, b = hx[cut[pair] + s : cut[pair] + e + 1], hy[base[pair] + t : base[pair] + u + 1]
            both = len(np.intersect1d(a, b))
            if both >= threshold * (len(np.unique(a)) + len(np.unique(b)) - both) - 1e-9:
                low, high = x.first[pair] + s, x.first[pair] + e + WIDTH
                yield pair, s, e + WIDTH, int(x.starts[low] - x.offsets[pair]), int(x.ends[high - 1] - x.offsets[pair]), (t + u + WIDTH) // 2


_FOUND = "row long, id long, first long, after long, start long, end long, removed boolean, first_id long, other long, there long"


def _verified(slices: DataFrame, threshold: float, least: int) -> DataFrame:
    laid = slices.filter("NOT own").select(F.col("row").alias("row_"), F.col("there").alias("there_"), F.col("first").alias("first_"), F.col("id").alias("id_"), F.col("text").alias("text_"))
    pairs = slices.filter("own").join(laid, (F.col("other") == F.col("row_")) & (F.col("there") == F.col("there_")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 64):
                batch = whole.slice(at, 64)
                c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("row", "id", "base", "first", "here", "there", "first_", "id_", "gone", "other")}
                shift = (c["there"] - c["first_"]) - (c["here"] - c["first"])
                found = list(passages(batch.column("text"), batch.column("text_"), shift, threshold, least))
                if not found:
                    continue
                pair, a, b, s, e, middle = (np.array(x, np.int64) for x in zip(*found, strict=True))
                columns = [c["row"][pair], c["id"][pair], c["first"][pair] + a, c["first"][pair] + b, c["base"][pair] + s, c["base"][pair] + e, c["gone"][pair], np.where(c["gone"][pair], c["id_"][pair], c["id"][pair]), c["other"][pair], c["first_"][pair] + middle]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row", "id", "first", "after", "start", "end", "removed", "first_id", "other", "there"])

    names = ["row", "id", "base", "first", "here", "there", "gone", "other", "text", "first_", "id_", "text_"]
    return common.written(common.map_arrow(pairs.select(*names), verify, _FOUND), "passages-verified")


def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, least_words: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated passage: id, start and end (bytes in the UTF-8 text), n_words, class_id (its cluster), first_id (the id of the document it was found to repeat, or its own for the first copy), removed
    (false for first copies), row_id (``common.row_id``). A document's overlapping passages are one. least_words: PASSAGE_WORDS or more, as shorter passages may hold no whole paragraph."""
    text = docs[f"`{text_col}`"]
    texts = docs.select(F.coalesce(docs[f"`{id_col}`"].cast("long"), F.lit(NO_ID)).alias("id"), common.row_id(docs, id_col, text_col).alias("row"), text.alias("text")).filter(text.isNotNull())
    chains, near = _candidates(texts, threshold, recall, rows)
    found = _verified(_slices(texts, chains), threshold, least_words)
    if near is not None:
        whole = near.filter(F.col("after") - F.col("first") >= least_words)
        words = [F.col(c).cast("long").alias(c) for c in ("first", "after")]
        found = found.union(whole.select("row", "id", *words, "start", "end", F.col("gone").alias("removed"), F.when(F.col("gone"), F.col("id1")).otherwise(F.col("id")).alias("first_id"), F.col("row1").alias("other"), F.col("first1").cast("long").alias("there")))
    before = F.max("after").over(W.partitionBy("row", "removed").orderBy("first", "after").rowsBetween(W.unboundedPreceding, -1))
    found = found.withColumn("new", F.coalesce((F.col("first") > before).cast("int"), F.lit(0)))
    found = found.withColumn("part", F.sum("new").over(W.partitionBy("row", "removed").orderBy("first", "after").rowsBetween(W.unboundedPreceding, 0)))
    own, place = F.xxhash64("row", "removed", "part"), F.xxhash64("other", "there")
    found = common.written(found.withColumn("passage", own).withColumn("place", place), "passage-parts")
    whole = found.groupBy("passage", "row", "id", "removed").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first").alias("first"), F.max("after").alias("after"), F.min("first_id").alias("first_id"))
    whole = common.written(whole, "passages")
    holders = whole.select(F.col("row").alias("row_"), F.col("first").alias("first_"), F.col("after").alias("after_"), F.col("passage").alias("holder"))
    places = common.written(found.select("place", "other", "there").distinct(), "passage-places")
    held = places.join(holders, (F.col("other") == F.col("row_")) & (F.col("there") >= F.col("first_")) & (F.col("there") < F.col("after_")))
    ties = components(found.select(F.col("passage").alias("a"), F.col("place").alias("b")).union(held.select(F.col("holder").alias("a"), F.col("place").alias("b"))))
    whole = whole.join(common.written(ties.withColumnRenamed("id", "id_"), "passage-classes"), F.col("passage") == F.col("id_")).withColumn("class_id", F.col("root"))
    # a first copy that lies in a removed passage says nothing more
    gone = F.collect_list(F.when(F.col("removed"), F.struct("first", "after"))).over(W.partitionBy("row"))
    whole = whole.withColumn("gone", gone).filter(F.col("removed") | ~F.exists("gone", lambda x: (x["first"] <= F.col("first")) & (x["after"] >= F.col("after"))))
    whole = whole.withColumn("n_words", F.col("after") - F.col("first")).drop("gone")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return whole.select(known("id").alias(id_col), "start", "end", "n_words", "class_id", known("first_id").alias("first_id"), "removed", F.col("row").alias("row_id"))


def remove(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their removed passages; a text that is nothing but such passages goes. All columns are kept in place. Passages belong to rows by id and text, so no other row of the id is cut."""
    spans = passages.filter("removed").groupBy(F.col("row_id").alias("row__")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans__"))
    spans = common.written(spans, "passage-spans")
    joined = docs.join(spans.hint("merge"), common.row_id(docs, id_col, text_col) == F.col("row__"), "left")
    text = docs[f"`{text_col}`"]
    cut = F.aggregate(
        "spans__",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text")),
        lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["text"], _bytes(text, a["at"], s["start"])).alias("text")),
        lambda a: F.concat(a["text"], _bytes(text, a["at"], F.octet_length(text).cast("long"))),
    )
    out = joined.withColumn("cut__", F.when(F.col("spans__").isNotNull(), cut).otherwise(text))
    kept = out.filter(F.col("spans__").isNull() | F.col("cut__").rlike(common.WORD))
    return kept.select(*[F.col("cut__").alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns])


def _bytes(text, start, end):
    """The text between two byte places, which lie at word borders."""
    return F.substring(text.cast("binary"), (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int")).cast("string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(common.table(spark, sf_dir, "documents"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
