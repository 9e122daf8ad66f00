"""Language identification with error-correcting output codes.

Each learned language has a codeword. For every bit a binary classifier over hashed byte n-grams (lengths 1 to 4, in words and the blank after them; A-Z lower-cased, every
other ASCII byte but a-z read as a blank, bytes from 128 up kept as they are) tells the languages whose bit is 1 from the others: a log-likelihood ratio of the two groups' n-gram shares, in which each language
counts alike however many documents it has. A text's decision value for a bit is its mean ratio per n-gram, scaled by the bit's spread. Loss-weighted decoding adds
up, for each codeword, the logistic loss of its bits, weighted by how well the bit separates the training languages; the least sum wins. If the runner-up is close, the result is flagged as ambiguous.

N-gram counts by language are gathered from all training documents: tasks count their own rows, and the vectors are summed by (language, cell) in Spark, so the result
has (number of languages) x CELLS numbers however large the corpus. Codes: all 2**(k-1)-1 splits up to MAX_EXHAUSTIVE languages, else BITS random ones.

Defined results: texts that are null or have no letter give ``und`` with score 0; without any learned language all rows do; languages are learned from non-null labels and texts only;
repeated rows agree; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common

CELLS = 1 << 13
LENGTHS = (1, 2, 3, 4)
MAX_EXHAUSTIVE = 6
BITS = 48
UNKNOWN = "und"
EVIDENCE = 200
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
CHUNK = 1 << 19


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, offsets, folded bytes) for some whole texts at a time; each text ends in a blank."""
    from quillon.llm.words import blocks_raw

    for a, b, offsets, data in blocks_raw(texts, CHUNK):
        n = b - a
        # one blank after each text, so that no n-gram spans two
        folded = np.insert(_FOLD[data], offsets[1:], 32) if n else data
        yield a, b, offsets + np.arange(n + 1), folded


def _grams(folded: np.ndarray) -> Iterator[np.ndarray]:
    """For each n-gram length, the cell of the n-gram that begins at each byte; 0 where it would pass a word's end."""
    n = len(folded)
    padded = np.concatenate([folded, np.full(max(LENGTHS), 32, np.uint8)]).astype(np.uint32)
    x = padded[:n]
    code = x + 1
    blank = x == 32
    for k in LENGTHS:
        if k > 1:
            following = padded[k - 1 : k - 1 + n]
            blank = blank | (padded[k - 2 : k - 2 + n] == 32)  # a blank before the last byte: the n-gram passes a word's end
            code = (code * np.uint32(0x01000193)) ^ (following + np.uint32(k << 9))
        h = code * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        cell = (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - 13)
        yield np.where(blank, 0, np.maximum(cell, 1))


def count_cells(texts: pa.Array, groups: np.ndarray, n_groups: int) -> np.ndarray:
    """n-gram counts by group, int64[n_groups, CELLS]."""
    out = np.zeros((n_groups, CELLS), np.int64)
    for a, b, offsets, folded in _chunks(texts):
        owner = np.repeat(groups[a:b].astype(np.int64) * CELLS, np.diff(offsets))
        for cell in _grams(folded):
            out += np.bincount(owner + cell, minlength=n_groups * CELLS).reshape(n_groups, CELLS)
    out[:, 0] = 0
    return out


def decision_sums(texts: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sums of each bit's weights over all n-grams, and the number of n-grams."""
    n, bits = len(texts), weights.shape[1]
    out, seen = np.zeros((n, bits)), np.zeros(n)
    for a, b, offsets, folded in _chunks(texts):
        # every text has a byte at least, the blank after it
        for cell in _grams(folded):
            seen[a:b] += np.add.reduceat((cell > 0).astype(np.int32), offsets[:-1], dtype=np.int64)
            for k in range(bits):
                out[a:b, k] += np.add.reduceat(weights[:, k][cell], offsets[:-1], dtype=np.float64)
    return out, seen


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A 0/1 matrix of n codewords, without constant or repeated bits."""
    if n <= MAX_EXHAUSTIVE:
        return np.array([[(k >> r) & 1 for k in range(1, 1 << (n - 1))] for r in range(n)], np.int8).reshape(n, -1)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(20):
        m = rng.integers(0, 2, (n, BITS), dtype=np.int8)
        m = m[:, (m.min(0) == 0) & (m.max(0) == 1)]
        d = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if d > far:
            best, far = m, d
    return best


class Model:
    """languages, codes[L, B], weights[CELLS, B], and each bit's centre, scale and voting weight."""

    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray, votes: np.ndarray):
        self.languages, self.codes, self.weights, self.centre, self.scale, self.votes = languages, codes, weights, centre, scale, votes

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, ambiguous, number of n-grams) per text; score is the share of the winner among the codewords' likelihoods."""
        if len(self.languages) == 1:
            n = len(texts)
            return np.zeros(n, int), np.ones(n), np.zeros(n, bool), np.zeros(n)
        sums, seen = decision_sums(texts, self.weights)
        mean = sums / np.maximum(seen, 1)[:, None]
        # a short text's mean is less certain
        f = (mean - self.centre) / self.scale * np.sqrt(np.minimum(seen, 400) / 400)[:, None] * 4
        sign = 2.0 * self.codes - 1
        loss = np.stack([(np.logaddexp(0, -f * s) * self.votes).sum(1) for s in sign], 1)
        order = np.argsort(loss, 1, kind="stable")
        p = np.exp(loss.min(1, keepdims=True) - loss)
        score = 1 / p.sum(1)
        best, second = order[:, 0], order[:, 1]
        rows = np.arange(len(loss))
        return best, score, (loss[rows, second] - loss[rows, best]) < 0.2, seen


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model | None:
    """Learn from all rows with a label and a text; None if there are none."""
    rows = docs.select(docs[f"`{lang_col}`"].cast("string").alias("lang"), docs[f"`{text_col}`"].alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            names = langs.dictionary.to_pylist()
            part = count_cells(batch.column("text"), langs.indices.to_numpy(zero_copy_only=False), len(names))
            for name, row in zip(names, part, strict=True):
                total[name] = total[name] + row if name in total else row
        for name, row in total.items():
            cells = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(row[cells])], ["lang", "cell", "n"])

    counted = common.map_arrow(rows, count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    # one vector of CELLS counts a language: its size depends on the number of languages alone
    found = counted.toArrow().to_pydict()
    languages = sorted(set(found["lang"]))
    if not languages:
        return None
    index = {x: k for k, x in enumerate(languages)}
    counts = np.zeros((len(languages), CELLS))
    np.add.at(counts, ([index[x] for x in found["lang"]], found["cell"]), found["n"])
    share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    codes = codewords(len(languages))
    weights = np.stack([np.log(share[b == 1].mean(0)) - np.log(share[b == 0].mean(0)) for b in codes.T], 1) if codes.shape[1] else np.zeros((CELLS, 0))
    weights[0] = 0
    # what each language's own n-grams give on average: the bit's centre and scale, and how well it separates
    means = share @ weights
    centre, scale, votes = np.zeros(codes.shape[1]), np.ones(codes.shape[1]), np.ones(codes.shape[1])
    for k, b in enumerate(codes.T):
        low, high = means[b == 0, k], means[b == 1, k]
        centre[k] = (low.max() + high.min()) / 2
        scale[k] = max((high.mean() - low.mean()) / 2, 1e-6)
        votes[k] = max((high.min() - low.max()) / (2 * scale[k]), 0.05)
    return Model(languages, codes, weights.astype(np.float32), centre, scale, votes / max(votes.sum(), 1e-9) * len(votes))


def predict(docs: DataFrame, model: Model | None, *keep: Column, text_col: str = "text") -> DataFrame:
    """The kept columns, lang_pred, score and ambiguous."""
    text = docs[f"`{text_col}`"]
    kept = docs.select(*keep, F.when(text.rlike(r"\p{L}"), text).alias("text__"))
    fields = [f for f in kept.schema if f.name != "text__"]
    names = [f.name for f in fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, ambiguous boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text__")
            valid = np.asarray(texts.is_valid())
            if model is None:
                valid[:] = False
                lang, score, close = np.full(len(valid), UNKNOWN, object), np.zeros(len(valid)), np.zeros(len(valid), bool)
            else:
                best, score, close, _ = model.predict(texts)
                lang = np.where(valid, np.array(model.languages, object)[best], UNKNOWN)
                score, close = np.where(valid, score, 0.0), close & valid
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score), pa.array(close)], [*names, "lang_pred", "score", "ambiguous"])

    return common.map_arrow(kept, run, ddl)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows, with all columns, that aren't rejected: rejected are those without a letter, and those that are ambiguous though they have enough n-grams to tell by
    (EVIDENCE). Without a model all are rejected, as in ``predict``."""

    def keeps(texts: pa.Array, letters: pa.Array) -> np.ndarray:
        told = np.array(letters.fill_null(False))
        if model is None or not len(told):
            return np.zeros(len(told), bool)
        _, _, close, seen = model.predict(texts)
        return told & ~(close & (seen >= EVIDENCE))

    return common.filter_rows(docs, keeps, docs["text"].rlike(r"\p{L}"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learned from the labelled documents that aren't held out."""
    rows = common.needs(docs, "doc_id", "text", "lang")
    out = held_out(F.col("doc_id"))
    return predict(rows, fit(rows.filter(~out)), F.col("doc_id"), out.alias("held_out"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))


QUERIES = {"op3_language_id": op3_language_id}
ORACLE_SQL: dict[str, str] = {}
