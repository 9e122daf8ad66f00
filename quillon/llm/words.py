"""Vectorised words of whole texts: numpy over the bytes of an Arrow string column, without a Python object per word.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D`` (all ASCII, so byte-wise and character-wise cuts agree).
A word's 64-bit hash is a polynomial over random byte values modulo 2**64, finished by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, U), np.full(n, _INVERSE, U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least n places."""
    return _powers(max(CHUNK, 1 << (n - 1).bit_length() if n > 1 else 1))


def runs_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit hashes of values[start:end] for many runs at once."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], dtype=U, out=sums[1:])
    out = (sums[ends] - sums[starts]) * down[starts]
    return mix(out ^ mix((ends - starts).astype(U)))


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


class Block:
    """Some whole texts: their bytes, the words' places and hashes, and for each text its first word.

    rows: the texts' positions in the batch; first[k]:first[k+1] are the words of text k.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, lower: bool):
        self.data, self.offsets, self.rows = data, offsets, rows
        space = _SPACE[data]
        # a word ends at white space or where its text ends
        edge = np.ones(len(data) + 1, bool)
        edge[1:] = False if not len(data) else np.append(space[:-1], True)
        edge[offsets[offsets <= len(data)]] = True
        word = ~space
        starts = np.flatnonzero(word & edge[: len(data)])
        after = np.ones(len(data), bool)
        if len(data):
            after[:-1] = space[1:]
            inner = offsets[(offsets > 0) & (offsets <= len(data))]
            after[inner - 1] = True
        self.starts, self.ends = starts, np.flatnonzero(word & after) + 1
        self.hashes = np.concatenate([np.zeros(0, U), *self._hashes(lower)])
        self.first = np.searchsorted(starts, offsets)

    def _hashes(self, lower: bool) -> Iterator[np.ndarray]:
        """A piece of about CHUNK bytes at a time, cut between words, so that a very long text needs little more memory than its words."""
        a = 0
        while a < len(self.starts):
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + CHUNK, "right")))
            low, high = self.starts[a], self.ends[b - 1]
            letters = self.data[low:high]
            yield runs_hash(_VALUES[_LOWER[letters] if lower else letters], self.starts[a:b] - low, self.ends[a:b] - low)
            a = b

    def __len__(self) -> int:
        return len(self.rows)


def blocks_raw(texts: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, offsets, bytes) of some whole texts at a time, about ``chunk`` bytes (null: empty). A longer text comes alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + chunk, "right")) - 1))
        yield a, b, offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        a = b


def blocks(texts: pa.Array, lower: bool = False, chunk: int = CHUNK) -> Iterator[Block]:
    for a, b, offsets, data in blocks_raw(texts, chunk):
        yield Block(data, offsets, np.arange(a, b), lower)


def shingles(block: Block, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word windows of each text, and the text of each. A text of fewer words (but one) has one window."""
    counts = np.diff(block.first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = block.first[:-1][owner] + within
    return runs_hash(block.hashes, starts, starts + np.minimum(width, counts[owner])), owner
