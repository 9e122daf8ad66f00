import random

import numpy as np
import pyarrow as pa

from quillon.llm.words import blocks, runs_hash, shingles
from tests.llm.helpers import WORD, prose


def test_words_and_windows():
    rng = random.Random(3)
    texts = ["", None, " ", "a", "a b", "\ta\x0bb\r\n", "é\xa0x y", *(prose(rng, 5) for _ in range(20)), "tail", "x" * 5000]
    for lower in (False, True):
        for chunk in (1, 100, 1 << 20):
            seen = {}
            rows = 0
            for b in blocks(pa.array(texts), lower, chunk):
                for k, row in enumerate(b.rows):
                    own = slice(b.first[k], b.first[k + 1])
                    found = [bytes(b.data[s:e]).decode() for s, e in zip(b.starts[own], b.ends[own], strict=True)]
                    assert found == WORD.findall(texts[row] or "")
                    for w, h in zip(found, b.hashes[own].tolist(), strict=True):
                        w = w.translate({c: c + 32 for c in range(65, 91)}) if lower else w
                        assert seen.setdefault(w, h) == h
                    rows += 1
                n = [max(1, len(WORD.findall(texts[r] or "")) - 4) if WORD.findall(texts[r] or "") else 0 for r in b.rows]
                assert np.bincount(shingles(b)[1], minlength=len(b)).tolist() == n
            assert rows == len(texts) and len(set(seen.values())) == len(seen)
    assert list(blocks(pa.array([], pa.string()))) == []


def test_runs_hash_depends_on_order_and_length():
    v = np.array([1, 2, 1, 2, 2, 1], np.uint64)
    h = runs_hash(v, np.array([0, 2, 4, 0]), np.array([2, 4, 6, 3]))
    assert h[0] == h[1] and len({int(x) for x in h}) == 3
