import random

import numpy as np
import pyarrow as pa
import pytest

from mixtally.llm import textops as T
from mixtally.llm.chunks import pack, unpack
from tests.llm import plain


@pytest.mark.parametrize("seed", range(5))
def test_words_and_hashes(seed):
    texts = plain.corpus(seed)
    data, offs = T.flat(pa.array(texts, pa.string()))
    names = {}
    for lower, table, pattern in ((False, T.NON_SPACE, plain.WORD), (True, T.ALNUM, plain.ALNUM)):
        w = T.Words(data, offs, table, lower)
        h = w.hashes()
        got = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end)]
        for i, t in enumerate(texts):
            want = pattern.findall((t or "").translate(plain.LOWER) if lower else t or "")
            assert [x.decode() for x in got[w.first[i] : w.first[i + 1]]] == want
        for x, y in zip(got, h.tolist()):
            assert names.setdefault(x, y) == y
    assert len(set(names.values())) == len(names)


def test_slices_and_touching_rows():
    column = pa.array(["zz", "ab", "cd", None, "", "e f"], pa.string()).slice(1)
    data, offs = T.flat(column)
    w = T.Words(data, offs)
    assert [w.data[a:b].tobytes() for a, b in zip(w.start, w.end)] == [b"ab", b"cd", b"e", b"f"] and w.row.tolist() == [0, 1, 4, 4]
    assert len(T.Words(np.zeros(0, np.uint8), np.zeros(1, np.int64))) == 0


def test_grams_and_minima():
    rng = random.Random(2)
    x = np.array([rng.randrange(4) for _ in range(300)], np.uint64)
    g = T.grams(x, 3)
    seen = {}
    for i in range(298):
        assert seen.setdefault(tuple(x[i : i + 3]), int(g[i])) == int(g[i])
    assert len(set(seen.values())) == len(seen) and len(T.grams(x[:2], 3)) == 0
    for width in (1, 2, 3, 7, 65):
        assert T.sliding_min(x, width).tolist() == [int(min(x[i : i + width])) for i in range(301 - width)]


def test_pieces_and_ranges():
    offs = np.array([0, 5, 5, 30, 31, 33])
    rows = list(T.pieces(offs, 10))
    assert rows[0][0] == 0 and rows[-1][1] == 5 and all(a < b for a, b in rows) and [b for _, b in rows[:-1]] == [a for a, _ in rows[1:]]
    assert T.ranges(np.array([3, 9]), np.array([2, 3])).tolist() == [3, 4, 9, 10, 11]
    assert T.segments(np.array([1, 1, 2, 2, 2, 5])).tolist() == [0, 2, 5]
    a, b = unpack(pack(np.arange(3), np.array([], np.uint8)))
    assert a.tolist() == [0, 1, 2] and len(b) == 0
