"""Recompression: names, and what windows show, against all windows of small corpora."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from mixtally.llm import chunks as C
from mixtally.llm import recompress
from mixtally.llm import substring_words as S
from tests.llm import plain

BUCKETS = 3


class Corpus:
    """Two chunks that exchange names without Spark."""

    def __init__(self, rows, window=13):
        self.window = window
        self.tables = [pa.table({"doc_id": pa.array([k for k, _ in rows[i::2]], pa.int64()), "text": pa.array([t for _, t in rows[i::2]], pa.string())}) for i in range(2)]
        named = recompress.answer_names(BUCKETS)
        one = self.round(lambda i: self.chunk(i).spelled().questions(i, BUCKETS), named)
        two = self.round(lambda i: self.chunk(i).parsed(one[i])[2].questions(i, BUCKETS), named)
        three = self.round(lambda i: self.chunk(i).parsed_again(one[i], two[i])[2].questions(i, BUCKETS), named)
        self.chunks = [self.chunk(i) for i in range(2)]
        for i, c in enumerate(self.chunks):
            c.anchors(one[i], two[i], three[i])
            w = c.words
            c.spelling = [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)]

    def chunk(self, i):
        return S.Chunk(self.tables[i], "text", "doc_id", self.window, BUCKETS)

    def round(self, questions, resolve):
        asked, replies = {}, {0: [], 1: []}
        for i in range(2):
            for _, b, blob in questions(i):
                asked.setdefault(b, []).append((i, C.unpack(blob)))
        for b, own in asked.items():
            for i, blob in resolve(b, own):
                replies[i].append(blob)
        return replies

    def shown(self):
        """(symbol, words before it, its size) of each window that may repeat, by chunk and place."""
        return {(i, int(p - o)): (int(s), int(o), int(m)) for i, c in enumerate(self.chunks) for p, m, s, near, far in zip(c.place, c.size, c.symbol, c.near, c.far) for o in range(near, far + 1)}

    def windows(self):
        out = {}
        for i, c in enumerate(self.chunks):
            for k in range(len(c.words) - self.window + 1):
                if c.words.row[k] == c.words.row[k + self.window - 1]:
                    out.setdefault(tuple(c.spelling[k : k + self.window]), []).append((i, k))
        return out


def corpora(seed):
    rng = random.Random(seed)
    if seed % 3 == 0:
        return plain.corpus(seed)
    words = ["a", "b"] if seed % 3 == 1 else ["the", "of", "cat", "é", "x1", "dog", "run"]
    texts = []
    for _ in range(40):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if rng.random() < 0.5:
            w[3:3] = [rng.choice(words)] * rng.randrange(1, 40)
        if texts and rng.random() < 0.5:
            other = rng.choice(texts).split(" ")
            at = rng.randrange(len(other))
            w[2:2] = other[at : at + 30]
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("seed", range(12))
def test_equal_windows_show_one_symbol(seed):
    """Every window that two documents have is kept, and shows the same symbol at the same place wherever it stands."""
    c = Corpus(list(enumerate(corpora(seed))), window=(13, 5, 9)[seed % 3 if seed > 5 else 0])
    shown = c.shown()
    for places in c.windows().values():
        if len({int(c.chunks[i].document[k]) for i, k in places}) > 1:
            assert len({shown.get(p) for p in places}) == 1 and places[0] in shown


def test_symbols_without_a_name_rule_windows_out():
    """Of prose with one shared passage, windows beside it aren't sent although all of their words are common."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(20)]
    passage = " ".join(rng.choice(words) for _ in range(200))
    for i in (3, 8, 11):
        texts[i] += " " + passage
    c = Corpus(list(enumerate(texts)))
    assert (np.concatenate([x.name for x in c.chunks]) > 0).mean() > 0.99
    shown, repeated = c.shown(), {p for places in c.windows().values() if len(places) > 1 for p in places}
    assert len(repeated) == 3 * 188 and repeated <= set(shown)
    assert len(shown) < 0.35 * sum(len(p) for p in c.windows().values())
    assert {s[0] % 4 for p, s in shown.items() if p in repeated} >= {1, 2}  # symbols of both rounds


def test_names_are_of_contents_not_of_hashes(monkeypatch):
    """Contents that all fall in one bucket still get names of their own; what one document of one chunk has gets none."""
    import xxhash

    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda raw: 7)
    c = Corpus([(0, "a b c d a"), (1, "b a x"), (2, "c y y"), (None, "")])
    names = {}
    for x in c.chunks:
        for w, n in zip(x.spelling, x.name.tolist()):
            names.setdefault(w, set()).add(n)
    assert all(len(v) == 1 for v in names.values())
    assert {w for w, v in names.items() if v == {0}} == {b"d", b"x", b"y"} and len({min(v) for w, v in names.items() if v != {0}}) == 3


@pytest.mark.parametrize("runs", [False, True])
def test_levels_cover_the_words_in_order(runs):
    rng = np.random.default_rng(3)
    names = rng.integers(0, 4, 500).astype(np.uint64)
    row = np.sort(rng.integers(0, 9, 500))
    p = recompress.Parse(names, row)
    for k in range(5):
        before = len(p.start)
        p.level(k + 1, runs and k == 0)
        assert len(p.start) <= before and (p.start[1:] >= p.start[:-1] + p.size[:-1]).all()
        assert p.size.sum() == (names > 0).sum() and (p.low <= p.start).all() and (p.high >= p.start + p.size).all()
        assert (row[p.start] == row[p.start + p.size - 1]).all() and (p.parts == p.size).all()
    long = recompress.Parse(np.full(64, 5, np.uint64), np.zeros(64, np.int64))
    long.level(1, runs=True)
    assert len(long.start) <= 33  # a run of one word becomes pairs


def test_naming_calls_nothing_for_each_word():
    """Dealing contents to buckets takes as many calls for 50,000 different words as for 500."""

    def calls(n):
        table = pa.table({"doc_id": pa.array([1], pa.int64()), "text": pa.array([" ".join(f"w{i}" for i in range(n))])})
        seen = 0

        def count(frame, event, arg):
            nonlocal seen
            seen += event in ("call", "c_call")

        sys.setprofile(count)
        try:
            asked = list(S.Chunk(table, "text", "doc_id", 13, BUCKETS).spelled().questions(0, BUCKETS))
        finally:
            sys.setprofile(None)
        assert sum(len(C.unpack(blob)[0]) for _, _, blob in asked) == n
        return seen

    assert calls(50_000) < 2 * calls(500)


def test_one_bucket_for_all_contents(monkeypatch):
    """Contents of one hash fall in one bucket and still get names of their own, in all three rounds."""
    passage = "a b c d e f g h i j k l m n o p"
    rows = [(0, f"{passage} q"), (1, f"r {passage}"), (2, "a a a b")]
    monkeypatch.setattr(recompress, "span_hashes", lambda raw, offs: np.zeros(len(offs) - 1, np.uint64))
    c = Corpus(rows)
    names = {}
    for x in c.chunks:
        for w, n in zip(x.spelling, x.name.tolist()):
            names.setdefault(w, set()).add(n)
    assert all(len(v) == 1 for v in names.values()) and {w for w, v in names.items() if v == {0}} == {b"q", b"r"}
    assert len({min(v) for v in names.values() if v != {0}}) == 16
    assert len([p for p in c.windows().values() if len(p) > 1]) == 4 and len(c.shown()) >= 8


def test_hashes_of_spans_are_those_of_their_bytes():
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"ab\x00\xff", k=rng.randrange(0, 6))) for _ in range(3000)] + [b"x" * 600_000, b"ab"]
    one = recompress.strings(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
    two = recompress.strings(np.frombuffer(b"".join(texts[::-1]), np.uint8), np.array([len(t) for t in texts[::-1]]))
    found = recompress.span_hashes(*recompress.raw_parts(one))
    assert (found == recompress.span_hashes(*recompress.raw_parts(two))[::-1]).all()
    assert len(set(found.tolist())) == len(set(texts))
    assert len(recompress.span_hashes(np.zeros(0, np.uint8), np.zeros(1, np.int64))) == 0


def test_parsing_takes_memory_for_blocks_not_for_all_symbols():
    """Of many short documents, a level's temporaries are those of one block: at most 130 bytes are held for each word at once."""
    import tracemalloc

    rng = np.random.default_rng(7)
    n = 400_000
    table = pa.table({"doc_id": pa.array(np.arange(n // 100), pa.int64()), "text": pa.array([" ".join(map(str, x)) for x in rng.integers(0, 5000, (n // 100, 100)).tolist()])})
    c = S.Chunk(table, "text", "doc_id", 13, BUCKETS)
    replies = []
    for _, b, blob in c.spelled().questions(0, BUCKETS):
        replies += [r for _, r in recompress.answer_names(BUCKETS)(b, [(0, C.unpack(blob))])]
    tracemalloc.start()
    try:
        parse = c.parsed(replies)[0]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(parse.name) == n and peak < 130 * n


@pytest.mark.parametrize("block", [1, 7, 60, 1 << 14])
def test_blocks_parse_as_the_whole_does(block, monkeypatch):
    monkeypatch.setattr(recompress, "BLOCK", block)
    for seed in range(40):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(0, 300))
        names, row = rng.integers(0, int(rng.integers(2, 30)), n).astype(np.uint64), np.sort(rng.integers(0, 9, n))
        one, two = recompress.Parse(names, row), recompress.Parse(names, row)
        for _ in range(2):
            for k in range(3):
                one.level(k + 1, runs=k == 0)
            two.levels(1, 3, runs=True)
            for field in recompress.Parse.FIELDS:
                assert getattr(one, field).tolist() == getattr(two, field).tolist()
            again = rng.integers(0, 4, len(one.hash)).astype(np.uint64)
            one, two = one.rebased(again, again > 0), two.rebased(again, again > 0)


@pytest.mark.parametrize("one_hash", [False, True])
def test_words_are_told_apart_by_all_their_bytes(one_hash, monkeypatch):
    """Words that differ in length, in NULs or in their last byte, of 1 to 40 bytes; also if all hashes are one."""
    if one_hash:
        monkeypatch.setattr(recompress, "mix", lambda x: np.zeros(len(x), np.uint64))
    rng = random.Random(3)
    words = [b"\0" * k for k in range(1, 20)] + [b"a" * k + t for k in range(40) for t in (b"a", b"b", b"\0", b"\xff")]
    words += rng.choices(words, k=300)
    rng.shuffle(words)
    size = np.array([len(w) for w in words])
    found = recompress.distinct_words(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size, np.arange(len(words)) // 50)
    spelled = [bytes(x) for x in found.spell(found.one).to_pylist()]
    assert len(set(spelled)) == len(spelled) and [spelled[c] for c in found.code] == words
    places = {}
    for k, w in enumerate(words):
        places.setdefault(w, set()).add(k // 50)
    assert found.many().tolist() == [len(places[w]) > 1 for w in spelled]


def test_kept_texts_have_one_space_between_words():
    from mixtally.llm.textops import Words, flat

    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "bc", " ", " ", "  ", "\n", "\t "]) for _ in range(rng.randrange(30))) for _ in range(200)] + ["", " ", "x"]
    words = Words(*flat(pa.array(texts)))
    gone = np.array([rng.random() < 0.3 for _ in range(len(words))])
    left = iter(gone.tolist())
    assert S.kept_texts(words, gone) == [" ".join(w for w in t.split() if not next(left)).encode() for t in texts]
    assert S.kept_texts(words, np.ones(len(words), bool)) == [b""] * len(texts)
