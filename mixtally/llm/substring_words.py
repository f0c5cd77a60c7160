"""Substring dedup over words by recompression.

Words and symbols are named globally, in Spark rounds, by comparing their contents (see recompress.py): equal names mean equal
words, and what no two documents share has no name.

1. Round one names words. A word of one document ends every repeat.
2. Round two: three levels of recompression make symbols of about 2.4 words, which are named by their words' names.
3. Round three: three more levels make symbols of about 5 words, named by the names of round two.
4. A window that shows a symbol without a name, its whole extent within the window, repeats nowhere. The others show their
   highest symbol (words, where no other lies within). It is the same wherever the window stands, so windows are verified there:
   chunks send the symbol with the names of the words around it that its windows reach, each different surrounding once, to the
   bucket of the symbol and the nearer words. A bucket sorts the surroundings, and windows that share the symbol and all names
   left and right are equal. Those that a document with a smaller doc_id has too are covered, and their words go.

Everything that is sent is distinct within a chunk, so shared passages and large groups of copies cost an entry for each chunk,
not for each copy, and no pairs are ever formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks as C
from .recompress import Distinct, Parse, answer_names, distinct_words, shared_prefixes, strings
from .textops import U64, Words, flat, mix, ranges, segments

#: Words in a window, and levels of recompression in a round.
WINDOW, LEVELS = 13, 3
#: Rows of a bucket that are resolved at a time, unless one symbol has more: what this takes is some 1 KB a row.
SLICE = 1 << 16
#: Order of a document without a doc_id: after all others, and never later than another.
LAST = np.iinfo(np.int64).max


def order_of(table: pa.Table, key: str) -> np.ndarray:
    column = table.column(key).cast(pa.int64())
    return np.asarray(column.fill_null(LAST), np.int64)


class Chunk:
    """A chunk's documents, and what it asks in each round."""

    def __init__(self, table: pa.Table, text: str, key: str, window: int, buckets: int):
        data, offs = flat(table.column(text))
        self.words = Words(data, offs)
        self.order, self.window, self.buckets = order_of(table, key), window, buckets
        self.document = self.order[self.words.row]

    def spelled(self) -> Distinct:
        w = self.words
        return distinct_words(w.data, w.start, w.end - w.start, self.document)

    def parsed(self, replies: list[bytes]) -> tuple[Parse, np.ndarray, Distinct]:
        """Symbols of round two, those that are named, and their contents."""
        self.name = self.spelled().names(replies, self.buckets)
        parse = Parse(self.name, self.words.row)
        parse.levels(1, LEVELS, runs=True)
        own = parse.made(self.window)
        return parse, own, parse.distinct(own, self.document[parse.start[own]])

    def parsed_again(self, first: list[bytes], second: list[bytes]) -> tuple[Parse, np.ndarray, Distinct]:
        """Symbols of round three; those of round two are in `low`."""
        parse, own, distinct = self.parsed(first)
        name = np.where(parse.parts == 1, parse.name[parse.at] * U64(2), 0).astype(np.uint64)
        found = distinct.names(second, self.buckets)
        name[own] = np.where(found > 0, found * U64(2) + U64(1), 0)
        self.low = parse, own, found
        parse = parse.rebased(name, name > 0)
        parse.levels(LEVELS + 1, LEVELS)
        own = parse.made(self.window)
        return parse, own, parse.distinct(own, self.document[parse.start[own]])

    def anchors(self, first: list[bytes], second: list[bytes], third: list[bytes]) -> None:
        """The symbol that each window shows which may repeat: of runs of such windows `place` (word), `size`, `symbol`, and the
        words `near` to `far` before it where the windows begin."""
        parse, own, distinct = self.parsed_again(first, second)
        found = distinct.names(third, self.buckets)
        n, window = len(self.words), self.window
        count = max(0, n - window + 1)
        step = np.zeros(count + 1, np.int64)

        def spoil(low: np.ndarray, high: np.ndarray) -> None:
            begin, end = np.maximum(0, high - window), np.minimum(low, count - 1) + 1
            own = begin < end
            np.add.at(step, begin[own], 1)
            np.add.at(step, end[own], -1)

        best = np.full(count, -1, np.int64)
        places, sizes, symbols = [], [], []
        base = 0
        for level, (p, at, name) in ((1, self.low), (2, (parse, own, found))):
            lone = at[name == 0]
            spoil(p.low[lone], p.high[lone])
            at, name = at[name > 0], name[name > 0]
            # The least of the names' hashes is shown, the first of equals: it is written last.
            by = np.lexsort((-p.start[at], ~mix(name)))
            at, name = at[by], name[by]
            begin, end = np.maximum(0, p.high[at] - window), np.minimum(p.low[at], count - 1) + 1
            length = np.maximum(0, end - begin)
            best[ranges(begin, length)] = np.repeat(np.arange(len(at)) + base, length)
            places.append(p.start[at])
            sizes.append(p.size[at])
            symbols.append(name * U64(4) + U64(level))
            base += len(at)
        lone = np.flatnonzero(self.name == 0)
        spoil(lone, lone + 1)
        whole = self.words.row[window - 1 :] == self.words.row[:count] if count else np.zeros(0, bool)
        start = np.flatnonzero(whole & (np.cumsum(step[:-1]) == 0)) if count else np.zeros(0, np.int64)
        chosen = best[start]
        bare = np.flatnonzero(chosen < 0)
        if len(bare):  # of the words, too, the least hash is shown
            name = mix(self.name)
            own = start[bare] + name[start[bare][:, None] + np.arange(window)].argmin(axis=1)
            own, inverse = np.unique(own, return_inverse=True)
            places.append(own)
            sizes.append(np.ones(len(own), np.int64))
            symbols.append(self.name[own] * U64(4))
            chosen[bare] = base + inverse
        place, size, symbol = (np.concatenate(x) for x in (places, sizes, symbols))
        # Runs of windows that show one symbol, in halves: those that reach further to its right, and those further to its left.
        before = place[chosen] - start
        right = before <= (window - size[chosen]) // 2
        new = np.ones(len(start), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1) | (right[1:] != right[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(start)) - 1 if len(head) else head
        chosen = chosen[head]
        self.place, self.size, self.symbol, self.right = place[chosen], size[chosen], symbol[chosen], right[head]
        self.far, self.near = before[head], before[tail] if len(head) else before[head]

    def surroundings(self) -> None:
        """Distinct surroundings of the anchors, a row each: `rows` (symbol, near, far, size, names right, names left), `entry` of each anchor."""
        n, width = len(self.place), self.window - 1
        after = self.window - self.size - self.near
        at = np.arange(width)
        name = np.append(self.name, np.uint64(0))
        last = len(self.name)
        right = name[np.where(at < after[:, None], np.minimum((self.place + self.size)[:, None] + at, last), last)]
        left = name[np.where(at < self.far[:, None], np.maximum(self.place[:, None] - 1 - at, 0), last)]
        rows = np.concatenate([self.symbol[:, None], np.stack([self.near, self.far, self.size], axis=1).astype(np.uint64), right, left], axis=1).astype(np.uint64)
        found = strings(rows.view(np.uint8).ravel(), np.full(n, rows.shape[1] * 8)).dictionary_encode()
        self.entry = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        m = len(found.dictionary)
        one = np.zeros(m, np.int64)
        one[self.entry[::-1]] = np.arange(n)[::-1]
        self.rows = rows[one]
        document = self.document[self.place]
        self.earliest = np.full(m, LAST)
        np.minimum.at(self.earliest, self.entry, document)
        half = self.right[one]
        # Dealt by the symbol and the half of its words that all its windows hold.
        words = (self.window - self.size[one] + 1) // 2
        where = mix(self.rows[:, 0] + half.astype(np.uint64))
        for k in range((self.window + 1) // 2):
            where = np.where(k < words, mix(where * U64(3) + np.where(half, self.rows[:, 4 + k], self.rows[:, 4 + width + k])), where)
        self.bucket = (where % U64(self.buckets)).astype(np.int64)

    def questions(self, chunk: int) -> Iterable[tuple[int, int, bytes]]:
        """Of each bucket's entries the rows without what is empty, the earliest document, and the anchors' places and documents."""
        width = self.window - 1
        order = np.argsort(self.bucket, kind="stable")
        bounds = np.searchsorted(self.bucket[order], np.arange(self.buckets + 1))
        by = np.argsort(self.entry, kind="stable")
        first = np.searchsorted(self.entry[by], np.arange(len(self.rows) + 1))
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = order[bounds[b] : bounds[b + 1]]
            rows = self.rows[own]
            near, far, size = (rows[:, k].astype(np.int64) for k in (1, 2, 3))
            held = np.concatenate([np.arange(width) < (self.window - size - near)[:, None], np.arange(width) < far[:, None]], axis=1)
            names = rows[:, 4:][held]
            names = names.astype(np.uint32) if names.max(initial=0) < 1 << 32 else names
            anchors = by[ranges(first[own], first[own + 1] - first[own])]
            yield chunk, b, C.pack(rows[:, 0], rows[:, 1:4].astype(np.uint8).ravel(), planes(names), np.array([names.itemsize]), self.earliest[own], (first[own + 1] - first[own]).astype(np.uint32), self.place[anchors].astype(np.uint32 if len(self.name) < 1 << 32 else np.uint64))


def planes(values: np.ndarray) -> np.ndarray:
    """The values' bytes, those of one weight together: the high ones are nearly all alike."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T) if len(values) else np.zeros(0, np.uint8)


def from_planes(raw: np.ndarray, size: int) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(f"<u{size}").ravel() if len(raw) else np.zeros(0, np.uint32)


def earlier_starts(window: int, symbol: np.ndarray, shape: np.ndarray, names: np.ndarray, earliest: np.ndarray) -> np.ndarray:
    """Of surroundings (near, far, size; names without what is empty), for each distance, whether the window so far before the symbol occurs in an earlier document."""
    width = window - 1
    near, far, size = shape.astype(np.int64).T
    held = np.concatenate([np.arange(width) < (window - size - near)[:, None], np.arange(width) < far[:, None]], axis=1)
    every = np.zeros(held.shape, np.uint64)
    every[held] = names
    group = np.unique(symbol, return_inverse=True)[1]
    right, left = (shared_prefixes(group, x) for x in (every[:, :width], every[:, width:]))
    found = np.zeros((len(symbol), window), bool)
    for before in range(window):
        own = np.flatnonzero((near <= before) & (before <= far))
        if not len(own):
            continue
        behind = window - size[own] - before
        one, inverse = np.unique(right[own, behind] * (len(symbol) + 1) + left[own, before], return_inverse=True)
        least = np.full(len(one), LAST)
        np.minimum.at(least, inverse, earliest[own])
        found[own, before] = least[inverse] < earliest[own]
    return found


def answer_windows(window: int):
    """Resolves anchors' surroundings: which of their windows occur in a document earlier than the chunk's earliest with that surrounding.

    Symbols are resolved some SLICE rows at a time: rows of different symbols have nothing to do with each other.
    """

    def resolve(bucket: int, asked: list[tuple[int, list[np.ndarray]]]) -> Iterable[tuple[int, bytes]]:
        symbol = np.concatenate([a[0] for _, a in asked])
        shape = np.concatenate([a[1].reshape(-1, 3) for _, a in asked])
        names = np.concatenate([from_planes(a[2], int(a[3][0])) for _, a in asked])
        earliest = np.concatenate([a[4] for _, a in asked])
        length = window - shape[:, 2].astype(np.int64) - shape[:, 0] + shape[:, 1]
        name = np.cumsum(length) - length
        found = np.zeros((len(symbol), window), bool)
        part = mix(symbol) % U64(max(1, -(-len(symbol) // SLICE)))
        order = np.argsort(part, kind="stable")
        at = segments(part[order])
        for begin, end in zip(at, np.append(at[1:], len(order))):
            own = order[begin:end]
            found[own] = earlier_starts(window, symbol[own], shape[own], names[ranges(name[own], length[own])], earliest[own])
        at = 0
        for chunk, a in asked:
            n = len(a[0])
            mine, count = found[at : at + n], a[5].astype(np.int64)
            # What is told: entries some windows of which are covered, or that the chunk itself has in several places.
            own = np.flatnonzero(mine.any(axis=1) | (count > 1))
            at += n
            first = np.cumsum(count) - count
            yield chunk, C.pack(np.packbits(mine[own]), a[1].reshape(-1, 3)[own].ravel(), a[4][own], a[5][own], a[6][ranges(first[own], count[own])])

    return resolve


def covered_words(words: Words, order: np.ndarray, replies: list[bytes], window: int) -> np.ndarray:
    """Which words lie under a covered window: those that the replies name, and all windows of an anchor behind its entry's earliest."""
    step = np.zeros(len(words) + 1, np.int64)
    for reply in replies:
        mask, shape, earliest, count, place = C.unpack(reply)
        count, place = count.astype(np.int64), place.astype(np.int64)
        near, far, _ = shape.reshape(-1, 3).astype(np.int64).T
        mask = np.unpackbits(mask, count=len(count) * window).reshape(-1, window).astype(bool)
        entry = np.repeat(np.arange(len(count)), count)
        later = order[words.row[place]] > earliest[entry]
        reach = (np.arange(window) >= near[:, None]) & (np.arange(window) <= far[:, None])
        hit, before = np.nonzero(np.where(later[:, None], reach[entry], mask[entry]))
        begin = place[hit] - before
        np.add.at(step, begin, 1)
        np.add.at(step, begin + window, -1)
    return np.cumsum(step[:-1]) > 0


def covered(docs: DataFrame, finish, schema: str, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """finish(table, words, covered words) of each chunk's documents, where a word is covered as `remove_repeats` says."""
    chunks = C.pack_documents(docs, text)
    buckets = C.bucket_count(chunks)
    exchange = C.Exchange(chunks, buckets)
    named = answer_names(buckets)

    def told(replies: list[bytes], tag: int) -> list[bytes]:
        return [r[1:] for r in replies if r[0] == tag]

    def first(chunk: int, table: pa.Table):
        return Chunk(table, text, key, window, buckets).spelled().questions(chunk, buckets)

    def second(chunk: int, table: pa.Table, replies: list[bytes]):
        return Chunk(table, text, key, window, buckets).parsed(replies)[2].questions(chunk, buckets)

    def third(chunk: int, table: pa.Table, replies: list[bytes]):
        return Chunk(table, text, key, window, buckets).parsed_again(told(replies, 1), told(replies, 2))[2].questions(chunk, buckets)

    def windows(chunk: int, table: pa.Table, replies: list[bytes]):
        c = Chunk(table, text, key, window, buckets)
        c.anchors(told(replies, 1), told(replies, 2), told(replies, 3))
        c.surroundings()
        return c.questions(chunk)

    one = exchange.answer(exchange.ask(first), named)
    two = exchange.answer(exchange.ask_again(one, second), named)
    both = C.tagged(one, 1).unionByName(C.tagged(two, 2))
    three = exchange.answer(exchange.ask_again(both, third), named)
    found = exchange.answer(exchange.ask_again(both.unionByName(C.tagged(three, 3)), windows), answer_windows(window))

    def last(table: pa.Table, replies: list[bytes]) -> pa.Table:
        words = Words(*flat(table.column(text)))
        return finish(table, words, covered_words(words, order_of(table, key), replies, window))

    return exchange.finish(found, last, schema)


def kept_texts(words: Words, gone: np.ndarray) -> list[bytes]:
    """Of each row, the words that stay, joined by one space."""
    keep = np.flatnonzero(~gone)
    row, start, end = words.row[keep], words.start[keep], words.end[keep]
    # Words that stay and have one space between them are copied together.
    new = np.ones(len(keep), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != end[:-1] + 1) | (words.data[end[:-1]] != 0x20)
    head = np.flatnonzero(new)
    begin, stop = start[head].tolist(), end[np.append(head[1:], len(keep))[: len(head)] - 1].tolist()
    raw = words.data.tobytes()
    bounds = np.searchsorted(row[head], np.arange(len(words.first))).tolist()
    return [b" ".join([raw[x:y] for x, y in zip(begin[a:b], stop[a:b])]) for a, b in zip(bounds[:-1], bounds[1:])]


def removed(words: Words, gone: np.ndarray) -> np.ndarray:
    """Of each row, how many words go."""
    return np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """The documents, all columns, with n_words, n_removed (long) and kept_text: words under a window of `window` words whose
    sequence also starts in a document with a smaller `key` are left out, and the others joined by one space.

    Words are [^\\x20\\x09-\\x0D]+. Windows never cross documents and are judged on the input. A null or empty text, or one of
    blanks, has no words and keeps the empty text; a document shorter than a window keeps all. Repeated rows, and different
    rows of one key, never remove each other's words; a row without a key comes after all that have one. The key must be an
    integer, or it is a TypeError. An empty table gives an empty result. A text of any length is treated whole, in one task, which
    takes some 20 bytes of memory for each of its bytes.
    """
    C.check_key(docs, key)
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c not in ("n_words", "n_removed", "kept_text"))
    docs = docs.drop("n_words", "n_removed", "kept_text")

    def rows(table: pa.Table, words: Words, hit: np.ndarray) -> pa.Table:
        texts = [t.decode("utf-8", "surrogateescape") for t in kept_texts(words, hit)]
        return table.append_column("n_words", pa.array(np.diff(words.first), pa.int64())).append_column("n_removed", pa.array(removed(words, hit), pa.int64())).append_column("kept_text", pa.array(texts, pa.string()))

    return covered(docs, rows, f"{fields}, n_words long, n_removed long, kept_text string", text, key, window)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Word windows of 13 that a smaller doc_id has too are removed from documents; the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def rows(table: pa.Table, words: Words, hit: np.ndarray) -> pa.Table:
        sha = [hashlib.sha256(t).hexdigest() for t in kept_texts(words, hit)]
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(np.diff(words.first), pa.int64()), "n_removed": pa.array(removed(words, hit), pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return covered(docs, rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")
