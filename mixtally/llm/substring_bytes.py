"""Substring dedup over bytes: sparse suffix runs, front-coded, exchanged and merged by loser trees that know prefixes.

A suffix array of a whole corpus has an entry for each byte, far more than can be exchanged. It is enough to sort the
suffixes at anchors: of the 65 grams of 36 bytes in each 100-byte window, the one with the least hash. Equal windows have
equal anchors at equal places, so a window occurs twice only if the suffixes at its anchors share their first 36 bytes.

1. Chunks exchange the hashes of their anchors' grams (3 % of the bytes); anchors that occur once are done with.
2. Each chunk sorts the suffixes at its remaining anchors (at most 100 bytes, and the at most 64 bytes before the anchor
   that a window can reach), merges equal ones and sends a sorted, front-coded run to each bucket: the length of the
   prefix shared with the suffix before, and the rest.
3. A bucket, the suffixes whose first 36 bytes hash there, merges its runs with a loser tree. A stream's common prefix
   with the last winner decides most matches without reading a byte, and otherwise reading starts behind it. The merge
   yields the order and each suffix's common prefix with the one before (the LCP array).
4. Windows that begin o bytes before an anchor are equal if the suffixes share 100 - o bytes, an LCP interval, and the o
   bytes before. All but the earliest of each such class are covered, and the chunks remove the bytes under them.

A gram of very many occurrences could bring a bucket as many different suffixes. The windows of grams that occur HOT times or
more are therefore dealt out by the hash of the whole window (and compared by 128 bits of two), each chunk sending the earliest of
each once.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks as C
from .substring_words import order_of
from .textops import _BYTE, U64, byte_grams, flat, mix, pieces, powers, ranges, segments, sliding_min

#: Bytes in a window, and in the gram at its anchor.
WINDOW, GRAM = 100, 36
#: Occurrences from which on a gram's windows are exchanged by their own hashes instead.
HOT = 100_000
#: Suffixes of a bucket that are merged at a time, unless more share a gram.
SLICE = 1 << 16
#: Grams in a window; an anchor has at most one byte less before it in a window.
PLACES = WINDOW - GRAM + 1


class Anchors:
    """Anchors of some rows: byte `at`, gram `key`, and the windows they anchor, which begin `near` to `far` bytes before them."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        offs = offs - offs[0]
        n = len(data)
        if n < WINDOW:
            self.at = self.near = self.far = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        grams = byte_grams(data, GRAM)
        value = np.maximum((grams >> U64(32)).astype(np.uint32), 1)  # 0 is left to windows that cross documents
        least = sliding_min(value, PLACES)
        crossing = np.zeros(n + 1, np.int32)
        ends = offs[1:-1]
        np.add.at(crossing, np.maximum(0, ends - WINDOW + 1), 1)
        np.add.at(crossing, ends, -1)
        least[np.cumsum(crossing, dtype=np.int32)[: len(least)] > 0] = 0
        padded = np.zeros(len(least) + 2 * (PLACES - 1), np.uint32)
        padded[PLACES - 1 : PLACES - 1 + len(least)] = least
        self.at = np.flatnonzero((~sliding_min(~padded, PLACES) == value) & (value > 0))
        self.key = grams[self.at]
        # An anchor's windows stand side by side, in one run of equal least values.
        run = segments(least)
        last = np.append(run[1:], len(least)) - 1
        low, high = np.searchsorted(self.at, run), np.searchsorted(self.at, last + PLACES - 1, side="right")
        count = np.where(least[run] > 0, high - low, 0)
        which, anchor = np.repeat(np.arange(len(run)), count), ranges(low, count)
        own = value[self.at[anchor]] == least[run[which]]
        which, anchor = which[own], anchor[own]
        self.near, self.far = np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.int64)
        self.near[anchor] = np.maximum(0, self.at[anchor] - last[which])
        self.far[anchor] = np.minimum(PLACES - 1, self.at[anchor] - run[which])


class Chunk:
    """A chunk's documents, their anchors and what it exchanges."""

    def __init__(self, table: pa.Table, text: str, key: str):
        self.data, self.offs = flat(table.column(text))
        self.order = order_of(table, key)
        found = []
        for a, b in pieces(self.offs, 1 << 20):
            x = Anchors(self.data[self.offs[a] : self.offs[b]], self.offs[a : b + 1])
            found.append((x.at + self.offs[a], x.key, x.near, x.far))
        self.at, self.key, self.near, self.far = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [()] * 4))
        self.key = self.key.astype(np.uint64)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams, sorted, and how often each occurs here."""
        return np.unique(self.key, return_counts=True)

    def keep(self, replies: list[bytes], buckets: int) -> None:
        """Forgets the anchors whose grams occur once, and sets the windows of those that are hot apart."""
        keys = self.grams()[0]
        order, bounds = C.dealt_order(keys, buckets)
        kind = np.zeros(len(keys), np.uint8)
        for reply in replies:
            bucket, codes = C.unpack(reply)
            kind[order[bounds[bucket[0]] : bounds[bucket[0] + 1]]] = codes
        kind = kind[np.searchsorted(keys, self.key)] if len(keys) else kind
        hot, stay = kind == 2, kind == 1
        count = (self.far - self.near + 1)[hot]
        self.windows = np.unique(np.repeat(self.at[hot], count) - ranges(self.near[hot], count))
        self.at, self.key, self.near, self.far = self.at[stay], self.key[stay], self.near[stay], self.far[stay]

    def hot(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows (128 bits of hashes, the first 64 and the second, sorted) of hot grams with the earliest place (key, start)
        of each; and the entry of each window."""
        up = powers(WINDOW)[0][:WINDOW]
        # The second hash weighs the same bytes by other numbers.
        other = mix(up + U64(77)) | U64(1)
        name, second = np.zeros((2, len(self.windows)), np.uint64)
        for a in range(0, len(name), 10_000):
            own = _BYTE[self.data[self.windows[a : a + 10_000][:, None] + np.arange(WINDOW)]]
            name[a : a + 10_000] = mix((own * up).sum(axis=1, dtype=np.uint64))
            second[a : a + 10_000] = mix((mix(own) * other).sum(axis=1, dtype=np.uint64))
        row = np.searchsorted(self.offs, self.windows, side="right") - 1
        self.window_doc, self.window_start = self.order[row], self.windows - self.offs[row]
        by = np.lexsort((self.window_start, self.window_doc, second, name))
        first = segments(name[by], second[by])
        entry = np.empty(len(name), np.int64)
        entry[by] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(by))))
        return name[by][first], second[by][first], self.window_doc[by][first], self.window_start[by][first], entry

    def suffixes(self) -> None:
        """Sorts the anchors' suffixes; equal ones become one entry. Sets entry (of each anchor), first (an anchor of each
        entry, the earliest), later (anchors behind the earliest of their entry) and rows (entries x (WINDOW + PLACES + 1))."""
        m = len(self.at)
        row = np.searchsorted(self.offs, self.at, side="right") - 1
        self.doc, self.start = self.order[row], self.at - self.offs[row]
        right, left = WINDOW - self.near, self.far
        wide = np.zeros((m, WINDOW + 2 + PLACES - 1), np.uint8)
        for j in range(WINDOW):
            live = np.flatnonzero(right > j)
            wide[live, j] = self.data[self.at[live] + j]
        # Both lengths come behind the suffix: a suffix that is the beginning of another goes first.
        wide[:, WINDOW], wide[:, WINDOW + 1] = right, left
        for j in range(PLACES - 1):
            live = np.flatnonzero(left > j)
            wide[live, WINDOW + 2 + j] = self.data[self.at[live] - 1 - j]
        self.wide = wide
        if not m:
            self.entry, self.first, self.later = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
            return
        by_place = np.lexsort((self.start, self.doc))
        text = np.ascontiguousarray(wide[by_place]).view(f"V{wide.shape[1]}").ravel()
        by = by_place[np.argsort(text, kind="stable")]
        same = (wide[by[1:]] == wide[by[:-1]]).all(axis=1)
        new = np.concatenate([[True], ~same])
        number = np.cumsum(new) - 1
        self.entry = np.empty(m, np.int64)
        self.entry[by] = number
        self.first = by[np.flatnonzero(new)]
        head = self.first[self.entry]
        self.later = (self.doc > self.doc[head]) | ((self.doc == self.doc[head]) & (self.start > self.start[head]))

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries, by bucket and in order, and where each bucket's begin."""
        where = (self.key[self.first] >> U64(20)) % U64(buckets)
        order = np.argsort(where, kind="stable")
        return order, np.searchsorted(where[order], np.arange(buckets + 1, dtype=np.uint64))

    def runs(self, chunk: int, buckets: int) -> Iterable[tuple[int, int, bytes]]:
        order, bounds = self.dealt(buckets)
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = self.first[order[bounds[b] : bounds[b + 1]]]
            right, left = self.wide[own, :WINDOW], self.wide[own, WINDOW + 2 :]
            size = (WINDOW - self.near[own]).astype(np.int64)
            prefix = np.zeros(len(own), np.int64)
            if len(own) > 1:
                differ = right[1:] != right[:-1]
                prefix[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), WINDOW), np.minimum(size[1:], size[:-1]))
            rest = right.ravel()[ranges(np.arange(len(own)) * WINDOW + prefix, size - prefix)]
            before = left.ravel()[ranges(np.arange(len(own)) * (PLACES - 1), self.far[own])]
            yield chunk, b, C.pack(prefix.astype(np.uint8), self.near[own].astype(np.uint8), self.far[own].astype(np.uint8), self.doc[own], self.start[own], rest, before)


def front_decoded(prefix: np.ndarray, size: np.ndarray, rest: np.ndarray) -> list[bytes]:
    raw, out, last, at = rest.tobytes(), [], b"", 0
    for p, n in zip(prefix.tolist(), size.tolist()):
        last = last[:p] + raw[at : at + n - p]
        at += n - p
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merges sorted runs of strings, each with the lengths of the prefix shared with the string before.

    Returns run, place in it, and the prefix shared with the string before, in merged order. A loser tree: each node keeps
    the loser of its match with the loser's common prefix with the winner that passed. Of two streams, the one sharing
    more with the last output is smaller; only on a tie are bytes read, from the end of the shared prefix on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    known = [0] * k
    place = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two streams; the loser's known prefix is then the one with the winner."""
        x, y = heads[a], heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = known[a], known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = min(len(x), len(y))
        differ = int.from_bytes(x[p:n], "big") ^ int.from_bytes(y[p:n], "big")
        if differ:
            same = n - (differ.bit_length() + 7) // 8
            if x[same] < y[same]:
                known[b] = same
                return a, b
            known[a] = same
            return b, a
        if len(x) < len(y) or len(x) == len(y) and a < b:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    losers = [0] * k
    level = list(range(k))
    at = k
    while len(level) > 1:
        at //= 2
        up = []
        for i in range(at):
            win, lose = play(level[2 * i], level[2 * i + 1])
            losers[at + i] = lose
            up.append(win)
        level = up
    champion = level[0]
    out_run, out_place, out_prefix = [], [], []
    while heads[champion] is not None:
        c = champion
        strings, prefixes = runs[c]
        i = place[c]
        out_run.append(c)
        out_place.append(i)
        out_prefix.append(known[c])
        i += 1
        place[c] = i
        if i < len(strings):
            heads[c], known[c] = strings[i], prefixes[i]
        else:
            heads[c], known[c] = None, 0
        node = (c + k) // 2
        while node:
            champion, losers[node] = play(champion, losers[node])
            node //= 2
    return out_run, out_place, out_prefix


def _answer_counts(bucket: int, asked: list[tuple[int, list[np.ndarray]]], hot: int) -> Iterable[tuple[int, bytes]]:
    """Of each gram: 0 if it occurs once in the corpus, 1 if more often, 2 if `hot` times or more."""
    keys = np.concatenate([a[0] for _, a in asked])
    distinct, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([a[1] for _, a in asked]), minlength=len(distinct))
    kind = ((total > 1).astype(np.uint8) + (total >= max(2, hot)))[inverse]
    at = 0
    for chunk, a in asked:
        yield chunk, C.pack(np.array([bucket]), kind[at : at + len(a[0])].astype(np.uint8))
        at += len(a[0])


def _answer_hot(bucket: int, asked: list[tuple[int, list[np.ndarray]]]) -> Iterable[tuple[int, bytes]]:
    """Of each window, whether it occurs before the chunk's own earliest."""
    name, second, doc, start = (np.concatenate([a[i] for _, a in asked]) for i in range(4))
    by = np.lexsort((start, doc, second, name))
    first = segments(name[by], second[by])
    head = np.empty(len(by), np.int64)
    head[by] = np.repeat(by[first], np.diff(np.append(first, len(by))))
    earlier = (doc > doc[head]) | ((doc == doc[head]) & (start > start[head]))
    at = 0
    for chunk, a in asked:
        yield chunk, C.pack(np.array([bucket]), np.packbits(earlier[at : at + len(a[0])]))
        at += len(a[0])


def earlier_windows(prefix: np.ndarray, near: np.ndarray, far: np.ndarray, left: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of suffixes in sorted order, for each distance o, whether the window o bytes before the anchor occurs earlier.

    prefix: the LCP array. left: the bytes before each anchor, nearest first. rank: dense, by document and place.
    """
    found = np.zeros((len(prefix), PLACES), bool)
    before = np.zeros(len(prefix), np.uint64)
    up = powers(PLACES)[0]
    for o in range(PLACES):
        if o:
            before += _BYTE[left[:, o - 1]] * up[o - 1]
        own = np.flatnonzero((near <= o) & (o <= far))
        if not len(own):
            continue
        same = np.cumsum(prefix < WINDOW - o)[own].astype(np.uint64)
        key = mix(mix(before[own]) + same * U64(0x9E3779B97F4A7C15))
        by = np.lexsort((rank[own], key))
        at = segments(key[by])
        first = np.repeat(rank[own][by][at], np.diff(np.append(at, len(by))))
        found[own[by], o] = rank[own][by] > first
    return found


def slices(strings: list[list[bytes]], most: int) -> list[list[int]]:
    """Where each sorted run is cut, a list for each run: slices of about `most` strings in all, of which no two share their first GRAM bytes."""
    step = max(1, most // max(1, len(strings)))
    some = sorted(s[:GRAM] for own in strings for s in own[step - 1 :: step])
    # As each run gives every step-th string, so many of them are `most` strings.
    pivots = sorted(set(some[len(strings) :: max(1, len(strings))]))
    return [[0, *(bisect_left(own, p) for p in pivots), len(own)] for own in strings]


def _answer_windows(bucket: int, asked: list[tuple[int, list[np.ndarray]]]) -> Iterable[tuple[int, bytes]]:
    """Merges the chunks' runs and tells each, for its entries in order, which windows occur earlier. Runs are merged a slice at a time."""
    strings, found = [], []
    for _, (prefix, near, *_, rest, _) in asked:
        strings.append(front_decoded(prefix.astype(np.int64), WINDOW - near.astype(np.int64), rest))
        found.append(np.zeros((len(near), PLACES), bool))
    first = [np.concatenate([[0], np.cumsum(a[2], dtype=np.int64)]) for _, a in asked]  # of the bytes before each anchor
    cuts = slices(strings, SLICE)
    for k in range(len(cuts[0]) - 1):
        part = [slice(c[k], c[k + 1]) for c in cuts]
        near, far, doc, start = (np.concatenate([a[i][p] for (_, a), p in zip(asked, part)]) for i in (1, 2, 3, 4))
        if not len(near):
            continue
        left = np.zeros((len(near), PLACES - 1), np.uint8)
        left.ravel()[ranges(np.arange(len(near)) * (PLACES - 1), far.astype(np.int64))] = np.concatenate([a[6][f[p.start] : f[p.stop]] for (_, a), f, p in zip(asked, first, part)])
        which, place, prefix = merge_runs([(own[p], a[0][p].tolist()) for own, (_, a), p in zip(strings, asked, part)])
        base = np.cumsum([0] + [p.stop - p.start for p in part])
        order = base[np.array(which, np.int64)] + np.array(place, np.int64)
        by = np.lexsort((start, doc))
        new = np.concatenate([[False], (doc[by][1:] != doc[by][:-1]) | (start[by][1:] != start[by][:-1])])
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(new)
        earlier = np.zeros((len(order), PLACES), bool)
        earlier[order] = earlier_windows(np.array(prefix, np.int64), near[order].astype(np.int64), far[order].astype(np.int64), left[order], rank[order])
        for own, p, b in zip(found, part, base):
            own[p] = earlier[b : b + p.stop - p.start]
    for (chunk, _), own in zip(asked, found):
        yield chunk, C.pack(np.array([bucket]), np.packbits(own))


def covered(docs: DataFrame, finish, schema: str, text: str = "text", key: str = "doc_id", hot: int = HOT) -> DataFrame:
    """finish(table, bytes, row offsets, covered bytes) of each chunk's documents, covered as `remove_repeated_bytes` says."""
    chunks = C.pack_documents(docs, text)
    buckets = C.bucket_count(chunks)

    def grams(chunk: int, table: pa.Table):
        keys, count = Chunk(table, text, key).grams()
        return C.dealt(chunk, keys, buckets, count.astype(np.uint32))

    def runs(chunk: int, table: pa.Table, replies: list[bytes]):
        c = Chunk(table, text, key)
        c.keep(replies, buckets)
        c.suffixes()
        yield from c.runs(chunk, buckets)
        name, second, doc, start, _ = c.hot()
        yield from ((chunk, buckets + b, blob) for chunk, b, blob in C.dealt(chunk, name, buckets, second, doc, start))

    # Buckets from `buckets` on are those of hot grams' windows.
    exchange = C.Exchange(chunks, 2 * buckets)
    many = exchange.answer(exchange.ask(grams), lambda bucket, asked: _answer_counts(bucket, asked, hot))
    earlier = exchange.answer(exchange.ask_again(many, runs), lambda bucket, asked: _answer_windows(bucket, asked) if bucket < buckets else _answer_hot(bucket, asked))

    def last(table: pa.Table, replies: list[bytes]) -> pa.Table:
        c = Chunk(table, text, key)
        c.keep([r[1:] for r in replies if r[0] == 1], buckets)
        c.suffixes()
        order, bounds = c.dealt(buckets)
        found = np.zeros((len(c.first), PLACES), bool)
        name, _, doc, start, entry = c.hot()
        hot_order, hot_bounds = C.dealt_order(name, buckets)
        before = np.zeros(len(name), bool)
        for reply in replies:
            if reply[0] == 2:
                bucket, bits = C.unpack(reply[1:])
                if bucket[0] >= buckets:
                    own = hot_order[hot_bounds[bucket[0] - buckets] : hot_bounds[bucket[0] - buckets + 1]]
                    before[own] = np.unpackbits(bits, count=len(own)).astype(bool)
                    continue
                own = order[bounds[bucket[0]] : bounds[bucket[0] + 1]]
                found[own] = np.unpackbits(bits, count=len(own) * PLACES).reshape(-1, PLACES).astype(bool)
        step = np.zeros(len(c.data) + 1, np.int32)
        late = np.flatnonzero(c.later)
        # The windows of an anchor behind its entry's earliest all occur earlier; they are one stretch.
        np.add.at(step, c.at[late] - c.far[late], 1)
        np.add.at(step, c.at[late] - c.near[late] + WINDOW, -1)
        rest = np.flatnonzero(~c.later)
        which, o = np.nonzero(found[c.entry[rest]])
        late = before[entry] | (c.window_doc > doc[entry]) | ((c.window_doc == doc[entry]) & (c.window_start > start[entry]))
        begin = np.concatenate([c.at[rest][which] - o, c.windows[late]])
        np.add.at(step, begin, 1)
        np.add.at(step, begin + WINDOW, -1)
        return finish(table, c.data, c.offs, np.cumsum(step[:-1]) > 0)

    return exchange.finish(C.tagged(many, 1).unionByName(C.tagged(earlier, 2)), last, schema)


def spans(gone: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: bytes removed, maximal removed runs; and where each byte's row ends a run."""
    total = np.concatenate([[0], np.cumsum(gone)])
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    starts = offs[:-1][np.diff(offs) > 0]
    begins[starts] = gone[starts]
    runs = np.concatenate([[0], np.cumsum(begins)])
    return np.diff(total[offs]), np.diff(runs[offs]), total


def kept_bytes(data: np.ndarray, offs: np.ndarray, gone: np.ndarray, total: np.ndarray) -> list[bytes]:
    raw = data[~gone].tobytes()
    at = offs - total[offs]
    return [raw[a:b] for a, b in zip(at[:-1], at[1:])]


def remove_repeated_bytes(docs: DataFrame, text: str = "text", key: str = "doc_id", hot: int = HOT) -> DataFrame:
    """The documents, all columns, with n_bytes, n_removed, n_spans (long), spans (the removed byte ranges) and kept (binary).

    Texts are UTF-8 bytes. Each byte under a 100-byte string that also starts earlier (smaller `key`, or the same key and an
    earlier start) is removed; strings are judged on the input. A null or empty text has no bytes; a text under 100 bytes
    keeps all. Rows of one key count as one document's copies: an equal start isn't earlier, so repeated rows never remove
    each other. A row without a key comes after all that have one. An empty table gives an empty result. `hot` is the number
    of occurrences from which on a gram's windows are dealt out one by one; the result doesn't depend on it. The key must be an integer,
    or it is a TypeError. A text of any length is treated whole, in one task, which takes some 50 bytes of memory for each of its bytes.
    """
    C.check_key(docs, key)
    new = ("n_bytes", "n_removed", "n_spans", "spans", "kept")
    docs = docs.drop(*new)
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def rows(table: pa.Table, data: np.ndarray, offs: np.ndarray, gone: np.ndarray) -> pa.Table:
        removed, runs, total = spans(gone, offs)
        edges = []
        for a, b in zip(offs[:-1], offs[1:]):
            change = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)))
            edges.append([{"begin": int(x), "end": int(y)} for x, y in zip(change[0::2], change[1::2])])
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for name, values in zip(new, (pa.array(np.diff(offs), pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(edges, span), pa.array(kept_bytes(data, offs, gone, total), pa.binary()))):
            table = table.append_column(name, values)
        return table

    return covered(docs, rows, f"{fields}{', ' if fields else ''}n_bytes long, n_removed long, n_spans long, spans array<struct<begin: long, end: long>>, kept binary", text, key, hot)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Byte windows of 100 that start earlier in documents too are removed; the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def rows(table: pa.Table, data: np.ndarray, offs: np.ndarray, gone: np.ndarray) -> pa.Table:
        removed, runs, total = spans(gone, offs)
        sha = [hashlib.sha256(x).hexdigest() for x in kept_bytes(data, offs, gone, total)]
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(offs), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return covered(docs, rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
