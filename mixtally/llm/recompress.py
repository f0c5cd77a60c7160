"""Recompression: names of token runs and pairs that are the same wherever the tokens are.

A sequence of tokens is shortened level by level. At each level neighbours x, y whose bits read 0, 1 become one symbol; a run of one
token has alternating bits, counted from its end, so it becomes pairs. Whether two neighbours merge depends on nothing but them
(and what ends a run), so equal stretches get equal interior symbols in whatever document they stand. Each symbol keeps its extent:
the words that determine that it stands there. A stretch of text that holds the whole extent holds the symbol, and so does every
copy of that stretch.

Names are given globally: chunks send the distinct contents of their symbols (a word's bytes, a symbol's parts), buckets compare
them byte by byte, number what differs, and return the numbers, or 0 for what no two documents share (see `answer_names`). So
equal names mean equal words, without any trust in hashes, and what is 0 needs no further naming: nothing that holds it repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from . import chunks as C
from .textops import U64, mix, powers, ranges, span_hashes


def content(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The byte strings data[start : start + size], one after the other."""
    return strings(data[ranges(start, size)], size)


def strings(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """The byte strings of these sizes that data consists of."""
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def raw_parts(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, and where each begins (one more entry than strings)."""
    _, offsets, data = strings.buffers()
    offs = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as one number, without copying; of the last seven places none."""
    return np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))


#: The lowest so many bytes of a number, and how many bytes a word may have that is told by two numbers.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
SHORT = 15


def numbered(key: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray], spell: Callable[[np.ndarray], pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """An item of each content, ascending, and the number of each item's content.

    key is a hash of the contents: it says where in a table an item looks for its like, same(items, others) whether it is. Those
    that met another look again, and what is left after some rounds (contents of one hash) is told by its bytes, spell(items).
    """
    kind = np.int32 if len(key) < np.iinfo(np.int32).max else np.int64
    like = np.empty(len(key), kind)
    left = np.arange(len(key), dtype=kind)
    for salt in range(8):
        if not len(left):
            break
        bits = max(8, len(left).bit_length() + (2 if salt else 0))
        slot = ((mix(key[left] + U64(salt)) if salt else key) >> U64(64 - bits)).astype(np.int64)
        table = np.empty(1 << bits, kind)
        table[slot] = left
        other = table[slot]
        found = same(left, other)
        if found.all():
            like[left], left = other, left[:0]
        else:
            like[left[found]] = other[found]
            left = left[~found]
    if len(left):
        code = spell(left).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        other = np.empty(int(code.max()) + 1, kind)
        other[code] = left
        like[left] = other[code]
    number = np.zeros(len(key), kind)
    one = np.flatnonzero(like == np.arange(len(key), dtype=kind))
    number[one] = np.arange(len(one))
    return one, number[like]


class Distinct:
    """Distinct contents of a chunk's symbols: a symbol of each (`one`), and `code` of each symbol.

    key is a 64-bit hash of each symbol's content, the same in all chunks; same and spell are those of `numbered`.
    """

    def __init__(self, key: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray], spell: Callable[[np.ndarray], pa.Array], document: np.ndarray):
        self.one, self.code = numbered(key, same, spell)
        self.key, self.spell, self.document = key[self.one], spell, document

    def many(self) -> np.ndarray:
        """Whether several documents of the chunk have it, of each content."""
        return np.bincount(self.code[self.document[self.one][self.code] != self.document], minlength=len(self.one)) > 0

    def dealing(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The order in which contents are sent, by bucket, and where each bucket's begin."""
        where = self.key % U64(buckets)
        where = where.astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # short numbers are sorted by radix
        order = np.argsort(where, kind="stable")
        return order, np.concatenate([[0], np.cumsum(np.bincount(where, minlength=buckets))])

    def questions(self, chunk: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
        order, bounds = self.dealing(buckets)
        raw, offs = raw_parts(self.spell(self.one[order]))
        size, many = np.diff(offs).astype(np.uint32), self.many()[order]
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = slice(bounds[b], bounds[b + 1])
            yield chunk, b, C.pack(size[own], raw[offs[own.start] : offs[own.stop]], np.packbits(many[own]))

    def names(self, replies: list[bytes], buckets: int) -> np.ndarray:
        """The name of each symbol; 0 where it is no other document's."""
        order, bounds = self.dealing(buckets)
        out = np.zeros(len(self.one), np.uint64)
        for reply in replies:
            bucket, shared, name = C.unpack(reply)
            own = order[bounds[bucket[0]] : bounds[bucket[0] + 1]]
            out[own[np.unpackbits(shared, count=len(own)).astype(bool)]] = name
        return out[self.code]


def distinct_words(data: np.ndarray, start: np.ndarray, size: np.ndarray, document: np.ndarray) -> Distinct:
    """Words data[start : start + size]. Up to SHORT bytes are two numbers, the second with the size; longer ones are numbered by their bytes."""
    every = eights(np.append(data, np.zeros(16, np.uint8)))
    low = every[start] & _LOW[np.minimum(size, 8)]
    high = size.astype(np.uint64) << U64(56)
    own = np.flatnonzero((size > 8) & (size <= SHORT))
    high[own] |= every[start[own] + 8] & _LOW[size[own] - 8]
    key = mix(low * U64(0x9E3779B97F4A7C15) + high * U64(0xC2B2AE3D27D4EB4F) + (high >> U64(56)))

    def spell(items: np.ndarray) -> pa.Array:
        return content(data, start[items], size[items])

    own = np.flatnonzero(size > SHORT)
    if len(own):
        found = spell(own).dictionary_encode()
        code = found.indices.to_numpy(zero_copy_only=False)
        low[own], high[own] = code.astype(np.uint64), U64(255 << 56)
        key[own] = span_hashes(*raw_parts(found.dictionary))[code]
    return Distinct(key, lambda a, b: (low[a] == low[b]) & (high[a] == high[b]), spell, document)


def answer_names(buckets: int):
    """Resolves contents to names: the same for equal bytes, different for others, above 0, and told only if two documents of one chunk
    or two chunks have them. Rows of one doc_id in two chunks so give names that no other document has: work, but no other result."""

    def resolve(bucket: int, asked: list[tuple[int, list[np.ndarray]]]) -> Iterable[tuple[int, bytes]]:
        size = np.concatenate([a[0] for _, a in asked]).astype(np.int64)
        every = strings(np.concatenate([a[1] for _, a in asked]), size).dictionary_encode()
        code = every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        many = np.concatenate([np.unpackbits(a[2], count=len(a[0])) for _, a in asked])
        shared = np.bincount(code, weights=1 + many, minlength=len(every.dictionary)) > 1
        # Numbers of buckets interleave, so that no two buckets give one.
        name = (np.cumsum(shared) - 1) * buckets + bucket + 1
        at = 0
        for chunk, a in asked:
            own = code[at : at + len(a[0])]
            at += len(a[0])
            yield chunk, C.pack(np.array([bucket]), np.packbits(shared[own]), name[own[shared[own]]].astype(np.uint32 if name.max(initial=0) < 1 << 32 else np.uint64))

    return resolve


#: Symbols that are parsed at once, as far as there is a gap between: their arrays stay in the processor's cache.
BLOCK = 1 << 14


def shifted(values: np.ndarray) -> np.ndarray:
    """The next entry of each, 0 behind the last."""
    out = np.zeros_like(values)
    out[:-1] = values[1:]
    return out


def lagged(values: np.ndarray) -> np.ndarray:
    """The entry before each, 0 before the first."""
    out = np.zeros_like(values)
    out[1:] = values[:-1]
    return out


class Parse:
    """Symbols of a sequence: `start`, `size` in words, `hash` of content, and the extent `low` to `high` that determines them.

    `name` is that of each base symbol, `at` and `parts` say which base symbols a symbol consists of. `after` tells whether a
    symbol follows without a gap: documents' ends and tokens without a name are gaps. Where a symbol stands beside one, `gap_low` and
    `gap_high` tell how far one must see to know it.
    """

    #: What a symbol has.
    FIELDS = ("start", "size", "hash", "low", "high", "gap_low", "gap_high", "after", "at", "parts")

    def __init__(self, names: np.ndarray, row: np.ndarray):
        own = np.flatnonzero(names)
        after = np.zeros(len(own), bool)
        if len(own):
            after[:-1] = (np.diff(own) == 1) & (row[own[1:]] == row[own[:-1]])
        self.after = after
        self.hash = mix(names[own])
        self._base(names[own])
        if len(names) < np.iinfo(np.int32).max - 2:
            own = own.astype(np.int32)
        self.start, self.size = own, np.ones_like(own)
        self.low, self.high = own.copy(), own + 1
        self.gap_low, self.gap_high = own - 1, own + 2

    def _base(self, names: np.ndarray) -> None:
        kind = np.int32 if len(names) < np.iinfo(np.int32).max else np.int64
        self.name, self.at, self.parts = names, np.arange(len(names), dtype=kind), np.ones(len(names), kind)

    def levels(self, first: int, count: int, runs: bool = False) -> None:
        """Levels first, first + 1 and so on, the first of them with runs if so asked. Gaps part the sequence into blocks, which are parsed one by one."""
        n = len(self.hash)
        cut = np.flatnonzero(~self.after) + 1
        cut = np.unique(cut[np.minimum(np.searchsorted(cut, np.arange(BLOCK, n + BLOCK, BLOCK)), len(cut) - 1)]).tolist() if n else []
        done = []
        for begin, end in zip([0, *cut], cut):
            part = object.__new__(Parse)
            for field in self.FIELDS:
                setattr(part, field, getattr(self, field)[begin:end])
            for k in range(count):
                part.level(first + k, runs and k == 0)
            done.append(part)
        for field in self.FIELDS if done else ():
            setattr(self, field, np.concatenate([getattr(part, field) for part in done]))

    def rebased(self, names: np.ndarray, stay: np.ndarray) -> Parse:
        """The symbols as base symbols with these names; those that don't stay become gaps, on which their neighbours depend."""
        n = len(stay)
        gap_low, gap_high = self.gap_low.copy(), self.gap_high.copy()
        gone = np.flatnonzero(~stay)
        right = gone[gone > 0]
        right = right[self.after[right - 1]]
        gap_high[right - 1] = self.high[right]
        left = gone[gone < n - 1]
        left = left[self.after[left]]
        gap_low[left + 1] = self.low[left]
        after = self.after.copy()
        after[:-1] &= stay[1:]
        out = object.__new__(Parse)
        at = np.flatnonzero(stay)
        out.start, out.size, out.hash, out.low, out.high, out.after = self.start[at], self.size[at], self.hash[at], self.low[at], self.high[at], after[at]
        out.gap_low, out.gap_high = gap_low[at], gap_high[at]
        out._base(names[at])
        return out

    def level(self, salt: int, runs: bool = False) -> None:
        """One level of recompression: neighbours whose bits read 0, 1 become one.

        With runs, the members of a run of one symbol but the last have bits 0, 1, 0, ... backward from its end, so that runs pair up too.
        """
        n = len(self.hash)
        if not n:
            return
        after, low, high = self.after, self.low, self.high
        bit = ((self.hash >> U64(salt % 64)) & U64(1)) != 0
        if runs:
            # A symbol knows its bit once what follows its run is known.
            follow = shifted(high)
            ends = np.flatnonzero(~after)
            follow[ends] = self.gap_high[ends]
            same = np.zeros(n, bool)  # followed by its like
            same[:-1] = (self.hash[1:] == self.hash[:-1]) & after[:-1]
            high = np.maximum(high, follow)
            own = np.flatnonzero(same)
            if len(own):
                tail = np.flatnonzero(~same)
                tail = tail[np.searchsorted(tail, own)]
                bit[own] = (tail - own) % 2 == 0
                high[own] = np.maximum(self.high[own], follow[tail])
        pair = np.zeros(n, bool)
        pair[:-1] = ~bit[:-1] & bit[1:] & after[:-1]
        at = np.flatnonzero(~lagged(pair))
        two, one = pair[at], bit[at]
        last = at + two
        # A symbol of bit 0 stays alone because of what follows it, one of bit 1 because of what comes before: that was seen with
        # its bit, which with runs depends on what follows it. The first of a pair has bit 0, so both cases look the same way.
        beside = at + 1 - 2 * one
        beside[-1] = min(beside[-1], n - 1)
        new_low, new_high = np.minimum(low[at], low[last - one]), np.maximum(high[at], high[beside])
        own = np.flatnonzero(one & ~lagged(after)[at])
        new_low[own], new_high[own] = np.minimum(low[at[own]], self.gap_low[at[own]]), high[at[own]]
        own = np.flatnonzero(~(one | after[at]))
        new_high[own] = np.maximum(high[at[own]], self.gap_high[at[own]])
        own = np.flatnonzero(two)
        first = at[own]
        hashes = self.hash[at]
        hashes[own] = mix(self.hash[first] * U64(3) + self.hash[first + 1] * U64(0xC2B2AE3D27D4EB4F))
        start = self.start[at]
        self.size = (self.start + self.size)[last] - start
        parts = self.parts[at]
        parts[own] += self.parts[first + 1]
        self.low, self.high, self.hash, self.start, self.parts = new_low, new_high, hashes, start, parts
        self.after, self.gap_low, self.gap_high, self.at = after[last], self.gap_low[at], self.gap_high[last], self.at[at]

    def made(self, most: int) -> np.ndarray:
        """The symbols of more than one base symbol whose extents are of `most` words at most: no window of so many shows others."""
        return np.flatnonzero((self.parts > 1) & (self.high - self.low <= most))

    def contents(self, own: np.ndarray) -> pa.Array:
        """The names of these symbols' base symbols, as bytes."""
        return strings(self.name[ranges(self.at[own], self.parts[own])].view(np.uint8), self.parts[own] * 8)

    def distinct(self, own: np.ndarray, document: np.ndarray) -> Distinct:
        """The contents of these symbols, which are in these documents."""
        at, parts, name = self.at[own], self.parts[own], self.name
        up, down = powers(len(name) + 1)
        sums = np.zeros(len(name) + 1, np.uint64)
        np.cumsum(mix(name) * up[: len(name)], out=sums[1:])
        key = mix((sums[at + parts] - sums[at]) * down[at] + parts.astype(np.uint64))

        def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            equal = parts[a] == parts[b]
            pairs = np.flatnonzero(equal & (a != b))
            k = 0
            while len(pairs):
                x, y = a[pairs], b[pairs]
                agree = name[at[x] + k] == name[at[y] + k]
                equal[pairs[~agree]] = False
                k += 1
                pairs = pairs[agree & (parts[x] > k)]
            return equal

        return Distinct(key, same, lambda items: self.contents(own[items]), document)


def shared_prefixes(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each row, for each length from 0 to its width, a number that rows of one group share if their first so many columns are equal."""
    n, width = rows.shape
    keys = np.ascontiguousarray(np.concatenate([group[:, None].astype(np.uint64), rows.astype(np.uint64)], axis=1).astype(">u8")).view(f"V{8 * (width + 1)}").ravel()
    order = np.argsort(keys, kind="stable")
    common = np.full(n, -1, np.int64)
    if n > 1:
        a, b = rows[order[1:]], rows[order[:-1]]
        differ = a != b
        common[1:] = np.where(group[order[1:]] != group[order[:-1]], -1, np.where(differ.any(axis=1), differ.argmax(axis=1), width))
    out = np.empty((n, width + 1), np.int64)
    for length in range(width + 1):
        out[order, length] = np.cumsum(common < length)
    return out
