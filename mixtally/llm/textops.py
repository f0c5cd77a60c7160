"""Vectorised text primitives shared by the corpus operators.

Everything here works on one Arrow string column as a flat byte buffer plus row offsets, so a batch of documents
is tokenised and hashed by a handful of NumPy passes instead of a Python loop per word. Nulls count as empty text.
Hashes are 64 bits wide: equal inputs always get equal hashes; callers that need certainty compare the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the positional hash and its inverse modulo 2**64.
_ROOT = 0x9E3779B97F4A7C15
_ROOT_INV = pow(_ROOT, -1, 1 << 64)
#: Random 64-bit value of each byte, so that the positional hash isn't linear in the byte values.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

#: Word bytes for words [^\x20\x09-\x0D]+ .
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Word bytes for words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text whose A-Z are lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the multiplier and of its inverse, kept for the next batch."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, root, np.uint64))]) for root in (U64(_ROOT), U64(_ROOT_INV)))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xCA9B0C7EBA1DA115)
    return x ^ (x >> U64(32))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after the other, and where each row begins (one more entry than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer row stands alone, whole."""
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + most, side="right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


class Words:
    """The words of some rows: `start` and `end` in bytes, `row` of each, `first` word of each row (rows + 1 entries)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray = NON_SPACE, lower: bool = False):
        offs = offs - offs[0]
        self.data = LOWER[data] if lower else data
        self.offs = offs
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = table[self.data]
        change = inside[1:] != inside[:-1]
        edges = np.flatnonzero(change)
        start, end = edges[0::2], edges[1::2]
        # Two words that touch across a row boundary are one run above: split there.
        cut = offs[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(data))])
        if len(cut):
            cut = cut[inside[cut] & inside[cut + 1]]
            if len(cut):
                start = np.insert(start, np.searchsorted(start, cut), cut)
                end = np.insert(end, np.searchsorted(end, cut), cut)
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offs)
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        up, down = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def span_hashes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string's bytes: strings lie one after the other, offs says where each begins (one more entry)."""
    out = np.zeros(len(offs) - 1, np.uint64)
    for row, end in pieces(offs, 1 << 18):
        part, at = data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        sums = sums[at]
        out[row:end] = mix((sums[1:] - sums[:-1]) * down[at[:-1]] + np.diff(at).astype(np.uint64))
    return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries (len - n + 1 of them), of whatever rows they are."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive bytes."""
    return grams(_BYTE[data], n)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values (len - width + 1 of them), by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def segments(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in arrays sorted by them; one array or several."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(0, np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] of them, then those of start[1], and so on."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(count) - count
    return np.arange(total) - np.repeat(at - start, count)
