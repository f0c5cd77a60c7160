"""A sieve for windows: which of them may be k-mers of an index, told before anything is shuffled.

Nearly all windows of reads hit nothing, and a join would move each of them as a row. The index's k-mers set four bits each in a
filter, which every task has; a window of which one bit isn't set is no k-mer of the index. The few others are rows, and the join
with the index decides, so that the filter changes no result. Filters have at most 2 ** MOST_BITS bits; an index of more than
MOST_KMERS k-mers has none, and every window of it is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtally.functions import letters as L

MOST_BITS, MOST_KMERS = 28, 1 << 26
#: Odd numbers that spread codes over the filter, one for each bit that a k-mer sets.
SPREAD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
#: Letters whose windows are worked on at once, so that they stay in the cache.
BLOCK = 1 << 15
#: Bits of one row of the filter as `bitmap_construct_agg` makes it.
ROW_BITS = 1 << 15

CODES = np.full(256, 4, np.uint8)
CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)


@dataclass(frozen=True)
class Sieve:
    """The filter of an index's n k-mers, as a broadcast; bits is None if there is none."""

    k: int
    n: int
    log2: int
    bits: object | None


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all rows one after another, a byte each (0 for letters of several bytes), and where rows begin and end."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if len(raw) and raw.max() >= 128:
        first = (raw & 0xC0) != 0x80
        ends = np.concatenate([[0], np.cumsum(first)])[ends]
        raw = np.where(raw < 128, raw, 0).astype(np.uint8)[first]
    return raw, ends


def _codes(letters: np.ndarray, k: int) -> np.ndarray:
    """The canonical code of each window of letters 0 to 3: two bits a base, so the lesser code is the lesser k-mer."""
    ahead, back = letters.astype(np.uint64), (np.uint64(3) - letters).astype(np.uint64)
    n, width, done = len(letters) - k + 1, 1, 0
    one = two = None
    while True:  # windows of doubled width, put together to k
        if k & width:
            if one is None:
                one, two = ahead[:n], back[:n]
            else:
                one = (one << np.uint64(2 * width)) | ahead[done : done + n]
                two = two | (back[done : done + n] << np.uint64(2 * done))
            done += width
        if 2 * width > k:
            return np.minimum(one, two)
        shift = np.uint64(2 * width)
        ahead, back = (ahead[:-width] << shift) | ahead[width:], back[:-width] | (back[width:] << shift)
        width *= 2


def _slots(codes: np.ndarray, spread: np.uint64, log2: int) -> np.ndarray:
    return ((codes ^ (codes >> np.uint64(31))) * spread) >> np.uint64(64 - log2)


def _may_hold(codes: np.ndarray, bits: np.ndarray, log2: int) -> np.ndarray:
    """Places of the codes whose bits are all set."""
    left = None
    for spread in SPREAD:
        slots = _slots(codes if left is None else codes[left], spread, log2)
        kept = np.flatnonzero((bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
        left = kept if left is None else left[kept]
    return left


def _decoded(codes: np.ndarray, k: int) -> pa.Array:
    shifts = np.arange(2 * (k - 1), -1, -2, dtype=np.uint64)
    text = np.frombuffer(b"ACGT", np.uint8)[((codes[:, None] >> shifts) & np.uint64(3)).astype(np.uint8)]
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(np.arange(0, len(codes) * k + 1, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(text)))


def _passing(letters: np.ndarray, ends: np.ndarray, k: int, bits: np.ndarray | None, log2: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, code) of windows of bases that pass, a block of letters at a time."""
    for at in range(0, len(letters) - k + 1, BLOCK):
        part = CODES[letters[at : at + BLOCK + k - 1]]
        other = np.concatenate([[0], np.cumsum(part > 3)]) if part.max() > 3 else None
        codes = _codes(part & 3, k)
        left = np.arange(len(codes)) if bits is None else _may_hold(codes, bits, log2)
        if other is not None:
            left = left[other[left + k] == other[left]]
        row = np.searchsorted(ends, left + at, side="right") - 1
        inside = left + at + k <= ends[row + 1]
        left, row = left[inside], row[inside]
        if len(left):
            yield row, left + at - ends[row], codes[left]


def sieve(kmers: DataFrame, k: int) -> Sieve:
    """The filter of an index's k-mers (kmer), made of rows of bits that tasks have put together."""
    n = kmers.count()
    if n > MOST_KMERS:
        return Sieve(k, n, 0, None)
    log2 = min(MOST_BITS, max(15, (64 * n).bit_length()))

    def slots(batches):
        for batch in batches:
            letters, _ = _letters(batch.column(0))
            codes = _codes(CODES[letters] & 3, k)[::k] if len(letters) else np.zeros(0, np.uint64)
            # From 1: the functions of bitmaps count from there.
            yield pa.record_batch([pa.array(np.concatenate([_slots(codes, s, log2) for s in SPREAD]).astype(np.int64) + 1)], ["slot"])

    rows = kmers.select("kmer").mapInArrow(slots, "slot long").groupBy(F.bitmap_bucket_number("slot").alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("row"))
    bits = np.zeros((1 << log2) // 8, np.uint8)
    for r in rows.toLocalIterator():
        bits[(r.i - 1) * ROW_BITS // 8 : r.i * ROW_BITS // 8] = np.frombuffer(r.row, np.uint8)
    return Sieve(k, n, log2, kmers.sparkSession.sparkContext.broadcast(bits))


def windows(seqs: DataFrame, found: Sieve, key: str, seq: str = "seq") -> DataFrame:
    """(key, pos, kmer) of each window of bases that may be in the index, canonical, with positions from 0."""
    k, log2, shared = found.k, found.log2, found.bits

    def run(batches):
        bits = None if shared is None else shared.value
        for batch in batches:
            letters, ends = _letters(batch.column(1))
            for row, pos, codes in _passing(letters, ends, k, bits, log2):
                yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(pos.astype(np.int32)), _decoded(codes, k)], ["key", "pos", "kmer"])

    kind = dict(seqs.dtypes)[key]
    return seqs.select(F.col(key).alias("key"), F.coalesce(F.upper(seq), F.lit("")).alias("seq")).mapInArrow(run, f"key {kind}, pos int, kmer string").withColumnRenamed("key", key)


def tile_windows(docs: DataFrame, found: Sieve, key: str, size: int, stride: int, least: int, text: str = "text") -> DataFrame:
    """(key, at, kmer) of each window that may be in the index, of each tile that `letters.tiles` cuts from texts; at: the tile's place.

    Tiles overlap and are never made: a text's windows are sifted once, and those that pass belong to one tile or several.
    """
    k, log2, shared = found.k, found.log2, found.bits

    def rows(batch, bits):
        letters, ends = L.bases(batch.column(1))
        for row, pos, codes in _passing(letters, ends, k, bits, log2):
            for back in range((size - k) // stride + 1):
                at = (pos // stride - back) * stride
                own = np.flatnonzero((at >= 0) & (pos + k <= at + size) & (ends[row + 1] - ends[row] - at >= least))
                yield row[own], at[own], codes[own]

    def packed(batch, held):
        row, at, codes = (np.concatenate(x) for x in zip(*held))
        return pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(at), _decoded(codes, k)], ["key", "at", "kmer"])

    def run(batches):
        bits = None if shared is None else shared.value
        for batch in L.parts(batches):
            held, n = [], 0
            for found_rows in rows(batch, bits):
                held.append(found_rows)
                n += len(found_rows[0])
                if n >= BLOCK:
                    yield packed(batch, held)
                    held, n = [], 0
            if n:
                yield packed(batch, held)

    return L.mapped(docs, key, text, run, "at long, kmer string")


def touched(seqs: DataFrame, found: Sieve, key: str, seq: str = "seq") -> DataFrame:
    """(key, seq) of sequences with a window that may be in the index."""
    k, log2, shared = found.k, found.log2, found.bits

    def run(batches):
        bits = None if shared is None else shared.value
        for batch in batches:
            letters, ends = _letters(batch.column(1))
            hit = np.zeros(len(batch), bool)
            for row, _, _ in _passing(letters, ends, k, bits, log2):
                hit[row] = True
            yield batch.filter(pa.array(hit))

    kind = dict(seqs.dtypes)[key]
    return seqs.select(F.col(key).alias("key"), F.coalesce(F.upper(seq), F.lit("")).alias("seq")).mapInArrow(run, f"key {kind}, seq string").withColumnsRenamed({"key": key, "seq": seq})
