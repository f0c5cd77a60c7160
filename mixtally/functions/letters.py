"""The catalogue's view of texts as bases, for whole Arrow batches: letters a to z become ACGTACGT..., all else goes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
#: Bytes of text and rows of tiles that are worked on at once.
PART, ROWS = 1 << 22, 1 << 12
#: The base of each byte of lower-case text, 0 for those that go (all of letters of several bytes).
BASE = np.zeros(256, np.uint8)
BASE[np.frombuffer(LETTERS.encode(), np.uint8)] = np.frombuffer(BASES.encode(), np.uint8)


def bases(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bases of all (lower-case) texts one after another, and where each text begins and ends in them. Null has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    found = BASE[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    kept = found != 0
    return found[kept], np.concatenate([[0], np.cumsum(kept)])[ends - ends[0]] if len(texts) > 1 else np.array([0, np.count_nonzero(kept)])


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose second column has some PART bytes, or one row."""
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, side="right")))
            yield batch.slice(at, to - at)
            at = to


def strings(letters: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """A string of `size` letters from each of the places `begin` on."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    text = np.empty(offsets[-1], np.uint8)
    for i in range(0, len(size), ROWS):
        a, b = offsets[i], offsets[min(i + ROWS, len(size))]
        text[a:b] = letters[np.arange(a, b) + np.repeat((begin - offsets[:-1])[i : i + ROWS], size[i : i + ROWS])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())


def dna(docs: DataFrame, key: str, text: str = "text", name: str = "d") -> DataFrame:
    """(key, name): the bases of each text, null for null."""

    def run(batches):
        for batch in parts(batches):
            letters, ends = bases(batch.column(1))
            out = pa.LargeStringArray.from_buffers(len(batch), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)).cast(pa.string())
            yield pa.record_batch([batch.column(0), pa.compute.if_else(batch.column(1).is_valid(), out, pa.scalar(None, pa.string()))], ["key", "d"])

    return mapped(docs, key, text, run, "d string").withColumnRenamed("d", name)


def tiles(docs: DataFrame, key: str, size: int, stride: int, least: int, text: str = "text") -> DataFrame:
    """(key, at, seq): each text's bases from every `stride`-th place on, `size` of them, where at least `least` are left."""

    def run(batches):
        for batch in parts(batches):
            letters, ends = bases(batch.column(1))
            lengths = np.diff(ends)
            n = np.where(lengths >= least, (lengths - least) // stride + 1, 0)
            row = np.repeat(np.arange(len(n)), n)
            at = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * stride
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(at), strings(letters, ends[row] + at, np.minimum(size, lengths[row] - at))], ["key", "at", "seq"])

    return mapped(docs, key, text, run, "at long, seq string")


def tile_counts(docs: DataFrame, key: str, stride: int, least: int, text: str = "text") -> DataFrame:
    """(key, n): how many tiles `tiles` cuts from each text, a row each, those without any too."""

    def run(batches):
        for batch in parts(batches):
            lengths = np.diff(bases(batch.column(1))[1])
            yield pa.record_batch([batch.column(0), pa.array(np.where(lengths >= least, (lengths - least) // stride + 1, 0))], ["key", "n"])

    return mapped(docs, key, text, run, "n long")


def mapped(docs: DataFrame, key: str, text: str, run, columns: str) -> DataFrame:
    """(key, columns) of what run makes of batches (key, text in lower case)."""
    kind = dict(docs.dtypes)[key]
    # Lower case as Spark has it: some letters of several bytes have a lower case of one.
    return docs.select(F.col(key).alias("key"), F.lower(text).alias("text")).mapInArrow(run, f"key {kind}, {columns}").withColumnRenamed("key", key)


#: The primes of xxhash64, of which Spark's function of that name is made.
P1, P2, P3, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
#: Letters as `sequences.normalise` sees them: bases in upper case, U as T, 0 for any other.
UPPER = np.zeros(256, np.uint8)
UPPER[np.frombuffer(b"ACGTUacgtu", np.uint8)] = np.frombuffer(b"ACGTTACGTT", np.uint8)


def _hashed(places: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """xxhash64 of int places on seeds."""
    h = (seeds + P5 + np.uint64(4)) ^ (places.astype(np.uint64) * P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * P2 + P3
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def normalised(texts: pa.Array, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as `sequences.normalise` gives them, one after another; where each begins and ends; and which letters were none of ACGTU.

    seeds: F.xxhash64(F.xxhash64(name)) of each text's name.
    """
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if len(raw) and raw.max() >= 128:  # a letter of several bytes is one place
        first = (raw & 0xC0) != 0x80
        raw, ends = raw[first], np.concatenate([[0], np.cumsum(first)])[ends]
    out = UPPER[raw]
    other = out == 0
    at = np.flatnonzero(other)
    for i in range(0, len(at), PART):
        part = at[i : i + PART]
        row = np.searchsorted(ends, part, side="right") - 1
        out[part] = np.frombuffer(b"ACGT", np.uint8)[(_hashed(part - ends[row], seeds[row]) & np.uint64(3)).astype(np.int64)]
    return out, ends, other


def replacement(docs: DataFrame, key: str, text: str, name) -> DataFrame:
    """(key, n_other, kept_md5, bases_only, repeatable) of normalised texts.

    How many letters were replaced, a digest of the result with N for these, whether there are bases only, and whether a text comes out
    the same when it is normalised alone and not with its neighbours.
    """

    def run(batches):
        for batch in parts(batches):
            texts, seeds = batch.column(1), batch.column(2).to_numpy().view(np.uint64)
            out, ends, other = normalised(texts, seeds)
            kept = np.where(other, np.uint8(ord("N")), out)
            rows = []
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                alone = normalised(texts.slice(i, 1), seeds[i : i + 1])[0]
                rows.append((int(np.count_nonzero(other[a:b])), hashlib.md5(kept[a:b]).hexdigest(), bool(np.isin(out[a:b], np.frombuffer(b"ACGT", np.uint8)).all()), bool(np.array_equal(alone, out[a:b]))))
            yield pa.record_batch([batch.column(0), *map(pa.array, zip(*rows))], ["key", "n_other", "kept_md5", "bases_only", "repeatable"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.xxhash64(name)).alias("seed"))
    return rows.mapInArrow(run, f"key {kind}, n_other long, kept_md5 string, bases_only boolean, repeatable boolean").withColumnRenamed("key", key)
