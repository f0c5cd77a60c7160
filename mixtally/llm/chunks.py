"""Chunks: batches of documents that answer questions about the whole corpus by exchanging packed keys.

An operator that asks "does this piece of text occur elsewhere?" for millions of pieces would drown in one shuffled row
for each. Here documents are first packed, once, into chunks of a few MB (`pack_documents`), dealt to partitions by the chunk's
number and written to the shared checkpoint folder, so that a lost executor or a changed row order can't alter them. The
checkpoint keeps its partitioning: afterwards questions and replies move, chunks never do.

In an exchange each chunk sends its distinct keys, sorted and packed by hash bucket, and gets an answer for each in the same
order; copies inside a chunk are already merged, so the hottest key of the corpus costs one entry a chunk. The number of
buckets follows the number of chunks, so a bucket's size doesn't grow with the corpus. Nor does a chunk's number of rows: it
sends one row to each of FANOUT groups of buckets at most, and relays, each for the rows of as many chunks to one group, send them
on to as many smaller groups, until a group is a bucket (`Exchange`). C chunks so send at most C * FANOUT rows at each of
log(buckets) / log(FANOUT) levels, and replies come back along the same way. Groups are as many as the levels need, not more: with f of
them, f ** levels being about the buckets, a relay holds f chunks' rows to one f-th of the buckets, as much as a chunk sends.
"""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtally.operators.settle import checkpoint_folder, checkpointed  # noqa: F401 - the corpus operators take both from here

#: Bytes of text in a chunk; a longer document is a chunk of its own, whole.
CHUNK_BYTES = 4 << 20
#: Bytes of an Arrow batch; a larger row is a batch of its own.
BATCH_BYTES = 8 << 20
#: Chunks for each bucket of an exchange, and groups of buckets that a chunk or a relay sends rows to.
CHUNKS_A_BUCKET, FANOUT = 4, 4096

PARTS = "slab long, place long, blob binary"
REPLIES = "chunk long, blob binary"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches to BATCH_BYTES, if they are as large as Spark leaves them.

    Batches of chunks or long documents would otherwise be of 64 MB, several times over in each task, off the heap.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(spark.conf.get(key)).lower() in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set(key, BATCH_BYTES)


def check_key(docs: DataFrame, key: str) -> None:
    """TypeError unless the key, whose order decides which document comes first, is an integer."""
    kind = dict(docs.dtypes)[key]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} is {kind}; it must be an integer")


def release() -> None:
    """Gives memory that a worker has freed back to the system: workers are kept for later tasks, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


_ZSTD = b"\x28\xb5\x2f\xfd"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, compressed unless they are few."""
    raw = pickle.dumps([(a.dtype.str, a.tobytes()) for a in arrays], 5)
    return zstandard.ZstdCompressor(level=1).compress(raw) if len(raw) > 512 else raw


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob) if blob[:4] == _ZSTD else blob
    return [np.frombuffer(raw, dtype) for dtype, raw in pickle.loads(raw)]


def to_blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def table_bytes(rows: pa.RecordBatch | pa.Table) -> int:
    return int(rows.nbytes)


def row_groups(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined or sliced to about `most` bytes of the column's text."""
    import pyarrow.compute as pc

    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        row = 0
        while row < batch.num_rows:
            base = int(ends[row - 1]) if row else 0
            end = min(batch.num_rows, int(np.searchsorted(ends, base + most - size, side="left")) + 1)
            held.append(batch.slice(row, end - row))
            size += int(ends[end - 1]) - base
            row = end
            if size >= most:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def pack_documents(docs: DataFrame, text: str = "text", most: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of the documents, with all their columns: (chunk, rows, blob), checkpointed in partitions by chunk. The chunk number is unique."""

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, rows in enumerate(row_groups(batches, text, most)):
            release()
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([first + k], pa.int64()), "rows": pa.array([rows.num_rows], pa.int32()), "blob": pa.array([to_blob(rows)], pa.binary())})

    spark = docs.sparkSession
    small_batches(spark)
    cores, parts = spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()
    if parts < cores:  # a small file: as many chunks as cores, at least
        docs = docs.repartition(cores)
    chunks = docs.mapInArrow(chunk, "chunk long, rows int, blob binary").repartition(2 * max(cores, parts), "chunk").sortWithinPartitions("chunk")
    # An adaptive plan doesn't say how its result is partitioned, and the checkpoint would be dealt out anew each time.
    key = "spark.sql.adaptive.enabled"
    adaptive = spark.conf.get(key)
    try:
        spark.conf.set(key, "false")
        return checkpointed(chunks)
    finally:
        spark.conf.set(key, adaptive)


def bucket_count(chunks: DataFrame, a_bucket: int = CHUNKS_A_BUCKET) -> int:
    """Buckets for an exchange between these (checkpointed) chunks."""
    return max(12, -(-chunks.count() // a_bucket))


def dealt(chunk: int, keys: np.ndarray, buckets: int, *values: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Rows of an exchange: the keys, sorted and distinct, and what goes with them, by bucket."""
    where = (keys >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(where, kind="stable")
    bounds = np.searchsorted(where[order], np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        own = order[bounds[b] : bounds[b + 1]]
        yield chunk, b, pack(keys[own], *(v[own] for v in values))


def dealt_order(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which `dealt` sends keys, and where each bucket's begin."""
    where = (keys >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(buckets + 1, dtype=np.uint64))


def batch_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def bundles(items: Iterable[tuple[int, int, bytes]], place: Callable[[int, int], tuple[int, int]]) -> pa.RecordBatch:
    """Rows of an exchange: of (chunk, bucket, blob), those for each (slab, place) together."""
    rows: dict[tuple[int, int], list] = {}
    for item in items:
        rows.setdefault(place(item[0], item[1]), []).append(item)
    return batch_of([(*where, pickle.dumps(own, 5)) for where, own in rows.items()], ["slab", "place", "blob"], [pa.int64(), pa.int64(), pa.binary()])


def opened(blobs: Iterable[bytes]) -> list[tuple[int, int, bytes]]:
    """The (chunk, bucket, blob) in some rows' bundles."""
    return [item for blob in blobs for item in pickle.loads(blob)]


def replies_in(blobs: Iterable[bytes]) -> list[bytes]:
    """The replies in a chunk's rows; those of `tagged` rows begin with the tag."""
    out = []
    for blob in blobs:
        tag = b"" if blob[:1] == b"\x80" else blob[:1]  # a pickle begins with 0x80
        out += [tag + item[2] for item in pickle.loads(blob[len(tag) :])]
    return out


class Relays:
    """The way of rows between `count` chunks and `buckets` buckets.

    Bundles of (chunk, bucket, blob) travel in rows (slab, place, blob). Behind level l the slab holds the chunks whose number
    (a hash, modulo their count) has the same quotient by `fanout` ** l, and the place the buckets with the same quotient by
    `fanout` ** (levels - l).
    """

    def __init__(self, count: int, buckets: int, fanout: int | None = None):
        self.count, self.buckets, self.levels = max(1, count), buckets, 1
        most = fanout or FANOUT
        while most**self.levels < buckets:
            self.levels += 1
        # No wider than these levels need: a relay then holds about as much as one chunk sends, be the buckets few or many.
        self.fanout = next(f for f in range(max(1, int(buckets ** (1 / self.levels)) - 1), most + 1) if f**self.levels >= buckets)

    def place(self, level: int) -> Callable[[int, int], tuple[int, int]]:
        """Where a chunk's rows for a bucket are behind a level, 1 to `levels`; behind the last all slabs are one."""
        wide, narrow, count = self.fanout**level, self.fanout ** (self.levels - level), self.count
        if level == self.levels:
            return lambda chunk, bucket: (0, bucket)
        return lambda chunk, bucket: ((chunk * 0x9E3779B97F4A7C15 >> 20) % count // wide, bucket // narrow)

    def back(self, level: int) -> Callable[[int, int], tuple[int, int]]:
        """Where a bucket's replies to a chunk are, on the way back, before that level; before the first, with their chunk."""
        return self.place(level) if level else lambda chunk, bucket: (chunk, 0)

    def relay(self, rows: DataFrame, place: Callable[[int, int], tuple[int, int]]) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([bundles(opened(table.column("blob").to_pylist()), place)])

        return rows.groupBy("slab", "place").applyInArrow(run, PARTS)

    def dealt(self, first: DataFrame) -> DataFrame:
        """Rows that chunks sent to `place(1)`, sent on until each bucket has its own."""
        for level in range(2, self.levels + 1):
            first = self.relay(first, self.place(level))
        return first

    def returned(self, last: DataFrame) -> DataFrame:
        """(chunk, blob) of rows that buckets sent to `back(levels - 1)`, sent on until each chunk has its own."""
        for level in range(self.levels - 2, -1, -1):
            last = self.relay(last, self.back(level))
        return last.selectExpr("slab AS chunk", "blob")


class Exchange(Relays):
    """An exchange of keys between checkpointed chunks: ask, answer, and finish with the replies."""

    def __init__(self, chunks: DataFrame, buckets: int, fanout: int | None = None):
        super().__init__(chunks.count(), buckets, fanout)
        self.chunks = chunks.select("chunk", "blob")

    def ask(self, questions: Callable[[int, pa.Table], Iterable[tuple[int, int, bytes]]]) -> DataFrame:
        """Rows of what each chunk sends, from its documents alone, by bucket."""
        place = self.place(1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
                    yield bundles(questions(chunk, from_blob(blob.as_py())), place)
                    release()

        return self.dealt(self.chunks.mapInArrow(run, PARTS))

    def ask_again(self, replies: DataFrame, questions: Callable[[int, pa.Table, list[bytes]], Iterable[tuple[int, int, bytes]]]) -> DataFrame:
        """Rows of what each chunk sends, from its documents and earlier replies, by bucket."""
        place = self.place(1)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            own = replies_in(right.column("blob").to_pylist())
            rows = [r for chunk, blob in zip(left.column("chunk").to_pylist(), left.column("blob").to_pylist()) for r in questions(chunk, from_blob(blob), own)]
            release()
            return pa.Table.from_batches([bundles(rows, place)])

        return self.dealt(self.chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, PARTS))

    def answer(self, parts: DataFrame, resolve: Callable[[int, list[tuple[int, list[np.ndarray]]]], Iterable[tuple[int, bytes]]]) -> DataFrame:
        """Replies (chunk, blob) of the buckets, checkpointed. resolve gets a bucket and its chunks' arrays in order of the chunk numbers."""
        back = self.back(self.levels - 1)

        def run(key: tuple, table: pa.Table) -> pa.Table:
            asked = sorted(opened(table.column("blob").to_pylist()), key=lambda x: x[0])
            bucket = key[0].as_py()
            rows = [(chunk, bucket, blob) for chunk, blob in resolve(bucket, [(chunk, unpack(blob)) for chunk, _, blob in asked])]
            release()
            return pa.Table.from_batches([bundles(rows, back)])

        return checkpointed(self.returned(parts.groupBy("place").applyInArrow(run, PARTS)))

    def finish(self, replies: DataFrame, last: Callable[[pa.Table, list[bytes]], pa.Table | None], schema: str) -> DataFrame:
        """The result rows of each chunk, from its documents and all replies."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [last(from_blob(blob), replies_in(right.column("blob").to_pylist())) for blob in left.column("blob").to_pylist()]
            release()
            return pa.concat_tables([x for x in out if x is not None])

        return self.chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def tagged(replies: DataFrame, tag: int) -> DataFrame:
    """Replies with a leading byte that tells them from those of another exchange."""
    return replies.select("chunk", F.concat(F.lit(bytes([tag])), F.col("blob")).alias("blob"))
