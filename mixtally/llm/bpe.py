"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Each chunk of documents splits its texts into pre-tokens and keeps their positions as one array of word numbers; its distinct
pre-tokens go, packed, to the bucket that their hash names, by way of relays (see `chunks.Relays`), so a chunk sends a row to each
of FANOUT groups of buckets at most, however many there are. A bucket encodes each distinct word once,
however many chunks sent it, and returns the ids to each sender, which puts them back by position. Decoding joins the
ids with the table of token bytes. A frequent word costs an entry for each chunk; texts themselves aren't shuffled,
only word numbers.

Texts are read twice, once for the words and once for their positions. Words and ids are paired by order, so each bucket's
reply carries a 128-bit digest of the words that it answers, which the second reading must have too; what isn't a plain
scan of files or checkpoints is checkpointed before.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks as C
from .textops import ranges

#: Bytes of text in a chunk: larger chunks send fewer words each, smaller ones take less memory.
CHUNK_BYTES = 8 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a .tiktoken file: a base64 token and a decimal rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def token_table(ranks: dict[bytes, int]) -> pa.Array:
    """Bytes of each id; ids without a token are null."""
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.large_binary())


def joined_bytes(ids: np.ndarray, ends: np.ndarray, table: pa.Array) -> tuple[bytes, np.ndarray]:
    """The ids joined with the table of token bytes: all bytes, and where those of ids[:ends[i]] end. An id without a token is an error."""
    if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) < len(table)):
        raise ValueError("an id isn't in the vocabulary")
    found = table.take(pa.array(ids))
    if found.null_count:
        raise ValueError("an id isn't in the vocabulary")
    _, offsets, data = found.buffers()
    offsets = np.frombuffer(offsets, np.int64)[found.offset : found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
    return data.to_pybytes() if data is not None else b"", offsets[ends]


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: adjacent parts whose join has the least rank merge first, leftmost first among equals."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[bytes], list[int]]:
    """Ids of one pre-token: by the tiktoken library where it is installed, else by merge_bytes."""
    try:
        import tiktoken
    except ImportError:
        return lambda word: merge_bytes(word, ranks)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def digest(words: list[bytes]) -> np.ndarray:
    """128 bits of some words in their order, as two numbers; lengths count."""
    import xxhash

    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    return np.frombuffer(xxhash.xxh3_128_digest(sizes.tobytes() + b"".join(words)), np.uint64)


def settled(docs: DataFrame) -> DataFrame:
    """docs, checkpointed if a second reading could give other rows or another order: if its plan shuffles or computes in Python."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return C.checkpointed(docs) if any(x in plan for x in ("Exchange", "Arrow", "Python", "Pandas")) else docs


def _split(docs: DataFrame, text: str, pattern: str, relays: C.Relays, positions: bool) -> DataFrame:
    """Of each chunk of documents its words for each bucket, in bundles (slab, place, blob), or the words by position, (chunk, blob, rest).

    Words are numbered as they first appear and sent in that order. With positions, the row holds the number of words of each
    text, the word numbers, the bucket of each word and each bucket's digest, and `rest` the documents' other columns.
    """
    import xxhash

    buckets, place = relays.buckets, relays.place(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        first = TaskContext.get().partitionId() << 32
        for k, rows in enumerate(C.row_groups(batches, text, CHUNK_BYTES)):
            number: dict[str, int] = {}
            found, sizes = [], []
            for t in rows.column(text):
                words = find(t.as_py() or "")
                if positions:
                    sizes.append(len(words))
                    found.append(np.fromiter([number.setdefault(w, len(number)) for w in words], np.uint32, len(words)))
                else:
                    number.update(dict.fromkeys(words))  # a known word keeps its place
            words = [w.encode() for w in number]
            where = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int32, len(words))
            order = np.argsort(where, kind="stable")
            bounds = np.searchsorted(where[order], np.arange(buckets + 1))
            dealt = [(b, [words[i] for i in order[bounds[b] : bounds[b + 1]]]) for b in np.flatnonzero(np.diff(bounds)).tolist()]
            if positions:
                ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
                # The numbers' bytes lie apart, lowest first: frequent words have low numbers, so the high bytes shrink.
                planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
                rest = C.to_blob(rows.drop_columns([text]) if rows.num_columns > 1 else pa.RecordBatch.from_arrays([pa.array([True] * rows.num_rows)], names=["_"]))
                yield C.batch_of([(first + k, C.pack(np.array(sizes, np.int64), planes, where.astype(np.uint32), np.concatenate([digest(own) for _, own in dealt] or [np.zeros(0, np.uint64)])), rest)], ["chunk", "blob", "rest"], [pa.int64(), pa.binary(), pa.binary()])
            else:
                yield C.bundles([(first + k, b, C.pack(np.fromiter(map(len, own), np.uint32, len(own)), np.frombuffer(b"".join(own), np.uint8))) for b, own in dealt], place)
            del number, found, words, where, dealt
            C.release()

    return docs.mapInArrow(run, "chunk long, blob binary, rest binary" if positions else C.PARTS)


def _encoded(parts: DataFrame, ranks, pattern: str, relays: C.Relays) -> DataFrame:
    """Bundles (chunk, blob) with the ids of the words that each chunk sent; each distinct word is encoded once."""
    back = relays.back(relays.levels - 1)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value, pattern)
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            out = []
            for chunk, bucket, blob in C.opened(batch.column("blob").to_pylist()):
                sizes, raw = C.unpack(blob)
                raw, ends = raw.tobytes(), np.cumsum(sizes, dtype=np.int64)
                words = [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                ids = []
                for word in words:
                    got = known.get(word)
                    if got is None:
                        got = known[word] = encode(word)
                    ids.append(got)
                counts = np.fromiter(map(len, ids), np.uint32, len(ids))
                out.append((chunk, bucket, C.pack(np.array([bucket]), counts, np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum())), digest(words))))
            yield C.bundles(out, back)

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return relays.returned(parts.groupBy("place").applyInArrow(run, C.PARTS))


class Encoded:
    """A chunk's encoded texts: `sizes` in words, word `number`s by position, and of each word its `ids` from `begin`, `count` of them."""

    def __init__(self, sizes: np.ndarray, planes: np.ndarray, where: np.ndarray, digests: np.ndarray, replies: list[list[np.ndarray]]):
        replies.sort(key=lambda r: int(r[0][0]))
        count = np.concatenate([r[1] for r in replies] or [np.zeros(0, np.uint32)]).astype(np.int64)
        answered = [np.array([r[0][0] for r in replies], np.int64), np.concatenate([r[3] for r in replies] or [np.zeros(0, np.uint64)])]
        if len(count) != len(where) or not np.array_equal(answered[0], np.unique(where)) or not np.array_equal(answered[1], digests):
            raise RuntimeError("the documents changed between two reads: checkpoint them first")
        self.sizes = sizes
        self.number = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        self.ids = np.concatenate([r[2] for r in replies] or [np.zeros(0, np.int32)])
        order = np.argsort(where, kind="stable")
        self.count, self.begin = np.empty_like(count), np.empty_like(count)
        self.count[order], self.begin[order] = count, np.cumsum(count) - count
        self.first = np.concatenate([[0], np.cumsum(sizes)])

    def texts(self) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for a, b in zip(self.first[:-1], self.first[1:]):
            own = self.number[a:b]
            yield self.ids[ranges(self.begin[own], self.count[own])]


def encoded(docs: DataFrame, finish: Callable[[pa.Table, Encoded], pa.Table], schema: str, ranks: dict[bytes, int], pattern: str, text: str) -> DataFrame:
    """finish(other columns, encoded texts) of each chunk of documents.

    The documents are read twice, for their words and for the words' positions. Scans of files give the same rows in the same
    order each time; other inputs are checkpointed first. A chunk whose words differ between the readings, in any bucket, in
    themselves or in their order, fails with an error instead of giving other texts' ids.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = settled(docs)
    ranks = spark.sparkContext.broadcast(ranks)  # a vocabulary, of fixed size
    parts = docs.rdd.getNumPartitions()
    relays = C.Relays(parts, max(12, parts))
    words, places = (_split(docs, text, pattern, relays, positions) for positions in (False, True))

    def run(table: pa.Table) -> pa.Table:
        replies, whole, rest = [], None, None
        for blob, other in zip(table.column("blob").to_pylist(), table.column("rest").to_pylist()):
            if other is not None:
                whole, rest = C.unpack(blob), C.from_blob(other)
            else:
                replies += [C.unpack(reply) for _, _, reply in C.opened([blob])]
        out = finish(rest, Encoded(*whole, replies))
        C.release()
        return out

    replies = _encoded(relays.dealt(words), ranks, pattern, relays).withColumn("rest", F.lit(None).cast("binary"))
    return places.unionByName(replies).groupBy("chunk").applyInArrow(run, schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep_text: bool = False, decoded: str | None = None) -> DataFrame:
    """The documents with n_tokens long and ids array<int>, as tiktoken's encode_ordinary of each whole text gives them.

    With `decoded`, a column of that name has the bytes (binary) that the ids decode to, as `decode` would add it.

    Each match of the pattern is encoded separately and no token is special. All other columns stay; the text goes, as the
    ids hold it, unless keep_text. A null or empty text has no ids. Repeated rows are encoded like any; an empty table
    gives an empty result. Columns named n_tokens or ids are replaced.
    """
    docs = docs.drop("n_tokens", "ids", *([decoded] if decoded else []))
    if keep_text:
        docs = docs.withColumn("__kept", docs[text])
    fields = [(c, t) for c, t in docs.dtypes if c != text]

    def rows(rest: pa.Table, found: Encoded) -> pa.Table:
        ids = list(found.texts())
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
        rest = rest.select([c for c, _ in fields]).append_column("n_tokens", pa.array(np.diff(offsets), pa.int64())).append_column("ids", values)
        if not decoded:
            return rest
        raw, ends = joined_bytes(ids, offsets, table.value)
        return rest.append_column(decoded, pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()))

    if not fields:
        raise ValueError("documents need a column besides the text")
    table = docs.sparkSession.sparkContext.broadcast(token_table(ranks))  # a vocabulary, of fixed size
    out = encoded(docs, rows, ", ".join(f"`{c}` {t}" for c, t in fields) + ", n_tokens long, ids array<int>" + (f", `{decoded}` binary" if decoded else ""), ranks, pattern, text)
    return out.withColumnRenamed("__kept", text) if keep_text else out


def decode(encoded_docs: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded_docs with the bytes (binary) of its ids joined with the table of token bytes. Null ids give null, none empty bytes.

    An id that the vocabulary doesn't have, or a null among the ids, is an error. A column named as `out` is replaced.
    """
    shared = encoded_docs.sparkSession.sparkContext.broadcast(token_table(ranks))  # a vocabulary, of fixed size
    docs = encoded_docs.drop(out)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{out}` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(ids)
            own = column.flatten()
            if own.null_count:
                raise ValueError("a null among ids")
            ends = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0), np.int64))])
            raw, ends = joined_bytes(own.to_numpy(zero_copy_only=False), ends, shared.value)
            texts = [None if null else raw[a:b] for a, b, null in zip(ends[:-1].tolist(), ends[1:].tolist(), column.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of documents, and their bytes decoded again, as digests."""
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    table = spark.sparkContext.broadcast(token_table(ranks))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def rows(rest: pa.Table, found: Encoded) -> pa.Table:
        # Of each distinct word, its ids in decimal and their bytes; documents join those of their words.
        flat = list(map(str, found.ids.tolist()))
        raw, ends = joined_bytes(found.ids, np.arange(len(found.ids) + 1), table.value)
        said, shown = [], []
        for a, b in zip(found.begin.tolist(), (found.begin + found.count).tolist()):
            said.append(",".join(flat[a:b]))
            shown.append(raw[ends[a] : ends[b]])
        n, sha_ids, sha_bytes = [], [], []
        for a, b in zip(found.first[:-1], found.first[1:]):
            own = found.number[a:b]
            n.append(int(found.count[own].sum()))
            own = own.tolist()
            sha_ids.append(hashlib.sha256(",".join([said[i] for i in own]).encode()).hexdigest())
            sha_bytes.append(hashlib.sha256(b"".join([shown[i] for i in own])).hexdigest())
        return pa.table({"doc_id": rest.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha_ids, pa.string()), "decoded_sha256": pa.array(sha_bytes, pa.string())})

    return encoded(docs, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", ranks, public_tokenizers.PATTERN, "text")
