"""The exchange between chunks: its rows, its relays, and its resting chunks."""

import numpy as np
import pytest

from mixtally.llm import bpe, substring_bytes, substring_words
from mixtally.llm import chunks as C
from tests.llm import plain


def packed(spark, n, monkeypatch):
    """About n chunks of a few documents."""
    monkeypatch.setattr(C.pack_documents, "__defaults__", ("text", 40))
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(9))) for i in range(2 * n)], "doc_id long, text string").repartition(3)
    return C.pack_documents(docs)


@pytest.mark.parametrize("fanout, buckets", [(512, 40), (4, 4), (4, 60), (2, 33)])
def test_every_key_is_answered(spark, monkeypatch, fanout, buckets):
    chunks = packed(spark, 30, monkeypatch)
    exchange = C.Exchange(chunks, buckets, fanout)

    def keys(table):
        return np.unique(np.array([hash_of(w) for t in table.column("text").to_pylist() for w in t.split(" ")], np.uint64))

    def hash_of(word):
        return int(word[1:]) * 0x9E3779B97F4A7C15 % (1 << 64)

    def resolve(bucket, asked):
        every, count = np.unique(np.concatenate([a[0] for _, a in asked]), return_counts=True)
        for chunk, a in asked:
            yield chunk, C.pack(np.array([bucket]), count[np.searchsorted(every, a[0])])

    replies = exchange.answer(exchange.ask(lambda chunk, table: C.dealt(chunk, keys(table), buckets)), resolve)

    def last(table, replies):
        own = keys(table)
        order, bounds = C.dealt_order(own, buckets)
        found = np.zeros(len(own), np.int64)
        for r in replies:
            b, n = C.unpack(r)
            found[order[bounds[b[0]] : bounds[b[0] + 1]]] = n
        import pyarrow as pa

        return pa.table({"key": pa.array(own.view(np.int64)), "n": pa.array(found)})

    rows = exchange.finish(replies, last, "key long, n long").collect()
    count = {}
    for r in rows:
        count[r.key] = count.get(r.key, 0) + 1
    assert rows and all(r.n == count[r.key] for r in rows)


def test_rows_grow_with_the_chunks(spark, monkeypatch):
    """Four times the chunks, and buckets with them, send about four times the rows, at every level."""
    rows = []
    for n in (16, 64):
        chunks = packed(spark, n, monkeypatch)
        count = chunks.count()
        exchange = C.Exchange(chunks, count, 4)
        rng = np.random.default_rng(1)
        keys = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        sent = []
        monkeypatch.setattr(C.Relays, "relay", lambda self, rows, place, real=C.Relays.relay: sent.append(rows.count()) or real(self, rows, place))
        last = exchange.ask(lambda chunk, table: C.dealt(chunk, keys, count))
        monkeypatch.undo()
        sent.append(last.count())
        assert all(x <= 4 * 1.5 * count for x in sent[:-1])
        rows.append((count, sum(sent) / len(sent)))
    assert rows[1][1] / rows[0][1] < 1.6 * rows[1][0] / rows[0][0]


def test_encoding_by_relays(spark, monkeypatch):
    """Byte-level BPE over several levels of relays: the same ids, and rows in proportion to the chunks."""
    import public_tokenizers
    import regex

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    monkeypatch.setattr(C, "FANOUT", 3)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 400)
    per_chunk, real = [], C.Relays.relay
    for n in (14, 56):
        docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(80))) for i in range(n)], "doc_id long, text string").repartition(n)
        sent = []
        monkeypatch.setattr(C.Relays, "relay", lambda self, rows, place, sent=sent: sent.append(rows.count()) or real(self, rows, place))
        got = {r.doc_id: r.ids for r in bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep_text=True).collect()}
        encode = bpe.encoder(ranks, public_tokenizers.PATTERN)
        assert got == {r.doc_id: [t for w in regex.findall(public_tokenizers.PATTERN, r.text) for t in encode(w.encode())] for r in docs.collect()}
        per_chunk.append(max(sent) / n)
    assert len(sent) >= 4 and per_chunk[1] < 1.6 * per_chunk[0]


def test_chunks_stay_where_they_are(spark, monkeypatch):
    chunks = packed(spark, 10, monkeypatch)
    exchange = C.Exchange(chunks, 12)
    replies = spark.range(5).selectExpr("id AS chunk", "CAST('x' AS BINARY) AS blob")
    plan = exchange.finish(replies, lambda table, own: None, "x long")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # of the replies


@pytest.mark.parametrize("fanout", [2, 5])
def test_dedup_by_relays(spark, monkeypatch, fanout):
    monkeypatch.setattr(C, "FANOUT", fanout)
    monkeypatch.setattr(C.pack_documents, "__defaults__", ("text", 300))
    rows = list(enumerate(plain.corpus(4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_words.remove_repeats(docs).collect()}
    assert got == {i: w for (i, _), w in zip(rows, plain.remove_words(rows))}
    found = {r.doc_id: bytes(r.kept) for r in substring_bytes.remove_repeated_bytes(docs).collect()}
    want = {r.doc_id: bytes(r.kept) for r in substring_bytes.remove_repeated_bytes(docs, hot=2).collect()}
    assert found == want


@pytest.mark.parametrize("fanout, chunks, buckets", [(512, 600, 600), (32, 900, 900), (4096, 600, 600)])
def test_a_relay_holds_what_a_chunk_sends(fanout, chunks, buckets):
    """Blobs of a group behind each level; with groups as wide as allowed a relay held 512 chunks' blobs to 512 buckets, nearly all there were."""
    from collections import Counter

    relays = C.Relays(chunks, buckets, fanout)
    assert relays.fanout <= fanout and relays.fanout**relays.levels >= buckets
    for level in range(1, relays.levels):
        place = relays.place(level)
        held = Counter(place(chunk << 32, bucket) for chunk in range(chunks) for bucket in range(buckets))
        assert max(held.values()) < 3 * buckets


def test_surroundings_are_resolved_in_slices(monkeypatch):
    """A bucket's symbols some rows at a time, with the same result: they were all resolved at once, whatever they took."""
    rng = np.random.default_rng(5)
    window, n = 13, 600
    asked = []
    for chunk in range(3):
        symbol = rng.integers(0, 60, n).astype(np.uint64)
        size, near = (symbol % np.uint64(3)).astype(np.int64) + 1, rng.integers(0, 3, n)  # a symbol's words are always as many
        far = near + rng.integers(0, 4, n)
        names = (rng.random(int((window - size - near + far).sum())) < 0.1).astype(np.uint32) + np.uint32(1)
        shape = np.stack([near, far, size], axis=1).astype(np.uint8).ravel()
        asked.append((chunk, [symbol, shape, substring_words.planes(names), np.array([4]), rng.integers(0, 9, n), np.ones(n, np.uint32), np.arange(n, dtype=np.uint32)]))
    asked = [(chunk, C.unpack(C.pack(*a))) for chunk, a in asked]
    resolve, seen, real = substring_words.answer_windows(window), [], substring_words.earlier_starts
    want = list(resolve(0, asked))
    monkeypatch.setattr(substring_words, "earlier_starts", lambda window, symbol, *a: seen.append(len(symbol)) or real(window, symbol, *a))
    monkeypatch.setattr(substring_words, "SLICE", 100)
    assert list(resolve(0, asked)) == want and len(seen) > 9 and max(seen) < 400


def test_runs_are_merged_in_slices(monkeypatch):
    """A bucket's runs some suffixes at a time, with the same result: they were all merged at once, whatever they took."""
    import pyarrow as pa

    texts = [t or "" for t in plain.corpus(4)]
    asked = []
    for chunk in range(3):
        own = texts[chunk::2]
        c = substring_bytes.Chunk(pa.table({"doc_id": pa.array(range(chunk * 1000, chunk * 1000 + len(own)), pa.int64()), "text": own}), "text", "doc_id")
        c.suffixes()
        asked += [(chunk, C.unpack(blob)) for _, _, blob in c.runs(chunk, 1)]
    want = list(substring_bytes._answer_windows(0, asked))
    seen, real = [], substring_bytes.merge_runs
    monkeypatch.setattr(substring_bytes, "merge_runs", lambda runs: seen.append(sum(len(r[0]) for r in runs)) or real(runs))
    monkeypatch.setattr(substring_bytes, "SLICE", 30)
    assert list(substring_bytes._answer_windows(0, asked)) == want and any(np.unpackbits(C.unpack(b)[1]).any() for _, b in want)
    assert len(seen) > 5 and max(seen) < sum(seen) / 3
