import public_tokenizers
import pytest
import tiktoken

from mixtally.llm import bpe, chat, decontaminate, divergence, license_scan, quality, warc
from tests.llm import plain

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_encode_and_decode(spark, ranks, tmp_path):
    texts = plain.corpus(1) + ["don't  stop\n\n  x", "\U0001f600 日本語   12345", "   ", "It's\r\n\t tabs", "<|endoftext|>", "a" * 5000]
    spark.createDataFrame([(i, t, 7, [1]) for i, t in enumerate(texts + texts[:3])], "doc_id long, text string, n_tokens int, ids array<int>").repartition(4).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep_text=True, decoded="again"), ranks).collect()}
    assert all(r.again == r.decoded for r in got.values())
    for i, t in enumerate(texts + texts[:3]):
        assert got[i].ids == enc.encode_ordinary(t or "") and got[i].n_tokens == len(got[i].ids) and bytes(got[i].decoded).decode() == (t or "") and got[i].text == t
    assert bpe.encode(docs.limit(0), ranks, public_tokenizers.PATTERN).collect() == []


def test_an_order_that_changes_between_readings(spark, ranks):
    """Rows that come in another order at each reading are settled first; a chunk whose words differ fails."""
    import random

    texts = plain.corpus(8)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def shuffled(batches):
        for pdf in batches:
            yield pdf.sample(frac=1, random_state=random.SystemRandom().randrange(1 << 30))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).mapInPandas(shuffled, "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}


@pytest.mark.parametrize("words", [[b"b", b"a"], [b"a", b"c"], [b"ab", b""], [b"a"]])
def test_a_reply_to_other_words_fails(words):
    import numpy as np

    def reply(own):
        return [np.array([0]), np.ones(len(own), np.uint32), np.arange(len(own), dtype=np.int32), bpe.digest(own)]

    asked = np.array([2]), np.zeros((4, 2), np.uint8), np.zeros(2, np.uint32), bpe.digest([b"a", b"b"])
    assert len(list(bpe.Encoded(*asked, [reply([b"a", b"b"])]).texts())) == 1
    with pytest.raises(RuntimeError, match="changed"):
        bpe.Encoded(*asked, [reply(words)])


def test_decoding_of_odd_ids(spark, ranks):
    rows = [(0, [1, 2]), (1, []), (2, None)]
    got = {r.k: r.decoded for r in bpe.decode(spark.createDataFrame([(*r, "x") for r in rows], "k int, ids array<int>, decoded string"), ranks).collect()}
    by = {v: k for k, v in ranks.items()}
    assert got == {0: by[1] + by[2], 1: b"", 2: None}
    for bad in ([10**9], [-1], [None]):
        with pytest.raises(Exception, match="vocabulary|null"):
            bpe.decode(spark.createDataFrame([(0, bad)], "k int, ids array<int>"), ranks).collect()


def test_merging_without_the_library(ranks):
    one = bpe.encoder(ranks, public_tokenizers.PATTERN)
    for w in (" the", "thntblere", "é", " éauxreé", "a" * 60, "\n\n", " 12345"):
        assert bpe.merge_bytes(w.encode(), ranks) == one(w.encode())


def test_op7(spark, ranks):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op7_byte_bpe(spark, D).collect()}
    for r in spark.read.parquet(f"{D}/documents.parquet").collect():
        ids = enc.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), plain.sha(",".join(map(str, ids))), plain.sha(r.text or ""))


@pytest.mark.parametrize("most", [10**6, 200])
def test_contamination(spark, monkeypatch, most):
    """In one block of items and in many."""
    texts = plain.corpus(3)
    rows = list(enumerate(texts)) + [(None, texts[4]), (0, texts[0])]
    items = [(i, " ".join((texts[i] or "").split()[2:30])) for i in range(0, 40, 3)] + [(100, "cat"), (101, "One"), (None, "the of"), (102, None), (103, "!!"), (0, " ".join((texts[0] or "").split()[2:30])), (104, "one")]
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (most,))
    docs = spark.createDataFrame([(k, t, i, "y") for i, (k, t) in enumerate(rows)], "doc_id long, text string, n int, items string").repartition(3)
    got = {r.n: r for r in decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, (n, hit, named) in enumerate(plain.contamination(rows, items)):
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"], r.n_items, r.contaminated) == (n, hit, named, len(named), hit > 0)
        inside = [w for s in r.spans for w in plain.ALNUM.findall(rows[i][1][s.begin : s.end])]
        assert len(inside) == hit
    assert decontaminate.find_contamination(docs.limit(0), docs.limit(0), item_key="doc_id").collect() == []
    assert decontaminate.find_contamination(docs, docs.limit(0), item_key="doc_id").where("contaminated").count() == 0


def test_base_counts(spark):
    texts = plain.corpus(5) + ["a b c\na b c\n\n a b c\nx", "# * & <>"]
    docs = spark.createDataFrame([(i, t, "en" if i % 3 else None, True) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept boolean").repartition(3)
    got = {r.doc_id: r for r in divergence.judge(docs).collect()}
    for i, t in enumerate(texts):
        want = plain.base_counts(t)
        assert tuple(got[i][c] for c in divergence.BASE) == want
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not got[i].base_failed or not got[i].kept)
        assert want[0] >= divergence.MIN_WORDS or got[i].class_distance is None
    assert divergence.judge(docs.limit(0)).collect() == []


def test_divergence_keeps_clean_text_and_rejects_junk(spark):
    d = "/root/testdata/sf0.01"
    rows = divergence.op5_divergence_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.3 * len(bad)
    assert all(r.class_distance is None or 0 <= r.class_distance <= 1 for r in rows)


def test_licenses(spark):
    t = license_scan.TEMPLATES
    mit = t["MIT grant"]
    texts = [f"é text before.\n{mit}\nafter", mit.replace("free of charge", "at no cost at all").upper(), t["MIT line"] + " x " + t["MIT line"], "all rights", None, "", "word " * 5000 + "All rights RESERVED!", mit[: len(mit) // 2]]
    docs = spark.createDataFrame([(i, x, 1.0) for i, x in enumerate(texts + texts[:1])], "doc_id long, text string, coverage double")
    got = {}
    for r in license_scan.scan_licenses(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
        assert (texts + texts[:1])[r.doc_id][r.begin : r.end] == r.matched and license_scan.LEAST_COVERAGE <= r.coverage <= 1
    assert {k: sorted(x.template for x in v) for k, v in got.items()} == {0: ["MIT grant"], 1: ["MIT grant"], 2: ["MIT line"] * 2, 6: ["all-rights-reserved"], 8: ["MIT grant"]}
    assert got[0][0].coverage == 1 and got[0][0].matched == mit.rstrip(":") and 0.85 < got[1][0].coverage < 1
    assert license_scan.scan_licenses(docs.limit(0)).collect() == []


def test_alignment_of_words():
    import numpy as np

    a = np.arange(20)

    def best(text):
        return max(zip(*(x.tolist() for x in license_scan.align(a, text))))

    assert best(np.concatenate([[99, 98], a, [97]])) == (20, 2, 22)
    assert best(np.concatenate([a[:7], [50, 51], a[7:]])) == (20, 0, 22)
    assert best(np.delete(a, [5, 6]))[0] == 18
    assert best(a[:3])[0] == 3


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    rows = quality.op1_quality_classifier(spark, d).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_quality_by_a_plain_loop(spark):
    """All scores of the query, from its model's dictionaries and weights, text by text and block by block."""
    import math

    import zstandard

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.fit_labels(docs, spark.read.parquet(f"{d}/labels.parquet"))

    def size(block, dictionary):
        own = zstandard.ZstdCompressionDict(dictionary)
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress(block))

    for r in quality.op1_quality_classifier(spark, d).join(docs.select("doc_id", "text"), "doc_id").collect():
        raw = (r.text or "").encode()
        if len(raw) > 40 * quality.BLOCK:
            continue  # each block builds its dictionary anew here: texts of 10 KB and less are enough
        blocks = [raw[i : i + quality.BLOCK] for i in range(0, len(raw), quality.BLOCK)]
        differ = sorted((size(b, model.bad) - size(b, model.good)) / (len(b) + 8) for b in blocks)
        x = [sum(differ) / len(differ), differ[0], differ[len(differ) // 4], differ[len(differ) // 2], math.log(1 + len(raw))] if differ else [0.0] * 5
        p = 1 / (1 + math.exp(-(model.bias + sum(w * v for w, v in zip(model.weights, x)))))
        assert r.score == pytest.approx(p, abs=1e-9) and r.predicted == int(p >= 0.5)


def test_quality_of_odd_tables(spark):
    texts = ["good text of words " * 20, "BAD!! TEXT!! " * 20, None, "", "x" * 100_000]
    docs = spark.createDataFrame([(i, t, 0.1) for i, t in enumerate(texts + texts)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, None), (4, 5), (5, 1), (6, 0), (None, 1), (0, 1)], "doc_id long, quality int")
    for some in (labels, labels.where("quality = 1"), labels.limit(0)):
        got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, some)).collect()}
        assert len(got) == 10 and all(0 <= s <= 1 for s in got.values()) and all(got[i] == got[i + 5] for i in range(5))
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).collect() == []


def test_perspectives(spark):
    m = [(1, 0, "ann", "hi"), (1, 1, "bob", "hé"), (1, 1, "cy", None), (1, None, "ann", "first"), (2, 0, None, "alone"), (None, 3, "ann", "x"), (1, 600, "bob", "late"), (1, 600, "bob", "late")]
    df = spark.createDataFrame([(*x, "extra") for x in m], "conv_id long, turn long, role string, text string, place string")
    dialogues = {}
    for r in chat.perspectives(df).collect():
        dialogues.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(dialogues) == {(1, "ann"), (1, "bob"), (1, "cy"), (2, "unknown"), (None, "ann")}
    for (_, who), rows in dialogues.items():
        rows.sort(key=lambda r: r.place)
        text = "".join(r.rendered for r in rows)
        for r in rows:
            assert text[r.place :].startswith(r.rendered) and (r.role == "assistant") == (r.speaker == who)
            masked = text[r.mask_begin : r.mask_end]
            assert masked == (r.rendered[len("<|im_start|>assistant\n") : -1] if r.role == "assistant" else "")
    assert [r.turn for r in dialogues[1, "bob"]] == [None, 0, 1, 1, 600, 600]
    assert "user name=ann\nhi<|im_end|>\n" in "".join(r.rendered for r in dialogues[1, "bob"])
    assert chat.perspectives(df.limit(0)).collect() == []


def test_archive(spark, tmp_path):
    long = "é" * 600
    pages = [(1, "http://a", long), (2, "http://b", long), (3, None, "short"), (4, "u", "short"), (5, "u\r\nX: y", None), (6, "u", ""), (2, "http://b", long), (None, "n", long), (9, "v", "\r\n\r\n" + "z" * 2000)]
    df = spark.createDataFrame([(*p, "e") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    warc.write_archive(df, f"{tmp_path}/w")
    assert spark.read.parquet(f"{tmp_path}/w/payloads").count() == 4
    rows = sorted(warc.parsed(warc.read_archive(spark, f"{tmp_path}/w")).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert [(r.page_id, r.record_type, r.refers_to) for r in rows] == [(1, "revisit", "2"), (2, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (9, "response", None), (None, "revisit", "2")]
    by = {p[0]: p[2] or "" for p in pages}
    assert all(bytes(r.payload).decode() == by[r.page_id] and r.payload_bytes == len(by[r.page_id].encode()) for r in rows)
    record = bytes(warc.read_archive(spark, f"{tmp_path}/w").where("page_id = 9").first().record)
    head, body = record.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and body.endswith(b"z" * 2000 + b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
    assert len(body) == size + 4
    warc.write_archive(df.limit(0), f"{tmp_path}/none")
    assert warc.parsed(warc.read_archive(spark, f"{tmp_path}/none")).collect() == []


def test_archive_notices_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    warc.write_archive(df, f"{tmp_path}/w")
    bad = spark.read.parquet(f"{tmp_path}/w/payloads").selectExpr("digest", "CAST('abd' AS BINARY) AS payload").collect()
    spark.createDataFrame(bad, "digest string, payload binary").write.mode("overwrite").parquet(f"{tmp_path}/w/payloads")
    with pytest.raises(Exception, match="digest"):
        warc.parsed(warc.read_archive(spark, f"{tmp_path}/w")).collect()
