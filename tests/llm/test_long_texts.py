"""Texts of a megabyte and more, whole: each operator treats them like any, and says what it takes as a key."""

import hashlib
import random

import pytest

from mixtally.llm import decontaminate, divergence, jaccard, license_scan, substring_bytes, substring_words, warc

WORDS = 150_000


@pytest.fixture(scope="module")
def long():
    rng = random.Random(1)
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(WORDS))


@pytest.fixture(scope="module")
def docs(spark, long):
    return spark.createDataFrame([(1, long, "en"), (2, long + " tail", "en"), (3, "short", "en"), (4, "All rights reserved. " + long, "en")], "doc_id long, text string, lang string").persist()


def test_words_and_bytes(docs, long):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_words.remove_repeats(docs.where("doc_id < 4")).collect()}
    assert got == {1: (WORDS, 0, long), 2: (WORDS + 1, WORDS, "tail"), 3: (1, 0, "short")}
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in substring_bytes.remove_repeated_bytes(docs.where("doc_id < 4")).collect()}
    assert got == {1: (len(long), 0, long.encode()), 2: (len(long) + 5, len(long), b" tail"), 3: (5, 0, b"short")}


def test_sets(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {1: (WORDS - 4, 1), 2: (WORDS - 3, 1), 3: (1, 3), 4: (WORDS - 1, 1)}


def test_scans(spark, docs, long):
    words = long.split()
    items = spark.createDataFrame([(7, " ".join(words[-15:])), (8, " ".join(words[:10]) + " x")], "item_id int, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_contamination(docs.where("doc_id < 4"), items).collect()}
    assert got == {1: (WORDS, 25, ["7", "8"]), 2: (WORDS + 1, 25, ["7", "8"]), 3: (1, 0, [])}
    assert [(r.doc_id, r.template, r.matched) for r in license_scan.scan_licenses(docs).collect()] == [(4, "all-rights-reserved", "All rights reserved")]
    assert {r.doc_id: r.n_words for r in divergence.judge(docs).collect()} == {1: WORDS, 2: WORDS + 1, 3: 1, 4: WORDS + 3}


def test_archive(spark, docs, long, tmp_path):
    warc.write_archive(docs.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html"), str(tmp_path / "a"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type) for r in warc.read_headers(spark, str(tmp_path / "a")).collect()}
    assert got[1] == (len(long), hashlib.sha1(long.encode()).hexdigest(), "response") and len(got) == 4


def test_keys_are_integers(docs):
    text = docs.selectExpr("CAST(doc_id AS string) AS doc_id", "text")
    for operator in (substring_words.remove_repeats, substring_bytes.remove_repeated_bytes, jaccard.near_duplicates):
        with pytest.raises(TypeError, match="integer"):
            operator(text)
