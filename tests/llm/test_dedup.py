import pytest

from mixtally.llm import jaccard, substring_bytes, substring_words
from tests.llm import plain


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(k, t, "x", i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, kept_text string, n int").repartition(parts)


def rows_of(seed):
    """Texts with keys in no order, two rows twice, one key with two texts and a row without a key."""
    texts = plain.corpus(seed)
    rows = [((i * 37) % 101, t) for i, t in enumerate(texts)]
    return rows + rows[:2] + [(rows[5][0], texts[9]), (None, texts[3]), (None, texts[7])]


@pytest.mark.parametrize("seed", range(4))
def test_words(spark, seed):
    rows = rows_of(seed)
    got = {r.n: (r.n_words, r.n_removed, r.kept_text) for r in substring_words.remove_repeats(frame(spark, rows)).collect()}
    assert got == dict(enumerate(plain.remove_words(rows)))


@pytest.mark.parametrize("seed, hot", [(0, 10**9), (1, 10**9), (2, 5), (3, 2), (0, 2), (1, 3)])
def test_bytes(spark, seed, hot):
    rows = rows_of(seed)
    found = substring_bytes.remove_repeated_bytes(frame(spark, rows), hot=hot).collect()
    got = {r.n: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found}
    assert got == dict(enumerate(plain.remove_bytes(rows)))
    for r in found:
        assert sum(s.end - s.begin for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rows = [(k, t) for k, t in rows_of(seed)]
    df = frame(spark, rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard.near_duplicates(df.select("doc_id", "text", "n")).collect())
    assert got == sorted((k is None, k or 0, n, -1 if c is None else c) for (k, _), (n, c) in zip(rows, plain.components(rows)))


def test_large_group_of_near_copies(spark):
    """A chain and a star of near copies, more than a leaf of an R-tree holds, beside unrelated texts with one passage."""
    import random

    rng = random.Random(8)
    word = lambda: "w" + str(rng.randrange(10**6))
    base = [word() for _ in range(60)]
    rows, chain = [], list(base)
    for i in range(120):
        copy = list(base)
        copy[rng.randrange(60)] = word()
        rows.append((i, " ".join(copy)))
    for i in range(80):
        chain[rng.randrange(60)] = word()
        rows.append((200 + i, " ".join(chain)))
    passage = [word() for _ in range(40)]
    rows += [(400 + i, " ".join([word() for _ in range(30)] + passage)) for i in range(90)]
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == {k: c for (k, _), (_, c) in zip(rows, plain.components(rows))}


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    assert substring_words.remove_repeats(none).collect() == []
    assert substring_bytes.remove_repeated_bytes(none).collect() == []
    assert jaccard.near_duplicates(none).collect() == []


def test_merge_of_runs():
    import os
    import random

    rng = random.Random(3)
    runs, all_ = [], []
    for _ in range(7):
        run = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 40)))
        runs.append((run, [len(os.path.commonprefix([a, b])) for a, b in zip([b"", *run], run)]))
        all_ += run
    which, place, prefix = substring_bytes.merge_runs(runs)
    out = [runs[i][0][j] for i, j in zip(which, place)]
    assert out == sorted(all_)
    assert prefix[1:] == [len(os.path.commonprefix([a, b])) for a, b in zip(out, out[1:])]
    assert substring_bytes.merge_runs([([], [])]) == ([], [], [])


def test_queries(spark):
    """The registered queries on the smallest tables."""
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_words.op8_substring_dedup(spark, d).collect()}
    assert got == {k: (n, g, plain.sha(t)) for (k, _), (n, g, t) in zip(rows, plain.remove_words(rows))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_bytes.op2_suffix_dedup(spark, d).collect()}
    assert got == {k: (n, g, s, plain.sha(t)) for (k, _), (n, g, s, t) in zip(rows, plain.remove_bytes(rows))}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op10_jaccard_join(spark, d).collect()}
    assert got == {k: x for (k, _), x in zip(rows, plain.components(rows))}


@pytest.mark.parametrize("texts", [["a b", "a b"], ["a"], ["a a a a a a a a a a a a a a"] * 2, ["x " * 13] * 3, [""], ["a b c d e f g h i j k l m"] * 2])
def test_tiny_tables(spark, texts):
    rows = list(enumerate(texts))
    df = frame(spark, rows, 1)
    assert {r.n: (r.n_words, r.n_removed, r.kept_text) for r in substring_words.remove_repeats(df).collect()} == dict(enumerate(plain.remove_words(rows)))
    assert {r.n: r.n_removed for r in substring_bytes.remove_repeated_bytes(df).collect()} == {i: x[1] for i, x in enumerate(plain.remove_bytes(rows))}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()} == dict(enumerate(plain.components(rows)))
