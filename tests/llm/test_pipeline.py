import public_tokenizers
import tiktoken

import corpus_pipeline as P
from mixtally.llm import bpe, quality
from tests.llm import plain

D = "/root/testdata/sf0.001"


def test_run_matches_plain_python(spark):
    """All stages over the smallest table. The quality scores are the model's own; every other decision is made anew."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = quality.fit_labels(docs, spark.read.parquet(f"{D}/labels.parquet"))
    scorer = model.scorer()
    rows = [r for r in docs.collect() if scorer.scores([(r.text or "").encode()])[0] >= 0.5]
    assert 0.5 * docs.count() < len(rows) < docs.count()
    rows = [r for r, (_, c) in zip(rows, plain.components([(r.doc_id, r.text) for r in rows])) if c == r.doc_id]
    cut = plain.remove_words([(r.doc_id, r.text) for r in rows])
    texts = [(r, kept if gone else r.text, len(kept) if gone else r.n_chars) for r, (n, gone, kept) in zip(rows, cut) if not gone or gone < n]
    assert any(t != r.text for r, t, _ in texts)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    hit = plain.contamination([(r.doc_id, t) for r, t, _ in texts], items)
    texts = [x for x, (_, n_hit, _) in zip(texts, hit) if not n_hit]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(P.VOCABULARY)), special_tokens={})
    want = {r.doc_id: (r.lang, r.source, n, enc.encode_ordinary(t), t) for r, t, n in texts}
    got = {r.doc_id: (r.lang, r.source, r.n_chars, r.ids, r.text) for r in P.run(spark, D).collect()}
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, D).dtypes == docs.dtypes, name


def test_stages_take_odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, "a", 0), (None, "some words of text " * 20, "en", None, 380), (3, "x" * 50_000, "en", "a", None), (3, "x" * 50_000, "en", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        assert stage(spark, docs, D).count() <= 5, name
        assert stage(spark, docs.limit(0), D).count() == 0, name
    assert P.near_duplicate_stage(spark, docs, D).count() == 5 and P.substring_stage(spark, docs, D).count() == 5
