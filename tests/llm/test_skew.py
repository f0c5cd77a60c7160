import pytest

from mixtally.llm import decontaminate, divergence, skew


@pytest.mark.parametrize("how", ["left", "inner"])
def test_a_hot_key_is_spread(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "SHARE", 10)
    rows = [(i, 7) for i in range(300)] + [(1000 + i, i) for i in range(100)] + [(5000, None)]
    left = spark.createDataFrame([(k, v, "x") for k, v in rows], "k long, v long, w string")
    right = spark.createDataFrame([(v, f"r{v}") for v in range(0, 100, 7)], "v long, r string")
    out = skew.salted_join(left, right, "v", how)
    want = sorted((k, v, "x", f"r{v}" if v is not None and v % 7 == 0 else None) for k, v in rows)
    want = want if how == "left" else [x for x in want if x[3]]
    assert sorted(tuple(r[c] for c in ("k", "v", "w", "r")) for r in out.collect()) == want
    assert skew.salted_join(left.limit(0), right, "v", how).collect() == []


def test_clashing_columns(spark):
    """Columns named like a rule's own state stay as they are."""
    docs = spark.createDataFrame([(1, "a b c " * 30, "en", "mine", 5, [1], 0.5, "own"), (1, None, None, None, None, None, None, None)], "doc_id long, text string, lang string, words string, classes int, classes_total array<int>, words_total double, __found string")
    rows = divergence.judge(docs).collect()
    assert sorted((r.words or "", r.classes or 0, r.words_total or 0.0, r.__found if False else r["__found"]) for r in rows)[-1] == ("mine", 5, 0.5, "own")
    items = spark.createDataFrame([(i, f"a b c {i}") for i in range(40)], "item_id long, text string")
    for most in (10**6, 100):
        monkey = decontaminate.blocks.__defaults__
        try:
            decontaminate.blocks.__defaults__ = (most,)
            got = decontaminate.find_contamination(docs, items).collect()
        finally:
            decontaminate.blocks.__defaults__ = monkey
        assert sorted(r["__found"] or "" for r in got) == ["", "own"] and not any(r.contaminated for r in got)
