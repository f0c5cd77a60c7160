"""Queries that must count all of their rows: against sums that no SQL of theirs shares."""

from mixtally import catalogue
from mixtally.operators import intervals

SF = "/root/testdata/sf0.001"


def test_combined_counts_has_every_quantity(spark):
    rows = [r.asDict() for r in catalogue.combined_counts(spark, SF).collect()]
    totals = {r.sample: r.cnt for r in catalogue.count_totals(spark, SF).where("level = 'sample'").collect()}
    assert {r["sample"]: sum(v for k, v in r.items() if k != "sample") for r in rows} == totals
    labels = {r.p_brand for r in spark.read.parquet(f"{SF}/part.parquet").select("p_brand").distinct().collect()}
    assert set(rows[0]) == labels | {"sample"}


def test_qualities_of_whole_texts(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    letters = sorted((sum("a" <= c <= "z" for c in (t or "").lower()) for t in texts), reverse=True)
    rows = catalogue.quality_histogram(spark, SF).collect()
    assert sum(r.n for r in rows) == sum(letters) and max(r.pos for r in rows) == letters[0] - 1 > 150


def test_segment_coverage_has_every_contig(spark):
    spans = [tuple(r) for r in catalogue.spans(spark, SF).collect()]
    want = set()
    for contig in {s[0] for s in spans}:
        own = [s[1:] for s in spans if s[0] == contig]
        ends = sorted({x for a, b, _ in own for x in (a, b)})
        want |= {(contig, lo, hi, t) for lo, hi in zip(ends, ends[1:]) for a, b, t in own if a <= lo and hi <= b}
    got = [tuple(r) for r in catalogue.segment_coverage(spark, SF).select("contig", "lo", "hi", "target").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({r[0] for r in got}) > 5


def test_coverage_of_odd_spans(spark):
    rows = [("g", -40, 3, 1), ("g", -33, -32, 2), ("g", 0, 16, 3), ("g", 15, 17, 4), ("g", 5, 5, 5), ("g", 9, 7, 6), ("g", None, 8, 8), ("g", 0, 16, 3), ("h", 0, 1, 7)]
    frame = spark.createDataFrame(rows, "g string, a long, b long, t int")
    want = []
    for group in "gh":
        own = [r[1:] for r in rows if r[0] == group and r[1] is not None]
        ends = sorted({x for a, b, _ in own for x in (a, b)})
        want += [(group, lo, hi, t) for lo, hi in zip(ends, ends[1:]) for a, b, t in own if a <= lo and hi <= b]
    assert sorted(map(tuple, intervals.coverage(frame, "g", "a", "b", "t").collect())) == sorted(want)


def test_reads_of_very_long_texts_have_ids_of_their_own(spark, tmp_path):
    docs = [(0, "ab" * 1_500_200), (1, "abcd" * 100), (3, "abcd" * 100), (4, "x" * 3_000_100)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalogue.reads(spark, str(tmp_path)).select("read_id", "doc_id").collect()
    assert len({r.read_id for r in rows}) == len(rows) == sum((len(t) - catalogue.SHORT_K) // catalogue.STRIDE + 1 for _, t in docs)
    assert {r.doc_id for r in rows if r.read_id < 0} == {0, 4} and {r.read_id for r in rows if r.doc_id == 3} == {3_000_000 + 120 * i for i in range(4)}


def test_a_label_of_all_samples_is_split(spark):
    """Pairs of a label that every sample has come from many tasks, none with more than thrice the median."""
    from pyspark.sql import functions as F

    from mixtally.operators import diversity

    otu = spark.range(400).selectExpr("concat('s', id) AS sample", "'all' AS label", "CAST(id + 1 AS double) AS cnt")
    rows = diversity._shared(otu)
    assert rows.count() == 400 * 399 // 2
    part = F.pmod(F.xxhash64("s1"), F.lit(diversity.PARTS))
    sizes = sorted(r["count"] for r in rows.select(part.alias("part"), "s1").distinct().groupBy("part").count().collect())
    assert len(sizes) == diversity.PARTS and sizes[-1] <= 3 * sizes[len(sizes) // 2]
