import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mixtally import catalogue, catalogue_files
from mixtally.functions import letters
from mixtally.functions import sequences as S
from mixtally.operators import candidates, kmer_index, sieve


@pytest.fixture(scope="module")
def refs(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(80 + i))) for i in range(6)], "ref_id long, seq string")


@pytest.fixture(scope="module")
def rows(spark, refs):
    rng = random.Random(4)
    seqs = [r.seq for r in refs.collect()]
    made = [s[5:70] for s in seqs] + [seqs[0][:40].lower(), "ß" + seqs[1][:40] + "é" + seqs[1][:40], seqs[2][:30] + "N" + seqs[2][30:70], "ACG", "", None]
    made += ["".join(rng.choice("ACGT") for _ in range(150)) for _ in range(200)]
    return spark.createDataFrame(list(enumerate(made)), "read_id long, seq string")


@pytest.mark.parametrize("k", [5, 11, 31])
def test_the_index_meets_few_other_windows(spark, refs, rows, k):
    """What passes has every window that the index has, at its place; at 31 letters hardly any other is a row."""
    kmer_ec, _ = kmer_index.build(refs, k)
    every = kmer_index.sequence_kmers(rows, k, "read_id")
    passed = {tuple(r) for r in sieve.windows(rows, sieve.sieve(kmer_ec, k), "read_id").select("read_id", "pos", "kmer").collect()}
    want = {tuple(r) for r in every.join(kmer_ec, "kmer").select("read_id", "pos", "kmer").collect()}
    assert want <= passed <= {tuple(r) for r in every.select("read_id", "pos", "kmer").collect()} and len(want) > 100
    assert k < 31 or len(passed - want) < 10


def test_without_a_filter_every_window_is_a_row(spark, refs, rows, monkeypatch):
    monkeypatch.setattr(sieve, "MOST_KMERS", 5)
    kmer_ec, ecs = kmer_index.build(refs, 11)
    found = sieve.sieve(kmer_ec, 11)
    assert found.bits is None
    got = sorted(map(tuple, sieve.windows(rows, found, "read_id").select("read_id", "pos", "kmer").collect()))
    assert got == sorted(map(tuple, kmer_index.sequence_kmers(rows, 11, "read_id").select("read_id", "pos", "kmer").collect()))


def test_reads_are_exchanged_once(spark, refs, rows):
    """Votes deal rows out by read once and join nothing by read: a count of each read's classes was broadcast before, if it packed well."""
    kmer_ec, ecs = kmer_index.build(refs, 11, settled=True)
    voted = candidates.votes(kmer_index.match(rows, kmer_ec, 11), ecs)
    plan = voted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(read_id") == 1 and "SortMergeJoin" not in plan
    assert {tuple(r) for r in candidates.strict(voted).where("read_id < 6").collect()} == {(i, i) for i in range(6)}


def test_bases_and_tiles_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(letters, "PART", 50)
    texts = ["Ab cKİz", "", None, "éé", "xyz" * 200, "ABC-" * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r.d for r in docs.select("doc_id", catalogue.dna("text").alias("d")).collect()}
    assert {r.doc_id: r.d for r in letters.dna(docs, "doc_id").collect()} == want
    got = {(r.doc_id, r.at): r.seq for r in letters.tiles(docs, "doc_id", 150, 120, 11).collect()}
    assert got == {(i, a): d[a : a + 150] for i, d in want.items() for a in range(0, len(d or "") - 10, 120)}


def test_normalised_batches_are_the_columns(spark):
    """Letter by letter as the column function: any letters, of several bytes too, and which base each becomes."""


    texts = ["acguUNNacgt", "", "é𝄞 xyz ACGT-u", "ACGT" * 30, "The quick brown fox. " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    name = F.col("doc_id").cast("string")
    rows = docs.select("text", S.normalise("text", name).alias("n"), F.xxhash64(F.xxhash64(name)).alias("seed")).collect()

    out, ends, _ = letters.normalised(pa.array([r.text for r in rows]), np.array([r.seed for r in rows]).view(np.uint64))
    assert [out[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == [r.n for r in rows]
    got = {r.doc_id: r for r in letters.replacement(docs, "doc_id", "text", name).collect()}
    assert all(r.repeatable and r.bases_only for r in got.values()) and got[2].n_other == 8
    assert got[0].kept_md5 == hashlib.md5(b"ACGTTNNACGT").hexdigest()


def test_replaced_letters_tells_whether_it_repeats(spark):
    assert catalogue_files.replaced_letters(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_other", "kept_md5", "bases_only", "repeatable"]


def test_reads_that_hit_nothing_see_no_round(spark, refs, rows):
    """Of 200 reads that share no 31-mer with the index hardly any is left for the lookup along unitigs; all others are."""
    kmer_ec, _ = kmer_index.build(refs, 31)
    left = {r.read_id for r in sieve.touched(rows, sieve.sieve(kmer_ec, 31), "read_id").collect()}
    hit = {r.read_id for r in kmer_index.sequence_kmers(rows, 31, "read_id").join(kmer_ec, "kmer").select("read_id").distinct().collect()}
    assert hit <= left and len(left - hit) < 5 < len(hit)


def test_fastq_records_are_made_without_arrays(spark):
    docs = spark.createDataFrame([(1, "ACGT" * 40), (2, "")], "doc_id long, d string")
    rows = catalogue_files._fastq(docs)
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()
    qual = "".join(chr(33 + i % 60) for i in range(160))
    assert rows.first()[0].split("\n+\n")[1].replace("\n", "") == qual


def test_mates_are_looked_up_once(spark, refs, rows):
    """Both rules come from one pass over the pairs and one exchange by read; each mate was looked up anew for each use before."""
    pairs = rows.withColumnRenamed("seq", "seq1").withColumn("seq2", F.lag("seq1", 1).over(Window.orderBy("read_id")))
    kmer_ec, ecs = kmer_index.build(refs, 11, settled=True)
    voted = candidates.votes(kmer_index.match_mates(pairs, kmer_ec, 11), ecs, "read_id", "mate")
    got = candidates.pair_candidates(candidates.mate_sets(voted), ("strict", "lenient"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("hashpartitioning(read_id") == 1
    hits = [kmer_index.match(pairs.select("read_id", F.col(s).alias("seq")), kmer_ec, 11) for s in ("seq1", "seq2")]
    votes = [candidates.votes(h, ecs) for h in hits]
    sets = [candidates.strict(v) for v in votes]
    want = {(*r, "strict") for r in candidates.mates_strict(*sets, *hits).collect()} | {(*r, "lenient") for r in candidates.mates_lenient(*sets).collect()}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({r[2] for r in want}) == 2
    loose = candidates.pair_candidates(candidates.mate_sets(voted, loose=True), ("lenient",)).drop("rule")
    assert {tuple(r) for r in loose.collect()} == {tuple(r) for r in candidates.mates_lenient(*map(candidates.lenient, votes)).collect()}


@pytest.mark.parametrize("k, least", [(5, 11), (11, 11), (31, 11), (31, 40)])
def test_windows_of_tiles_are_told_from_texts(spark, refs, monkeypatch, k, least):
    """As tiles that are made and sifted one by one: the same windows, in each tile that holds them; counts are those of the tiles."""
    monkeypatch.setattr(letters, "PART", 700)
    rng = random.Random(5)
    texts = ["Ab cKİz", "", None, "éé", "xyz" * 200, "ABC-" * 90] + [" ".join(r.seq for r in refs.collect())] * 2
    texts += ["".join(rng.choice("acgt ") for _ in range(rng.randrange(400))) + r.seq for r in refs.collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # Texts are seen through letters, so references are too.
    kmer_ec, _ = kmer_index.build(refs.select("ref_id", catalogue.dna("seq").alias("seq")), k)
    found = sieve.sieve(kmer_ec, k)
    tiles = letters.tiles(docs, "doc_id", 150, 120, least).withColumn("tile", F.struct("doc_id", "at"))
    want = sorted(tuple(r) for r in sieve.windows(tiles, found, "tile").select("tile.doc_id", "tile.at", "kmer").collect())
    assert sorted(tuple(r) for r in sieve.tile_windows(docs, found, "doc_id", 150, 120, least).select("doc_id", "at", "kmer").collect()) == want and len(want) > 500
    n = {r.doc_id: r["count"] for r in tiles.groupBy("doc_id").count().collect()}
    assert {r.doc_id: r.n for r in letters.tile_counts(docs, "doc_id", 120, least).collect()} == {i: n.get(i, 0) for i in range(len(texts))}


def test_unmapped_tiles_are_counted_by_text(spark):
    """As reads without a candidate that are met one by one: texts of one key, of none, and without any such tile too."""
    counts = spark.createDataFrame([(1, 3), (1, 1), (2, 2), (3, 0), (4, 1), (None, 2)], "doc_id long, n long")
    good = spark.createDataFrame([(1, 0), (1, 240), (1, 240), (4, 0), (9, 0), (None, 0)], "doc_id long, at long")
    got = sorted(map(tuple, candidates.unmapped_tiles(counts, good, "doc_id", 120).collect()), key=str)
    reads = counts.select("doc_id", F.explode(F.expr("CASE WHEN n > 0 THEN sequence(0, n - 1) END")).alias("i")).withColumn("read_id", F.col("doc_id") * 1000 + F.col("i") * 120)
    want = candidates.unmapped(reads, good.select((F.col("doc_id") * 1000 + F.col("at")).alias("read_id"))).groupBy("doc_id").count()
    assert got == sorted(map(tuple, want.collect()), key=str) == [(1, 1), (2, 2), (None, 2)]


def test_one_row_group_is_dealt_out(spark, tmp_path):
    """A file of one row group gives all rows to one of its many partitions; they are dealt out to as many as there are cores."""
    pq.write_table(pa.table({"doc_id": range(2000), "text": [f"text {i}" for i in range(2000)]}), f"{tmp_path}/documents.parquet")
    kept = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key in kept:
            spark.conf.set(key, "1k")
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert docs.rdd.getNumPartitions() > 4 and docs.select(F.spark_partition_id()).distinct().count() == 1
        sizes = catalogue.spread(docs).groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 1000 and sum(r["count"] for r in sizes) == 2000
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def test_unmapped_reads_meet_no_tiles(spark):
    """No tile is joined by its number: texts' counts meet those that have a candidate."""
    plan = catalogue.unmapped_reads(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("MapInArrow") == 2
