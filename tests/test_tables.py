import gzip
import math
import random

import pytest

from mixtally.operators import diversity, intervals, quality, taxonomy
from mixtally.sources import fastx, tables

OTU = [("s1", "a", 10.0), ("s1", "b", 30.0), ("s2", "b", 5.0), ("s2", "c", 5.0), ("s3", "d", 8.0), ("s3", "a", 0.0)]


def otu(spark, rows=OTU):
    return spark.createDataFrame(rows, "sample string, label string, cnt double")


def test_diversity(spark):
    got = {r["sample"]: r for r in diversity.individual(otu(spark)).collect()}
    assert got["s1"].d0 == 2 and got["s3"].d0 == 2
    assert got["s1"].d1 == pytest.approx(math.exp(0.25 * math.log(0.25) + 0.75 * math.log(0.75))) and got["s1"].d2 == pytest.approx(0.625)
    assert got["s1"].d1_hill == pytest.approx(1 / got["s1"].d1)
    pairs = {(r.s1, r.s2): r for r in diversity.pairwise(otu(spark)).collect()}
    assert len(pairs) == 3 and pairs["s1", "s3"].bray_curtis == pytest.approx(1) and pairs["s1", "s2"].bray_curtis == pytest.approx((10 + 25 + 5) / 50)
    assert all(0 <= r.bray_curtis <= 1 for r in pairs.values())
    pooled = [10 / 50, 35 / 50, 5 / 50]
    alpha = 40 / 50 * 0.625 + 10 / 50 * 0.5
    assert pairs["s1", "s2"].d2_beta == pytest.approx(sum(p * p for p in pooled) / alpha)
    g = diversity.group(otu(spark)).first()
    assert math.isfinite(g.d1_gamma) and g.d2_gamma == pytest.approx(sum((x / 58) ** 2 for x in (10, 35, 5, 8)))


def test_tables_of_counts(spark):
    assert diversity.wide(otu(spark)).where("sample = 's2'").first().asDict() == {"sample": "s2", "a": 0.0, "b": 5.0, "c": 5.0, "d": 0.0}
    assert {(r["sample"], r.label) for r in diversity.keep_frequent(otu(spark), 0.3).collect()} == {("s1", "b"), ("s2", "b"), ("s2", "c"), ("s3", "d")}
    assert diversity.keep_frequent(otu(spark)).count() == 6
    rows = {(r["sample"], r.label): r.cnt for r in diversity.totals(otu(spark)).collect()}
    assert rows[None, None] == 58 and rows["s1", None] == 40 and rows[None, "b"] == 35
    assert diversity.pairwise(otu(spark, OTU[:2])).count() == 0 and diversity.individual(otu(spark, [])).count() == 0


def test_taxonomy(spark):
    taxa = spark.createDataFrame([("r2", "A;C;"), ("r1", "A;B;"), ("r3", "A;B;"), ("zz", "X;Y;")], "name string, label string")
    refs = spark.createDataFrame([(0, "r1"), (1, "r2"), (2, "r3"), (3, "r4")], "ref_id int, name string")
    labelled = taxonomy.assign_labels(taxa, refs)
    assert {(r.ref_id, r.label_id) for r in labelled.collect()} == {(0, 1), (1, 2), (2, 1)}
    assert {(r.label, r["size"]) for r in taxonomy.label_sizes(labelled).collect()} == {("A;B;", 2), ("A;C;", 1)}
    assert {(r.ref_id, r.label) for r in taxonomy.with_default(refs, labelled).collect()} == {(0, "A;B;"), (1, "A;C;"), (2, "A;B;"), (3, "3")}
    freqs = spark.createDataFrame([(1, 0.6), (2, 0.4)], "key int, f double")
    labels = labelled.select("label_id", "label").distinct().withColumnRenamed("label_id", "key")
    rows = {r["name"]: r for r in taxonomy.rolled_counts(freqs, labels, 10.0).collect()}
    assert set(rows) == {"Root", "A", "B", "C"} and rows["A"].expected_count == pytest.approx(10) and rows["B"].rank_id == "0.1.1" and rows["C"].rank_id == "0.1.2"
    assert rows["A"].daughters == 2 and rows["B"].daughters == 1  # its unknown child is hidden and yet counted
    assert taxonomy.sniff("k__A; p__B") == ("; ", True) and taxonomy.sniff("A;B;") == (";", False)
    with pytest.raises(ValueError):
        taxonomy.sniff("A,B")


def test_intervals(spark):
    rows = [("c", 0, 10, 1), ("c", 5, 15, 2), ("c", 5, 10, 3), ("d", 0, 1, 4)]
    spans = spark.createDataFrame(rows, "g string, a long, b long, t long")
    assert {(r.g, r.lo, r.hi) for r in intervals.segments(spans, "g", "a", "b").collect()} == {("c", 0, 5), ("c", 5, 10), ("c", 10, 15), ("d", 0, 1)}
    assert {(r.lo, r.hi, r.n) for r in intervals.depth(spans, "g", "a", "b").collect() if r.g == "c"} == {(0, 5, 1), (5, 10, 3), (10, 15, 1)}
    assert {(r.lo, r.t) for r in intervals.coverage(spans, "g", "a", "b", "t").collect() if r.g == "c"} == {(0, 1), (5, 1), (5, 2), (5, 3), (10, 2)}
    pieces = spark.createDataFrame([("x", 5, "GGTT"), ("x", 0, "ACGG")], "k string, p int, s string")
    assert intervals.rebuild(pieces, "k", "p", "s", 2).first()["s"] == "ACGGTT"


def test_quality(spark):
    reads = spark.createDataFrame([("#5",), ("!5",), ("",), (None,)], "qual string")
    assert {(r.pos, r.q, r.n) for r in quality.histogram(reads).collect()} == {(0, 2, 1), (0, 0, 1), (1, 20, 2)}
    m = quality.expected_loglik(quality.histogram(reads)).first()
    one = (0.25 * math.log(0.25) + 0.75 * math.log(0.25)) / 2
    two = 0.99 * math.log(0.99) + 0.01 * math.log(0.01 / 3)
    assert m.mean == pytest.approx(one + two) and m.var >= 0
    lk = spark.createDataFrame([(1, -1.0), (1, -9.0), (2, -5.0)], "read_id long, loglik double")
    moments = spark.createDataFrame([(-2.0, 1.0)], "mean double, var double")
    assert {r.read_id for r in quality.passing(lk, moments).collect()} == {1} and quality.passing(lk, moments, -3.5).count() == 3


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 first\nACGT\nAC\n>r2\nGGG\n>empty\n")
    (tmp_path / "b.fa").write_text(">r2 again\nTTT\n>r3\nCCC\n")
    rows = fastx.read_fasta(spark, f"{tmp_path}/a.fa,{tmp_path}/b.fa").orderBy("ref_id").collect()
    assert [(r.ref_id, r.name, r.seq) for r in rows] == [(0, "r1", "ACGTAC"), (1, "r2", "GGG"), (2, "empty", ""), (3, "r3", "CCC")]
    assert [r.name for r in fastx.repeated_names(spark, [f"{tmp_path}/a.fa", f"{tmp_path}/b.fa"]).collect()] == ["r2"]
    fai = [tuple(r) for r in tables.make_fai(fastx.read_fasta(spark, f"{tmp_path}/b.fa")).collect()]
    assert fai == [("r2", 3, 4, 3, 4), ("r3", 3, 12, 3, 4)]


def test_fastq_splits_and_gzip(spark, tmp_path):
    rng = random.Random(3)
    want = []
    for i in range(700):
        n = rng.randrange(1, 60)
        want.append((f"r{i}", "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@+?I#") for _ in range(n))))
    text = "".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in want)
    (tmp_path / "r.fq").write_text(text)
    with gzip.open(tmp_path / "r.fq.gz", "wt") as f:
        f.write(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        split = fastx.read_fastq(spark, f"{tmp_path}/r.fq")
        got = [(r.name, r.seq, r.qual) for r in split.orderBy("ordinal").collect()]
        assert got == want and [r.ordinal for r in split.orderBy("ordinal").collect()] == list(range(700))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [(r.name, r.seq, r.qual) for r in fastx.read_reads(spark, f"{tmp_path}/r.fq.gz").orderBy("read_id").collect()] == want
    pairs = fastx.read_pairs(spark, f"{tmp_path}/r.fq", f"{tmp_path}/r.fq.gz").collect()
    assert len(pairs) == 700 and all(r.name1 == r.name2 for r in pairs)
    (tmp_path / "bad.fq").write_text("@a\nACGT\n+\n??\n")
    with pytest.raises(Exception, match="malformed"):
        fastx.read_fastq(spark, f"{tmp_path}/bad.fq").collect()


def test_fasta_framing(spark, tmp_path):
    """`>` inside headers and sequences' lines, text before the first record, blank lines, and both line ends."""
    (tmp_path / "a.fa").write_bytes(b"; a note\n\n>r1 product A->B >C\nAC\nGT\n\n>r2\r\nGG\r\nT\r\n>>odd\nA\n")
    (tmp_path / "b.fa").write_text("\n>r3\nT>T\n>\nCC")
    (tmp_path / "c.fa").write_text("no record")
    rows = fastx.read_fasta(spark, [f"{tmp_path}/{x}.fa" for x in "abc"]).orderBy("ref_id").collect()
    assert [(r.name, r.seq) for r in rows] == [("r1", "ACGT"), ("r2", "GGT"), (">odd", "A"), ("r3", "T>T"), ("", "CC")]
    assert fastx.read_fasta(spark, f"{tmp_path}/c.fa").collect() == []


def test_fastq_of_several_lines(spark, tmp_path):
    rng = random.Random(11)
    want, text = [], ""
    for i in range(900):
        n = rng.choice([0, 1, 5, 30, 31, 95, 200])
        s, q = "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@+>I#!") for _ in range(n))
        want.append((f"r{i}", s, q))

        def wrap(x, width):
            return "".join(x[k : k + width] + "\n" for k in range(0, len(x), width)) or "\n"

        width = rng.choice([30, 31, 1000])
        text += f"@r{i} c\n{wrap(s, width)}+{rng.choice(['', 'r' + str(i)])}\n{wrap(q, width)}" + "\n" * rng.randrange(2)
    (tmp_path / "r.fq").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("100000000", "20000", "3000", "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            rows = fastx.read_fastq(spark, f"{tmp_path}/r.fq").orderBy("ordinal").collect()
            assert [(r.name, r.seq, r.qual) for r in rows] == want and [r.ordinal for r in rows] == list(range(900))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    (tmp_path / "end.fq").write_text("@a\nAC\n+\nII\n@b\n\n+")
    assert [(r.name, r.seq) for r in fastx.read_fastq(spark, f"{tmp_path}/end.fq").orderBy("ordinal").collect()] == [("a", "AC"), ("b", "")]
    assert [r.name for r in fastx.read_reads(spark, f"{tmp_path}/end.fq").collect()] == ["a"]
    for bad in ("@a\nAC\n+\nI", "@a\nACGT\n", "@a\nAC\n+\nIIII\n@b\nA\n+\nI\n", "x\n"):
        (tmp_path / "bad.fq").write_text(bad)
        with pytest.raises(Exception, match="malformed|no record|no qualities"):
            fastx.read_fastq(spark, f"{tmp_path}/bad.fq").collect()


def test_text_tables(spark, tmp_path):
    (tmp_path / "x.fai").write_text("r1\t6\t4\t6\t7\nr2\t3\t15\t3\t4\nr1\t9\t9\t9\t9\nshort\t1\n")
    assert [(r.ref_id, r.name, r.length) for r in tables.read_fai(spark, f"{tmp_path}/x.fai").orderBy("ref_id").collect()] == [(0, "r1", 6), (1, "r2", 3)]
    (tmp_path / "t.tax").write_text("r1\tA;B;\nr1\tZ;\nr2\tA;C;\nbad line\n")
    assert {tuple(r) for r in tables.read_taxonomy(spark, f"{tmp_path}/t.tax").collect()} == {("r1", "A;B;"), ("r2", "A;C;")}
    assert tables.taxonomy_format(tables.read_taxonomy(spark, f"{tmp_path}/t.tax")) == (";", False)
    (tmp_path / "one").write_text("Label\tExpectedCounts\tTaxa\n7\t12.5\tA;B;\nbad\trow\n")
    (tmp_path / "two").write_text("taxlevel\trankID\ttaxon\tdaughterlevels\texpected_counts\n0\t0\tRoot\t1\t10\n")
    (tmp_path / "list").write_text(f"s1\t{tmp_path}/one\ns2,{tmp_path}/two\n")
    assert {tuple(r) for r in tables.read_samples(spark, f"{tmp_path}/list").collect()} == {("s1", "7", 12.5, "A;B;"), ("s2", "0", 10.0, "Root")}
    (tmp_path / "bad").write_text("x\ty\n")
    with pytest.raises(ValueError):
        tables.read_result(spark, f"{tmp_path}/bad")


def test_ids_of_reads_in_folders(spark, tmp_path):
    """Files of a folder or glob have ids of their own; mates are those of the file at the same place of their entry."""
    for side, letter in (("one", "A"), ("two", "C")):
        for folder, files in (("x", 3), ("y z%20", 2)):
            (tmp_path / side / folder).mkdir(parents=True)
            for i in range(files):
                # The second file has no record, and the forward side's files are packed.
                text = "".join(f"@{folder[0]}{i}.{r}\n{letter * (r + 1)}\n+\n{'I' * (r + 1)}\n" for r in range(0 if i == 1 else 3 + i))
                name = tmp_path / side / folder / f"part-{i}.fq"
                if side == "one":
                    with gzip.open(f"{name}.gz", "wt") as f:
                        f.write(text)
                else:
                    name.write_text(text)
    entries = {side: [f"{tmp_path}/{side}/x", f"{tmp_path}/{side}/y*/part-*"] for side in ("one", "two")}
    reads = fastx.read_reads(spark, entries["one"]).collect()
    assert len(reads) == 3 + 5 + 3 == len({r.read_id for r in reads})
    assert [r.name for r in sorted(reads)] == [f"{f}{i}.{r}" for f, n in (("x", 3), ("y", 2)) for i in range(n) for r in range(0 if i == 1 else 3 + i)]
    pairs = fastx.read_pairs(spark, entries["one"], entries["two"]).collect()
    assert len(pairs) == 11 and all(p.name1 == p.name2 and p.seq1 == p.seq2.replace("C", "A") for p in pairs)
    assert sorted(fastx.read_reads(spark, ",".join(entries["one"])).collect()) == sorted(reads)
    (tmp_path / "two" / "x" / "part-3.fq").write_text("")
    with pytest.raises(ValueError, match="files"):
        fastx.read_pairs(spark, entries["one"], entries["two"])
