import random

import pytest

from mixtally import cli
from mixtally.operators import kmer_index
from mixtally.plans import quantify as plans
from mixtally.streaming import reads as streaming


def mutated(rng, seq, changes):
    s = list(seq)
    for i in rng.sample(range(len(s)), changes):
        s[i] = rng.choice([c for c in "ACGT" if c != s[i]])
    return "".join(s)


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    """Five references, two of them near relatives, and 300 reads of known origin."""
    rng = random.Random(17)
    folder = tmp_path_factory.mktemp("world")
    refs = ["".join(rng.choice("ACGT") for _ in range(400)) for _ in range(4)]
    refs.append(mutated(rng, refs[0], 8))
    share = [0.4, 0.3, 0.2, 0.0, 0.1]
    reads = []
    for i in range(300):
        origin = rng.choices(range(5), share)[0]
        at = rng.randrange(300)
        read = mutated(rng, refs[origin][at : at + 100], rng.randrange(2))
        reads.append((f"read{i}", read, "I" * 100))
    (folder / "refs.fa").write_text("".join(f">ref{i} x\n{s}\n" for i, s in enumerate(refs)))
    (folder / "reads.fq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in reads + [("junk", "".join(rng.choice("ACGT") for _ in range(100)), "I" * 100)]))
    (folder / "tax.tsv").write_text("ref0\tA;B;C;\nref4\tA;B;C;\nref1\tA;B;D;\nref2\tA;E;F;\nref3\tA;E;G;\n")
    return folder, share


def test_index_quantify_tabulate(spark, world, tmp_path):
    folder, share = world
    p = cli.parser()

    def call(*argv):
        return cli.run(spark, cli.checked(p.parse_args(list(argv)), p))

    call("-c", "index", "-r", f"{folder}/refs.fa", "-i", f"{tmp_path}/index", "-k", "15")
    common = ("-c", "quantify", "-r", f"{folder}/refs.fa", "-f", f"{folder}/reads.fq", "-i", f"{tmp_path}/index", "-t", f"{folder}/tax.tsv", "--em_tolerance", "1e-6", "--min_freq", "0.01")
    got = call(*common, "-o", f"{tmp_path}/out", "--fail", "--readinfo", "--max_like_out")
    assert got["reads"] == 301 and got["converged"] and got["mapped"] == 300
    rows = {r["Label"]: float(r.ExpectedCounts) for r in spark.read.csv(f"{tmp_path}/out/freqs", sep="\t", header=True).collect()}
    total = sum(rows.values())
    for i, f in enumerate(share):
        assert rows.get(str(i), 0) / total == pytest.approx(f, abs=0.09)
    assert [r.name for r in spark.read.csv(f"{tmp_path}/out/fails", sep="\t", header=True).collect() if r.reason == "Pseudomapping_Fails"] == ["junk"]
    info = {r.name: r["info"] for r in spark.read.csv(f"{tmp_path}/out/readinfo", sep="\t", header=True).collect()}
    assert info["junk"] == "MapFail" and set(info) == {"junk"} | {f"read{i}" for i in range(300)} and info["read0"].split(":")[1].startswith("ref")
    assert "reads: 301" in [r.value for r in spark.read.text(f"{tmp_path}/out/log").collect()] and spark.read.text(f"{tmp_path}/out/maxlikes").count() == 300
    call(*common, "-o", f"{tmp_path}/taxa", "--collapse")
    rows = {r.taxon: float(r.expected_counts) for r in spark.read.csv(f"{tmp_path}/taxa/freqs", sep="\t", header=True).collect()}
    assert rows["C"] / rows["Root"] == pytest.approx(0.5, abs=0.09) and rows["E"] / rows["Root"] == pytest.approx(0.2, abs=0.09)
    (tmp_path / "list").write_text(f"one\t{tmp_path}/out/freqs\ntwo\t{tmp_path}/out/freqs\n")
    call("-c", "tabulate", "--samples", f"{tmp_path}/list", "-o", f"{tmp_path}/table")
    assert float(spark.read.csv(f"{tmp_path}/table/pairwise", sep="\t", header=True).first().bray_curtis) == pytest.approx(0)


def test_pairs(spark, world, tmp_path):
    from mixtally.sources import fastx

    rng = random.Random(4)
    refs = kmer_index.prepare(fastx.read_fasta(spark, f"{world[0]}/refs.fa")).persist()
    seqs = {r.ref_id: r.seq for r in refs.collect()}
    kmer_ec, ecs = kmer_index.build(refs, 15)
    back = str.maketrans("ACGT", "TGCA")
    rows = []
    for i in range(60):
        s = seqs[(1, 1, 2)[i % 3]]
        at = rng.randrange(200)
        rows.append((i, f"p{i}", s[at : at + 60], "I" * 60, f"p{i}", s[at + 100 : at + 160][::-1].translate(back), "I" * 60))
    pairs = spark.createDataFrame(rows, "read_id long, name1 string, seq1 string, qual1 string, name2 string, seq2 string, qual2 string")
    out = plans.quantify(pairs, {"k": 15, "kmer_ec": kmer_ec, "ecs": ecs, "refs": refs}, None, plans.Options(paired=True, tolerance=1e-6))
    assert out.counters["mapped"] == 60 and out.em.freqs[1] == pytest.approx(2 / 3, abs=0.01) and out.em.freqs[2] == pytest.approx(1 / 3, abs=0.01)


def test_jumps_windows_and_states_change_nothing(spark, world, tmp_path):
    """The same frequencies with reads that jump along unitigs, windows of references, and a search that goes on from its states."""
    from mixtally.sources import fastx

    kmer_index.write(f"{tmp_path}/i", kmer_index.prepare(fastx.read_fasta(spark, f"{world[0]}/refs.fa")).select("ref_id", "name", "seq", "len"), 15)
    index = kmer_index.load(spark, f"{tmp_path}/i")
    reads = fastx.read_reads(spark, f"{world[0]}/reads.fq")
    quick = {"tolerance": 1e-4, "max_evaluations": 40}
    want = plans.quantify(reads, index, options=plans.Options(**quick))
    for options in (plans.Options(skip_ahead=True, windows=True, state=f"{tmp_path}/s", **quick), plans.Options(state=f"{tmp_path}/s", **quick)):
        out = plans.quantify(reads, index, options=options)
        assert out.em.freqs == pytest.approx(want.em.freqs, abs=1e-6) and out.counters == want.counters
    assert want.counters["removed"] == want.counters["mapped"] - want.counters["passed"] and want.counters["high_qualities"] == 0


def test_qualities_that_none_should_have(spark):
    from mixtally.operators import quality

    hist = quality.histogram(spark.createDataFrame([("K~L",), ("!",), ("",)], "qual string"))
    assert quality.unlikely(hist).first().n_high == 2 and quality.unlikely(hist.limit(0)).first().n_high == 0


def test_stream_finds_what_a_batch_finds(spark, world, tmp_path):
    from mixtally.operators import candidates
    from mixtally.sources import fastx

    refs = kmer_index.prepare(fastx.read_fasta(spark, f"{world[0]}/refs.fa"))
    kmer_ec, ecs = (x.persist() for x in kmer_index.build(refs, 15))
    rows = fastx.read_reads(spark, f"{world[0]}/reads.fq")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    index = {"k": 15, "kmer_ec": kmer_ec, "ecs": ecs}
    streaming.write_candidates(streaming.read_stream(spark, f"{tmp_path}/in", 1), index, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(r.read_id, r.ref_id, r.mode) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(r.read_id, r.ref_id, r.mode) for r in candidates.candidates(candidates.votes(kmer_index.match(rows, kmer_ec, 15), ecs)).collect()} and got


@pytest.mark.parametrize("argv", [["-c", "index", "-r", "x"], ["-c", "index", "-r", "x", "-i", "y", "-k", "4"], ["-c", "quantify", "-r", "x", "-f", "a", "-i", "y", "--paired"], ["-c", "quantify", "-r", "x", "-f", "a", "-i", "y", "--collapse"], ["-c", "tabulate"]])
def test_arguments_are_checked(argv):
    p = cli.parser()
    with pytest.raises(SystemExit):
        cli.checked(p.parse_args(argv), p)


def test_missing_and_stale_files(spark, world, tmp_path):
    import os

    p = cli.parser()
    with pytest.raises(FileNotFoundError, match="nowhere"):
        cli.run(spark, cli.checked(p.parse_args(["-c", "index", "-r", f"{tmp_path}/nowhere.fa", "-i", f"{tmp_path}/i"]), p))
    (tmp_path / "r.fa").write_text(">a\nACGUNACGTACGAAAAAAAAAAAA\n>a\nCC\n")
    (tmp_path / "r.fa.fai").write_text("a\t24\t3\t24\t25\n")
    got = []
    for age in (100, -100):
        at = (tmp_path / "r.fa").stat().st_mtime + age
        os.utime(tmp_path / "r.fa.fai", (at, at))
        got.append(cli.run(spark, cli.checked(p.parse_args(["-c", "index", "-r", f"{tmp_path}/r.fa", "-i", f"{tmp_path}/i{age}", "-k", "5"]), p)))
    assert got[0]["stale"] == [] and got[1]["stale"] == [f"{tmp_path}/r.fa"]
    assert (got[0]["n_other"], got[0]["n_u"], got[0]["n_poly_a"], got[0]["n_repeated_names"]) == (1, 1, 1, 1)


def test_least_range_of_hits(spark, world):
    from mixtally.sources import fastx

    refs = kmer_index.prepare(fastx.read_fasta(spark, f"{world[0]}/refs.fa"))
    kmer_ec, ecs = kmer_index.build(refs, 15)
    index = {"k": 15, "kmer_ec": kmer_ec, "ecs": ecs}
    seq = refs.where("ref_id = 1").first().seq
    rows = spark.createDataFrame([(0, seq[:60]), (1, seq[100:120] + "N" * 40)], "read_id long, seq string")
    found = [{r.read_id for r in plans.read_candidates(rows, index, plans.Options(min_range=n)).collect()} for n in (1, 20, 21, 60, 61)]
    assert found == [{0, 1}, {0, 1}, {0}, {0}, set()]
