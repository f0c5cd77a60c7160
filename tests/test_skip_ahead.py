import random

import pytest

from mixtally.operators import kmer_index, skip_ahead
from tests.test_index import classes, frame, kmers, revcomp

K = 11


@pytest.fixture(scope="module")
def strains():
    """References that share stretches: strains of one sequence, a piece in reverse, and strangers."""
    rng = random.Random(17)
    base = "".join(rng.choice("ACGT") for _ in range(600))
    out = {0: base}
    for i in range(1, 6):
        s = list(base)
        for _ in range(3):
            at = rng.randrange(600)
            s[at] = rng.choice("ACGT")
        out[i] = "".join(s)
    return out | {6: revcomp(base[100:300]), 7: "".join(rng.choice("ACGT") for _ in range(400)), 8: "ACG"}


@pytest.fixture(scope="module")
def index(spark, strains):
    refs = frame(spark, strains)
    kmer_ec, ecs = kmer_index.build(refs, K)
    return skip_ahead.segments(refs, kmer_ec, K).persist(), {r.ec_id: set(r.members) for r in ecs.collect()}


def test_segments(index, strains):
    rows = index[0].collect()
    want = classes(strains, K)
    assert len(rows) == len(want) and all(index[1][r.ec_id] == want[r.kmer] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.segment, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own))) and len({r.ec_id for r in own}) == 1
        text = [r.kmer if r.forward else revcomp(r.kmer) for r in own]
        assert all(a[1:] == b[:-1] for a, b in zip(text, text[1:]))
    assert len(by) < len(rows) / 5


def test_same_classes_and_few_probes(spark, index, strains):
    rng = random.Random(3)
    reads = {}
    for i in range(200):
        ref = strains[rng.choice([0, 1, 2, 3, 4, 5, 6, 7])]
        at = rng.randrange(len(ref) - 150)
        reads[i] = ref[at : at + 150] if i % 2 else revcomp(ref[at : at + 150])
    counts = []
    got = {}
    for r in skip_ahead.match(frame(spark, reads, "read_id"), index[0], K, counts=counts).collect():
        got.setdefault(r.read_id, set()).add(frozenset(index[1][r.ec_id]))
    want = classes(strains, K)
    assert got == {i: {frozenset(want[w]) for w in kmers(s, K) if w in want} for i, s in reads.items()}
    assert sum(counts) * 5 <= sum(len(kmers(s, K)) for s in reads.values())


def test_reads_of_any_kind(spark, index, strains):
    """Too short, other letters, misses, and reads that leave the graph and come back: no class that windows don't have, and all at ends."""
    base = strains[0]
    rng = random.Random(4)
    stranger = "".join(rng.choice("ACGT") for _ in range(60))
    reads = {0: "", 1: "ACGT", 2: "N" * 40, 3: stranger, 4: base[:50] + stranger + base[200:260], 5: stranger + base[10:70], 6: base[:40] + "N" + base[41:90], 7: base[5 : 5 + K], 8: base[5 : 6 + K], 9: base[50:120].lower(), 10: strains[7][:70] + strains[7][200:290]}
    got = {}
    for r in skip_ahead.match(frame(spark, reads, "read_id"), index[0], K).collect():
        got.setdefault(r.read_id, set()).add(frozenset(index[1][r.ec_id]))
    want = classes(strains, K)
    assert got == {i: w for i, s in reads.items() if (w := {frozenset(want[x]) for x in kmers(s.upper(), K) if x in want})}
    assert skip_ahead.match(frame(spark, {0: ""}, "read_id").limit(0), index[0], K).collect() == []


def test_where_it_may_differ(spark, index):
    """A read with one letter changed between windows that agree: other classes of the windows across it aren't asked for."""
    rows = index[0].groupBy("segment").count().orderBy("count", ascending=False).first()
    own = sorted((r for r in index[0].where(f"segment = {rows.segment}").collect()), key=lambda r: r.place)
    text = own[0].kmer if own[0].forward else revcomp(own[0].kmer)
    for r in own[1:]:
        text += (r.kmer if r.forward else revcomp(r.kmer))[-1]
    at = len(text) // 3
    read = text[:at] + ("A" if text[at] != "A" else "C") + text[at + 1 :]
    got = skip_ahead.match(frame(spark, {0: read}, "read_id"), index[0], K).collect()
    assert [r.ec_id for r in got] == [own[0].ec_id]


def test_only_reads_are_shuffled(spark, strains, tmp_path):
    """A written index is in buckets by k-mer, sorted, and joins on the k-mer exchange the other side alone."""
    refs = frame(spark, strains)
    kmer_index.write(str(tmp_path / "i"), refs, K, buckets=5)
    index = kmer_index.load(spark, str(tmp_path / "i"))
    assert kmer_index.load(spark, str(tmp_path / "i"))["kmer_ec"].count() == len(classes(strains, K))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = kmer_index.sequence_kmers(refs, K, "ref_id").join(index["kmer_ec"].select("kmer", "ec_id"), "kmer")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 5 out of 5" in plan
        assert joined.groupBy("ref_id").count().count() == 8
        found = kmer_index.match(frame(spark, {1: strains[1]}, "read_id"), index["kmer_ec"], K)
        again = skip_ahead.match(frame(spark, {1: strains[1]}, "read_id"), index["kmer_ec"], K)
        assert {r.ec_id for r in found.collect()} == {r.ec_id for r in again.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
