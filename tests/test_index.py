import random

import pytest

from mixtally.operators import candidates as Cd
from mixtally.operators import kmer_index, unitigs


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def kmers(s, k):
    return [min(s[i : i + k], revcomp(s[i : i + k])) for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")]


@pytest.fixture(scope="module")
def family():
    rng = random.Random(5)
    base = "".join(rng.choice("ACGT") for _ in range(120))
    near = base[:60] + rng.choice([c for c in "ACGT" if c != base[60]]) + base[61:]
    other = "".join(rng.choice("ACGT") for _ in range(90)) + base[:30]
    return {0: base, 1: near, 2: other, 3: revcomp(base[20:80]), 4: "ACG", 5: ""}


def classes(family, k):
    out = {}
    for ref, s in family.items():
        for w in kmers(s, k):
            out.setdefault(w, set()).add(ref)
    return out


def frame(spark, family, key="ref_id"):
    return spark.createDataFrame([(k, str(k), s) for k, s in family.items()], f"{key} long, name string, seq string")


def test_index_and_candidates(spark, family):
    k, rng = 9, random.Random(9)
    want = classes(family, k)
    kmer_ec, ecs = kmer_index.build(frame(spark, family), k)
    got = {r.kmer: set(r.members) for r in kmer_ec.join(ecs, "ec_id").collect()}
    assert got == want
    reads = {i: s for i, s in enumerate([family[0][10:60], revcomp(family[0][40:90]), family[2][70:110], family[1][:40] + family[2][:40], "N" * 30, "ACG", family[0][:30] + "N" + family[0][31:60]])}
    voted = Cd.votes(kmer_index.match(frame(spark, reads, "read_id"), kmer_ec, k), ecs)
    strict = {(r.read_id, r.ref_id) for r in Cd.strict(voted).collect()}
    mixed = {(r.read_id, r.ref_id, r.mode) for r in Cd.candidates(voted).collect()}
    for i, s in reads.items():
        hit = {frozenset(want[w]) for w in kmers(s, k) if w in want}
        common = frozenset.intersection(*hit) if hit else frozenset()
        assert {r for j, r in strict if j == i} == common
        if common or not hit:
            assert {(r, m) for j, r, m in mixed if j == i} == {(r, "strict") for r in common}
        else:
            n = {r: sum(r in h for h in hit) for h in hit for r in h}
            most = max(n.values())
            assert {(r, m) for j, r, m in mixed if j == i} == {(r, "lenient") for r in n if n[r] == most > 1}
    assert not [r for r in Cd.candidates(voted, allow_lenient=False).collect() if r.mode == "lenient"]
    none = {r.read_id for r in Cd.unmapped(frame(spark, reads, "read_id"), Cd.candidates(voted)).collect()}
    assert none == set(reads) - {j for j, _, _ in mixed}


def test_index_round_trip(spark, family, tmp_path):
    refs = kmer_index.prepare(frame(spark, family))
    kmer_index.write(str(tmp_path / "i"), refs, 7)
    got = kmer_index.load(spark, str(tmp_path / "i"))
    assert got["k"] == 7 and got["refs"].count() == len(family) and got["kmer_ec"].count() == len(classes(family, 7))
    spark.createDataFrame([(99, 7)], "version int, k int").write.mode("overwrite").parquet(str(tmp_path / "i/meta"))
    with pytest.raises(ValueError):
        kmer_index.load(spark, str(tmp_path / "i"))


def test_mates(spark):
    def f(rows):
        return spark.createDataFrame(rows, "read_id long, ref_id long")

    one, two = f([(1, 1), (1, 2), (2, 1), (3, 5), (5, 1)]), f([(1, 2), (1, 3), (2, 9), (4, 7)])
    hit1, hit2 = one.select("read_id").union(f([(4, 0)]).select("read_id")), two.select("read_id")
    strict = {(r.read_id, r.ref_id) for r in Cd.mates_strict(one, two, hit1, hit2).collect()}
    assert strict == {(1, 2), (3, 5), (5, 1)}  # 2: nothing common; 4: mate 1 hit, but has no candidate
    loose = {(r.read_id, r.ref_id) for r in Cd.mates_lenient(one, two).collect()}
    assert loose == {(1, 2), (2, 1), (2, 9), (3, 5), (4, 7), (5, 1)}
    assert {r.read_id for r in Cd.mates_lenient(one, two, limit=2).collect()} == {1, 3, 4, 5}


def test_supported_range(spark, family):
    kmer_ec, _ = kmer_index.build(frame(spark, family), 9)
    hits = kmer_index.hit_positions(frame(spark, {0: family[0][:40]}, "read_id"), kmer_ec, 9)
    assert kmer_index.supported_range(hits, 9, 40).count() == 1 and kmer_index.supported_range(hits, 9, 41).count() == 0


def test_unitigs_spell_the_kmers_once(spark, family):
    k = 9
    got = unitigs.unitigs(frame(spark, {i: family[i] for i in (0, 1, 2, 3)}), k).collect()
    spelled = [w for r in got for w in kmers(r.seq, k)]
    assert sorted(spelled) == sorted(classes({i: family[i] for i in (0, 1, 2, 3)}, k)) and len(spelled) == len(set(spelled))
    assert all(r.n_kmers == len(r.seq) - k + 1 for r in got)


def test_a_circle_is_one_unitig(spark):
    ring = "ACGGTCATTGACCTGAT"
    got = unitigs.unitigs(frame(spark, {0: ring + ring[:6]}), 7).collect()
    assert len(got) == 1 and got[0].n_kmers == len(ring)


@pytest.mark.parametrize("size", [23, 5000])
def test_circles_are_cut_at_their_least_node(spark, size, monkeypatch):
    """A circle of many k-mers beside a path, and a part of it on the other strand; few rounds whatever the length."""
    rng, k = random.Random(size), 21
    ring = "".join(rng.choice("ACGT") for _ in range(size))
    line = "".join(rng.choice("ACGT") for _ in range(60))
    seqs = {0: ring + ring[: k - 1], 1: line, 2: revcomp((ring + ring[: k - 1])[5:40])}
    rounds = []
    monkeypatch.setattr(unitigs, "checkpointed", lambda df, real=unitigs.checkpointed: rounds.append(1) or real(df))
    got = sorted(unitigs.unitigs(frame(spark, seqs), k).collect(), key=lambda r: -r.n_kmers)
    assert sorted(r.n_kmers for r in got) == sorted([size, 60 - k + 1])
    circle = next(r for r in got if r.n_kmers == size)
    assert circle.seq[: k - 1] == circle.seq[-(k - 1) :] and circle.seq[:k] == min(circle.seq[i : i + k] for i in range(size))
    assert sorted(kmers(circle.seq, k)) == sorted(kmers(seqs[0], k)) and len(rounds) <= 8


def test_targets_are_walks_along_unitigs(spark, family):
    from mixtally.operators import intervals

    k = 9
    seqs = {i: family[i] for i in (0, 1, 2, 3)} | {4: family[0][:30] + "N" + family[0][31:70], 5: "ACG"}
    paths = unitigs.unitigs(frame(spark, seqs), k).persist()
    walk = unitigs.map_targets(frame(spark, seqs), paths, k)
    spelled = {r.unitig: r.seq for r in paths.collect()}
    covered = {}
    for r in walk.collect():
        piece = spelled[r.unitig][r.start : r.stop + k - 1]
        piece = piece if r.sense else revcomp(piece)
        assert seqs[r.ref_id][r.pos : r.pos + len(piece)] == piece
        covered.setdefault(r.ref_id, []).extend(range(r.pos, r.pos + r.stop - r.start))
    for i, s in seqs.items():
        assert sorted(covered.get(i, [])) == [p for p in range(len(s) - k + 1) if "N" not in s[p : p + k]]
    rebuilt = intervals.rebuild(unitigs.target_pieces(walk, paths, k), "ref_id", "pos", "seq", k - 1)
    assert {r.ref_id: r.seq for r in rebuilt.collect() if r.ref_id < 4} == {i: seqs[i] for i in range(4)}
