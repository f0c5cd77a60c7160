import random

import pytest

from mixtally.operators import align, windows

K = 15


@pytest.fixture(scope="module")
def world(spark):
    """Twelve strains that share a middle part, and reads of it, of the ends, and strangers."""
    rng = random.Random(6)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    middle = dna(400)
    refs = {i: dna(150 + 10 * i) + middle + dna(100) for i in range(12)}
    reads = {}
    for i in range(20):
        at = rng.randrange(40, 260)
        s = list(middle[at : at + 100])
        for _ in range(i % 4):
            k = rng.randrange(len(s))
            s[k : k + rng.randrange(2)] = [rng.choice("ACGT")]
        reads[i] = "".join(s)
    reads |= {20: refs[3][:90], 21: refs[3][-90:], 22: dna(80), 23: "", 24: "ACG", 25: refs[5][:60] + refs[5][200:260]}
    rows = [(r, t, s, "?" * len(s)) for r, s in reads.items() for t in refs]
    return spark.createDataFrame(rows, "read_id long, ref_id int, seq string, qual string"), spark.createDataFrame(list(refs.items()), "ref_id int, seq string"), reads, refs


def test_as_whole_references_give(world):
    cands, refs, reads, whole = world
    got = {(r.read_id, r.ref_id): r for r in windows.score(cands, refs, K).collect()}
    assert len(got) == cands.count()
    for (read, ref), r in got.items():
        a = align.align(reads[read], whole[ref])
        if read < 22 or read == 23 or read == 24 or ref == 5:
            assert (r.score, r.ref_begin, r.ref_end, r.read_begin, r.read_end, r.mismatches, r.cigar) == tuple(vars(a).values()), (read, ref)


def test_a_family_is_aligned_once(world):
    """Of reads of what all strains share, one alignment for each read instead of one for each strain."""
    cands, refs, _, whole = world
    rows = windows.cut(cands.where("read_id < 20"), refs, K)
    assert rows.count() == 20 * len(whole) and windows.distinct(rows).count() == 20
    assert all(whole[r.ref_id][r.at : r.at + len(r.window)] == r.window and len(r.window) < 200 for r in rows.collect())


def test_no_hit_means_the_whole(world):
    cands, refs, _, whole = world
    rows = windows.cut(cands.where("read_id IN (22, 23)"), refs, K).collect()
    assert all(r.window == whole[r.ref_id] and r.at == 0 for r in rows) and len(rows) == 2 * len(whole)
    assert windows.score(cands.limit(0), refs, K).collect() == []
