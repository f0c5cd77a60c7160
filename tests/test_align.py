import math
import random

import pytest

from mixtally.operators import align as A
from tests import plain_align


def plain(read, ref):
    """Best local score, all cells visited."""
    codes = {"A": 0, "C": 1, "G": 2, "T": 3}
    n, m, low = len(read), len(ref), -(10**6)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    e = [[low] * (m + 1) for _ in range(n + 1)]
    f = [[low] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            a, b = codes.get(read[i - 1], 4), codes.get(ref[j - 1], 4)
            s = 0 if 4 in (a, b) else 2 if a == b else -2
            e[i][j] = max(e[i - 1][j] - 1, h[i - 1][j] - 3)
            f[i][j] = max(f[i][j - 1] - 1, h[i][j - 1] - 3)
            h[i][j] = max(0, h[i - 1][j - 1] + s, e[i][j], f[i][j])
    return max(map(max, h))


def rescored(a, read, ref):
    """The score that an alignment's own steps add up to."""
    i, j, score, n = 0, a.ref_begin, 0, 0
    for c in a.cigar:
        if c.isdigit():
            n = 10 * n + int(c)
            continue
        if c == "S":
            i += n
        elif c in "=X":
            for _ in range(n):
                x, y = read[i], ref[j]
                assert (x == y) == (c == "=")
                score += 0 if "N" in (x, y) else 2 if x == y else -2
                i, j = i + 1, j + 1
        elif c == "I":
            score -= 3 + (n - 1)
            i += n
        else:
            score -= 3 + (n - 1)
            j += n
        n = 0
    assert i == len(read) and j == a.ref_end + 1
    return score


@pytest.mark.parametrize("seed", range(40))
def test_score_and_trace(seed):
    rng = random.Random(seed)
    ref = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 70)))
    at = rng.randrange(len(ref))
    read = list(ref[at : at + rng.randrange(1, 40)])
    for _ in range(rng.randrange(6)):
        k = rng.randrange(len(read) + 1)
        kind = rng.randrange(3)
        if kind == 0 and k < len(read):
            read[k] = rng.choice("ACGTN")
        elif kind == 1:
            read.insert(k, rng.choice("ACGT"))
        elif k < len(read) and len(read) > 1:
            del read[k]
    read = "".join(read)
    a = A.align(read, ref)
    assert a.score == plain(read, ref)
    if a.score:
        assert rescored(a, read, ref) == a.score


def edited(rng, letters="ACGT", longest=70):
    """A reference, and a piece of it with some edits."""
    ref = "".join(rng.choice(letters) for _ in range(rng.randrange(1, longest)))
    at = rng.randrange(len(ref))
    read = list(ref[at : at + rng.randrange(1, 40)])
    for _ in range(rng.randrange(8)):
        k, kind = rng.randrange(len(read) + 1), rng.randrange(3)
        if kind == 0 and k < len(read):
            read[k] = rng.choice(letters + "N")
        elif kind == 1:
            read[k:k] = [rng.choice(letters) for _ in range(rng.randrange(1, 4))]
        elif k < len(read) and len(read) > 1:
            del read[k]
    return "".join(read), ref


@pytest.mark.parametrize("letters, longest, scoring", [("ACGT", 70, A.Scoring()), ("AC", 50, A.Scoring()), ("ACGTN", 90, A.Scoring()), ("ACN", 60, A.Scoring(1, 3, 5, 2)), ("AG", 40, A.Scoring(5, 1, 2, 2))])
def test_equals_the_full_table(letters, longest, scoring):
    """Begins, ends and cigars of many pairs at once, ties too, are those of the full table of each pair."""
    rng = random.Random(longest)
    pairs = [edited(rng, letters, longest) for _ in range(2500)]
    pairs += [("".join(rng.choice(letters) for _ in range(rng.randrange(25))), "".join(rng.choice(letters) for _ in range(rng.randrange(40)))) for _ in range(500)]
    assert A.align_pairs(pairs, scoring) == [plain_align.align(*p, scoring) for p in pairs]


def test_long_pairs_need_no_table():
    """5,000 bases against 20,000: the table would take 400 MB in each of three arrays."""
    import tracemalloc

    rng = random.Random(8)
    ref = "".join(rng.choice("ACGT") for _ in range(20_000))
    read = list(ref[7000:12_000])
    for k in range(0, 5000, 10):
        read[k + 5] = "ACGT"[("ACGT".index(read[k + 5]) + 1) % 4]
    del read[2500:2530]
    tracemalloc.start()
    a = A.align("".join(read), ref)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (a.ref_begin, a.ref_end, a.cigar.count("D")) == (7000, 11_999, 1) and rescored(a, "".join(read), ref) == a.score
    assert most < 100e6


def test_scores_beyond_16_bits():
    seq = "".join(random.Random(1).choice("ACGT") for _ in range(9000))
    assert A.align_pairs([(seq, seq), (seq[:50], seq[20:90])])[0].score == 18_000


def test_query_equals_the_full_table(spark):
    """All rows of local_alignment, by value."""
    from mixtally import catalogue

    sf = "/root/testdata/sf0.01"
    rows = catalogue.local_alignment(spark, sf).collect()
    reads = {r.read_id: r.seq for r in catalogue.reads(spark, sf).collect()}
    refs = {r.ref_id: r.seq for r in catalogue.references(spark, sf).collect()}
    pairs = {(r.read_id, r.ref_id) for r in catalogue.pseudoalign_strict(spark, sf).collect()}
    assert {(r.read_id, r.ref_id) for r in rows} == pairs and len(rows) == len(pairs) > 20
    for r in rows:
        a = plain_align.align(reads[r.read_id], refs[r.ref_id])
        assert (r.score, r.ref_begin, r.ref_end, r.read_begin, r.read_end, r.mismatches, r.cigar) == tuple(vars(a).values())
        assert r.loglik == pytest.approx(A.log_likelihood(a.cigar, "?" * len(reads[r.read_id])))


def test_known_alignments():
    assert A.align("ACGT", "TTACGTTT") == A.Alignment(8, 2, 5, 0, 3, 0, "4=")
    assert A.align("NNACGTACGT", "ACGTACGT").cigar == "2S8="
    assert A.align("", "ACGT") == A.NOTHING and A.align("AAAA", "CCCC") == A.NOTHING
    long = "ACGGTCATTGACCTGATCGA"
    assert A.align(long[:10] + long[11:], long).cigar.count("D") == 1
    # Of equal ends the first in the reference.
    assert A.align("ACGTA", "ACGTACCACGTA").ref_begin == 0


def test_many_matches_do_not_overflow():
    seq = "ACGT" * 100
    assert A.align(seq, seq).score == 800


def test_log_likelihood():
    e = 10 ** -3
    assert A.log_likelihood("4=", "????") == pytest.approx(4 * math.log(1 - e))
    assert A.log_likelihood("1S2=1X2D", "????") == pytest.approx(2 * math.log(1 - e) + 2 * math.log(e / 3) - 4)
    assert math.isfinite(A.log_likelihood("1=", "!"))
    assert A.log_likelihood("1=", "B", 64) == pytest.approx(math.log(0.25))
    with pytest.raises(ValueError):
        A.log_likelihood("4=", "???")
    with pytest.raises(ValueError):
        A.log_likelihood("1=", " ")


def test_udf_and_pairs(spark):
    ref = "ACGGTCATTGACCTGATCGATTTACGGAC"
    rows = spark.createDataFrame([(1, 0, ref[3:13], "?" * 10, ref)] * 2 + [(2, 0, None, None, ref)], "read_id long, ref_id int, seq string, qual string, ref_seq string")
    got = A.score_single(rows).orderBy("read_id").collect()
    assert [r.cigar for r in got] == ["10=", "10=", ""] and got[0].loglik == got[1].loglik and got[2].loglik is None
    back = ref[15:25][::-1].translate(str.maketrans("ACGT", "TGCA"))
    pair = spark.createDataFrame([(1, 0, ref[3:13], "?" * 10, back, "?" * 9 + "+", ref)], "read_id long, ref_id int, seq1 string, qual1 string, seq2 string, qual2 string, ref_seq string")
    r = A.score_paired(pair).first()
    assert (r.cigar1, r.cigar2) == ("10=", "10=")
    assert r.loglik == pytest.approx(A.log_likelihood("10=", "?" * 10) + A.log_likelihood("10=", "+" + "?" * 9))
