import random

import pytest

from mixtally.functions import sequences as S


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_canonical_kmers_match_plain_python(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 4, 5, 6, 40)] + ["ACGTNACGTA", "NNNNNN"]
    rows = spark.createDataFrame(list(enumerate(seqs)), "i int, s string").select("i", S.canonical_kmers("s", 5).alias("k")).collect()
    for r in rows:
        s = seqs[r.i]
        want = [min(w, revcomp(w)) if set(w) <= set("ACGT") else None for w in (s[j : j + 5] for j in range(len(s) - 4))]
        assert r.k == want


def test_canonical_is_idempotent_and_strand_free(spark):
    rows = spark.createDataFrame([("ACGTT",), ("TTTTT",), ("GATTC",)], "s string").select(S.canonical("s").alias("c"), S.canonical(S.canonical("s")).alias("cc"), S.canonical(S.reverse_complement("s")).alias("r"))
    assert all(r.c == r.cc == r.r for r in rows.collect())


def test_encode_and_decode(spark):
    assert one(spark, S.encode("s"), s="ACGT") == 0b00011011
    assert one(spark, S.decode(S.encode("s"), 31), s="T" * 31) == "T" * 31
    assert one(spark, S.encode("s"), s="T" * 31) == 4**31 - 1


@pytest.mark.parametrize("k", [2, 1, 0, 32, 33, 4])
def test_bad_k(k):
    with pytest.raises(ValueError):
        S.check_k(k)


def test_normalise_and_clip(spark):
    got = one(spark, S.normalise("s", "n"), s="acguNNacgt", n="x")
    assert got[:4] == "ACGT" and got[6:] == "ACGT" and set(got) <= set("ACGT")
    assert got == one(spark, S.normalise("s", "n"), s="ACGUNNACGT", n="x")
    assert one(spark, S.clip_poly_a("s"), s="CC" + "A" * 12) == "CC"
    assert one(spark, S.clip_poly_a("s"), s="CC" + "A" * 9) == "CC" + "A" * 9


def test_small_functions(spark):
    assert one(spark, S.split_exact("s", "; "), s="a; b; ") == ["a", "b"]
    assert one(spark, S.hamming("a", "b"), a="ACGT", b="AGGA") == 2
    assert one(spark, S.hamming("a", "b"), a="ACGT", b="AG") is None
    assert one(spark, S.neighbours("a"), a="ACG") == ["CGA", "CGC", "CGG", "CGT", "AAC", "CAC", "GAC", "TAC"]
    assert one(spark, S.hexamer("a"), a="AAAAACGT") == 1
    assert one(spark, S.cigar_units("a"), a="2S3=1X1I2D1=") == [1, 1, 0, 0, 0, 1, 1, 0]
    assert one(spark, S.cigar_deletions("a"), a="2S3=1X1I2D1=") == 2
    assert one(spark, S.thousands("a"), a=1234567) == "1,234,567"


def test_error_probability(spark):
    assert one(spark, S.error_probability("q"), q="+") == pytest.approx(0.1)
    assert one(spark, S.error_probability("q", 64), q="B") == pytest.approx(0.75)
    with pytest.raises(Exception, match="below the offset"):
        one(spark, S.error_probability("q"), q=" ")


@pytest.mark.parametrize("x, want", [(0.0, "0"), (12345.678, "12345.7"), (123.456789, "123.46"), (12.34567, "12.35"), (0.0123456, "0.01235")])
def test_significant(spark, x, want):
    assert one(spark, S.significant("x"), x=x) == want


def test_lineage(spark):
    assert one(spark, S.lineage("s"), s="A;B;C;") == ["A", "B", "C", "unknown_C_order", "unknown_C_family", "unknown_C_genus", "unknown_C_species"]
    assert one(spark, S.lineage("s", "; ", True), s="k__A; p__B; f__; g__; s__")[:3] == ["A", "B", "unknown_B_class"]
    assert one(spark, S.lineage("s"), s="single") == ["single"]
    assert len(one(spark, S.lineage("s"), s="a;b;c;d;e;f;g;h")) == 8


def test_nulls(spark):
    rows = spark.createDataFrame([(None,)], "s string").select(S.canonical("s"), S.encode("s"), S.reverse_complement("s"), S.clip_poly_a("s"))
    assert list(rows.first()) == [None] * 4
