import gzip
import random

import pytest

from mixtally.sources import bgzf, fastx, tables


def blocked(text, sizes):
    """A BGZF file of members of these sizes in turn."""
    out, at, i = b"", 0, 0
    while at < len(text):
        n = sizes[i % len(sizes)]
        out += bgzf.member(text[at : at + n])
        at, i = at + n, i + 1
    return out + bgzf.LAST


@pytest.mark.parametrize("sizes", [(1,), (7, 100), (40, 41, 3), (5000,)])
def test_every_line_once_by_any_ranges(tmp_path, sizes):
    rng = random.Random(3)
    text = "".join("x" * rng.choice([0, 1, 5, 60, 200]) + "\n" for _ in range(60)).encode()
    for body in (text, text + b"no end", b"\n\n", b"one line"):
        packed = blocked(body, sizes)
        assert gzip.decompress(packed) == body
        path = tmp_path / "x.bgz"
        path.write_bytes(packed)
        want = body.decode().removesuffix("\n").split("\n")
        for step in (1 << 20, len(packed) // 3 + 1, 333, 50):
            got = [x.decode() for a in range(0, len(packed), step) for lines in bgzf.range_lines(str(path), a, min(len(packed), a + step)) for x in lines]
            assert got == want


def test_signatures_inside_members(tmp_path):
    """Bytes that look like a member's beginning, stored in members, mislead no range."""
    rng = random.Random(5)
    fake = bgzf.member(b"no line\n")
    text = b"".join(fake.replace(b"\n", b" ") + b"|%d\n" % i + bytes(rng.randrange(32, 127) for _ in range(300)) + b"\n" for i in range(30))
    import struct
    import zlib

    def stored(t):
        pack = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = pack.compress(t) + pack.flush()
        return bgzf.SIGNATURE + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(t), len(t))

    packed = b"".join(stored(text[a : a + 900]) for a in range(0, len(text), 900)) + bgzf.LAST
    path = tmp_path / "x.bgz"
    path.write_bytes(packed)
    for step in (97, 500, 1 << 20):
        assert [x for a in range(0, len(packed), step) for lines in bgzf.range_lines(str(path), a, min(len(packed), a + step)) for x in lines] == text.removesuffix(b"\n").split(b"\n")


def test_broken_files(tmp_path):
    packed = bytearray(blocked(b"abc\n" * 100, (50,)))
    packed[20] ^= 1
    (tmp_path / "a.bgz").write_bytes(packed)
    with pytest.raises(ValueError, match="member"):
        list(bgzf.range_lines(str(tmp_path / "a.bgz"), 0, len(packed)))
    (tmp_path / "b.bgz").write_bytes(gzip.compress(b"abc\n"))
    with pytest.raises(ValueError, match="no member"):
        list(bgzf.range_lines(str(tmp_path / "b.bgz"), 0, 10))


def test_partitions_and_records(spark, tmp_path):
    """A file of eight members gives eight partitions, and the reads of the plain file."""
    rng = random.Random(9)
    text = ""
    for i in range(400):
        n = rng.randrange(1, 90)
        text += f"@r{i} x\n{''.join(rng.choice('ACGT') for _ in range(n))}\n+\n{''.join(rng.choice('@+I#') for _ in range(n))}\n"
    (tmp_path / "r.fq").write_text(text)
    size = len(text) // 8 + 1  # lines begin behind a newline of a member, so each has some
    packed = blocked(text.encode(), (size,))
    (tmp_path / "r.bgz").write_bytes(packed)
    rows = bgzf.read_lines(spark, [f"{tmp_path}/r.bgz"], 1000)  # no two members begin in one range
    blocks = {r.block for r in rows.select("block").distinct().collect()}
    assert len(blocks) == 8 and rows.rdd.getNumPartitions() >= 8
    plain = sorted(tuple(r)[1:] for r in fastx.read_fastq(spark, f"{tmp_path}/r.fq").collect())
    before = bgzf.read_lines.__defaults__
    try:
        bgzf.read_lines.__defaults__ = (1000,)
        assert sorted(tuple(r)[1:] for r in fastx.read_fastq(spark, f"{tmp_path}/r.bgz").collect()) == plain
        assert fastx.read_reads(spark, [f"{tmp_path}/r.*"]).count() == 800
    finally:
        bgzf.read_lines.__defaults__ = before


def test_written_files(spark, tmp_path):
    lines = spark.range(20000).selectExpr("concat('line ', id, repeat('x', id % 50)) AS line").repartition(3)
    bgzf.write_lines(lines, str(tmp_path / "out dir"))
    files = sorted((tmp_path / "out dir").iterdir())
    assert [f.name for f in files] == [f"part-0000{i}.bgz" for i in range(3)]
    assert sorted(x for f in files for x in gzip.decompress(f.read_bytes()).decode().splitlines()) == sorted(r.line for r in lines.collect())
    assert bgzf.read_lines(spark, [f.as_uri() for f in files], 5000).count() == 20000


def test_fetch_reads_what_is_asked_for(spark, tmp_path):
    """One in a hundred references costs about one in a hundred of the file's bytes; records of several lines too."""
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 400))) for _ in range(300)]
    text, index = "", ""
    for i, s in enumerate(seqs):
        head = f">s{i} about\n"
        width = rng.choice([60, 70, 1000])
        index += f"s{i}\t{len(s)}\t{len(text) + len(head)}\t{min(width, max(1, len(s)))}\t{min(width, max(1, len(s))) + 1}\n"
        text += head + "".join(s[k : k + width] + "\n" for k in range(0, len(s), width))
    (tmp_path / "r.fa").write_text(text)
    (tmp_path / "r.fa.fai").write_text(index)
    fai = tables.read_fai(spark, f"{tmp_path}/r.fa.fai")
    counted = spark.sparkContext.accumulator(0)
    wanted = spark.createDataFrame([(7,), (107,), (207,), (7,), (5000,)], "ref_id int")
    got = {r.ref_id: (r.name, r.seq) for r in tables.fetch(fai, f"{tmp_path}/r.fa", wanted, counted).collect()}
    assert got == {i: (f"s{i}", seqs[i]) for i in (7, 107, 207)}
    assert counted.value <= sum(len(seqs[i]) * 1.1 for i in (7, 107, 207)) < 0.03 * len(text)
    assert {r.ref_id: r.seq for r in tables.fetch(fai, f"{tmp_path}/r.fa", fai).collect()} == dict(enumerate(seqs))
    with pytest.raises(Exception, match="index"):
        tables.fetch(fai, f"{tmp_path}/r.fa", fai.selectExpr("ref_id")).sparkSession  # the plan alone reads nothing
        (tmp_path / "r.fa").write_text(text[:100])
        tables.fetch(fai, f"{tmp_path}/r.fa", fai).collect()
