"""FASTA and FASTQ files, plain or compressed, as DataFrames.

FASTA is read through Spark's text source with `>` at the beginning of a line as the record separator, so plain files split.
FASTQ has no safe separator (a quality line may begin with @), so each split finds its first whole record by its form and that
of those behind it, and the lines cut off at both ends of a split, which are one record at most, meet again in a small
group-by, which fails if they don't make whole records. Compressed files are one split each, but for blocked gzip (see `bgzf`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixtally.operators.ordering import numbered
from mixtally.sources import bgzf


def _files(paths: str | list[str]) -> list[str]:
    return [p.strip() for p in paths.split(",") if p.strip()] if isinstance(paths, str) else list(paths)


def _fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """(name, value, file, block, n): records of FASTA files, without the `>`; text before a file's first `>` is left out."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    # Only a file's first value may still have its `>`, and is no record without one.
    opening = raw.groupBy("file").agg(F.min(F.struct("block", "n")).alias("at")).select(F.col("file").alias("f"), "at.*")
    opening = opening.select("f", F.col("block").alias("b0"), F.col("n").alias("n0"))
    rows = raw.join(opening, F.col("file") == F.col("f")).withColumn("first", (F.col("block") == F.col("b0")) & (F.col("n") == F.col("n0")))
    begins = F.regexp_replace("value", "^[\r\n]+", "")
    value = F.when(~F.col("first"), F.col("value")).when(begins.startswith(">"), F.substring(begins, 2, 2**31 - 1))
    rows = rows.withColumn("value", value).where(F.trim(F.regexp_replace("value", "[\r\n]", "")) != "")
    return rows.select(F.regexp_extract("value", "^([^ \t\r\n]*)", 1).alias("name"), "value", "file", "block", "n")


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(ref_id, name, seq, file): sequences of FASTA files, a comma-separated list or a list.

    A record begins with `>` at the beginning of a line; elsewhere `>` is text. A name ends at the first blank; a sequence may
    take several lines. Of records with one name the first counts, in the order of the files and their records, and the others
    are dropped. ref_id counts from 0 in that order; it numbers references, of which there are few next to reads. Records
    without a sequence stay, with an empty one.
    """
    rows = None
    for i, path in enumerate(_files(paths)):
        own = _fasta_records(spark, path).withColumn("i", F.lit(i))
        rows = own if rows is None else rows.unionByName(own)
    body = F.regexp_replace(F.regexp_replace("value", "^[^\n]*\n?", ""), "[ \t\r\n]", "")
    rows = rows.select("name", body.alias("seq"), "file", F.struct("i", "file", "block", "n").alias("at"))
    first = rows.groupBy("name").agg(F.min_by("seq", "at").alias("seq"), F.min_by("file", "at").alias("file"), F.min("at").alias("at"))
    return numbered(first, "at", "ref_id").select("ref_id", "name", "seq", "file")


def repeated_names(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, n) of names that occur more than once in FASTA files."""
    rows = None
    for path in _files(paths):
        own = _fasta_records(spark, path)
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def _record(lines: list[str], i: int, last: bool = False) -> tuple[str, str, str, int] | None:
    """(name, sequence, qualities, next line) of the record that begins at lines[i]; None if it goes on behind the lines.

    Sequence and qualities may take several lines; blank ones among them count for nothing, but one quality line is always
    read, unless the file ends (last). ValueError if there is no record.
    """
    if not lines[i].startswith("@"):
        raise ValueError(f"no record at {lines[i][:80]!r}")
    seq, at = [], i + 1
    while at < len(lines) and not lines[at].startswith("+"):
        if lines[at][:1] in ("@", ">"):
            raise ValueError(f"no qualities of {lines[i][:80]!r}")
        seq.append(lines[at])
        at += 1
    if at == len(lines):
        return None
    size = sum(map(len, seq))
    qual, got, at = [], 0, at + 1
    while at < len(lines) and (not qual or got < size):
        qual.append(lines[at])
        got += len(lines[at])
        at += 1
    if got < size or (not qual and not last):
        return None
    if got > size:
        raise ValueError(f"malformed record {lines[i][:80]!r}: {size} bases, {got} qualities")
    word = lines[i][1:].split()
    return (word[0] if word and not lines[i][1:2].isspace() else ""), "".join(seq), "".join(qual), at


def _skip_blank(lines: list[str], i: int) -> int:
    while i < len(lines) and not lines[i]:
        i += 1
    return i


def _synced(lines: list[str], sure: int = 64) -> int | None:
    """The first line from which on records follow each other, `sure` of them or to the end of the lines, one whole at least."""
    for i, line in enumerate(lines):
        if not line.startswith("@"):
            continue
        at, n = i, 0
        try:
            while at < len(lines) and n < sure:
                got = _record(lines, at)
                if got is None:
                    break
                at, n = _skip_blank(lines, got[3]), n + 1
        except ValueError:
            continue
        if n:
            return i
    return None


class _Split:
    """The records of one split of a file, framed as its lines come."""

    def __init__(self, file: str, block: int):
        self.file, self.block, self.idx = file, block, 0
        self.lines: list[str] = []
        self.started, self.next_try = block == 0, 4096

    def rows(self, end: bool = False) -> Iterator[tuple]:
        """Whole records among the lines; at the split's end what is left of the last one, or lines that belong to an earlier one."""
        if not self.started and (end or len(self.lines) >= self.next_try):
            self.next_try *= 2
            at = _synced(self.lines)
            if at is None:
                if end:
                    yield self.file, self.block, -1, None, None, None, "\n".join(self.lines), None
                return
            self.started = True
            yield self.file, self.block, -1, None, None, None, "\n".join(self.lines[:at]), None
            self.lines = self.lines[at:]
        if not self.started:
            return
        at = _skip_blank(self.lines, 0)
        while at < len(self.lines):
            try:
                got = _record(self.lines, at)
            except ValueError as e:
                raise ValueError(f"{self.file}: {e}") from None
            if got is None:
                break
            yield self.file, self.block, self.idx, *got[:3], None, None
            self.idx += 1
            at = _skip_blank(self.lines, got[3])
        self.lines = self.lines[at:]
        if end:
            yield self.file, self.block, self.idx, None, None, None, None, "\n".join(self.lines)


def _framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (file, block, idx, name, seq, qual, head, tail): whole records, and a split's cut ends as lines."""
    split: _Split | None = None
    for batch in batches:
        out: list[tuple] = []
        for value, file, block in zip(batch["value"], batch["file"], batch["block"]):
            if split is None or (file, block) != (split.file, split.block):
                if split is not None:
                    out += split.rows(end=True)
                split = _Split(file, block)
            split.lines.append(value.rstrip("\r"))
            if len(split.lines) >= 4096:
                out += split.rows()
        if out:
            yield pd.DataFrame(out, columns=_FRAME)
    if split is not None:
        yield pd.DataFrame(list(split.rows(end=True)), columns=_FRAME)


#: Places in a file that a read's number has room for.
PLACES = 1 << 44
#: Index of the first record that begins in a split's leading lines, before the records found there.
EARLY = -(1 << 40)
_FRAME = ["file", "block", "idx", "name", "seq", "qual", "head", "tail"]
_FRAMED = "file string, block long, idx long, name string, seq string, qual string, head string, tail string"


def _mended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records from the lines that a file's splits left over, in order of the splits; each counts to where its first line stands."""
    for batch in batches:
        out: list[tuple] = []
        held: list[str] = []
        origin: list[tuple] = []
        begun: dict[tuple, int] = {}
        rows = list(batch.sort_values(["block", "idx"])[["file", "block", "idx", "head", "tail"]].itertuples(index=False))
        for k, (file, block, idx, head, tail) in enumerate(rows):
            text = head if head is not None else tail
            own = text.split("\n") if text else []
            held += own
            origin += [(file, block, idx)] * len(own)
            while (i := _skip_blank(held, 0)) < len(held):
                try:
                    got = _record(held, i, k == len(rows) - 1)
                except ValueError as e:
                    raise ValueError(f"{file}: {e}") from None
                if got is None:
                    break
                begun[origin[i]] = n = begun.get(origin[i], -1) + 1
                out.append((*origin[i][:2], origin[i][2] if origin[i][2] >= 0 else EARLY + n, *got[:3], None, None))
                held, origin = held[got[3] :], origin[got[3] :]
        if any(held):
            raise ValueError(f"{batch['file'].iloc[0]}: malformed, a record isn't whole: {next(x for x in held if x)[:80]!r}")
        yield pd.DataFrame(out, columns=_FRAME)


#: How names of blocked gzip files end.
BLOCKED = (".bgz", ".bgzf")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): lines of files, and the split or range of bytes that they stand in."""
    files = listed(spark, [path])[0]
    blocked = [f for f in files if f.endswith(BLOCKED)]
    if not blocked:
        return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    out = bgzf.read_lines(spark, blocked)
    plain = [f for f in files if not f.endswith(BLOCKED)]
    return out.unionByName(spark.read.text(plain).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))) if plain else out


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, name, seq, qual): records of FASTQ files, numbered from 0 in each file.

    Files named .bgz or .bgzf are blocked gzip, which is read in ranges like plain files; other compressed files are a split each.
    Sequence and qualities may take several lines. A name ends at the first blank. Unequal lengths of sequence and qualities are
    an error, as is a record cut off. Records without bases stay, blank lines between records don't count.
    """
    rows = _lines(spark, path).mapInPandas(_framed, _FRAMED)
    ends = rows.where("head IS NOT NULL OR tail IS NOT NULL").groupBy("file").applyInPandas(lambda pdf: next(_mended(iter([pdf]))), _FRAMED)
    whole = rows.where("name IS NOT NULL").unionByName(ends)
    counts = whole.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = counts.select("file", "block", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # Records that begin in what is left over from a split come before those that it found itself, or, one of them, behind.
    early = whole.where("idx < 0").groupBy("file", "block").agg(F.count("*").alias("early"))
    whole = whole.join(before, ["file", "block"]).join(early, ["file", "block"], "left")
    place = F.when(F.col("idx") < 0, F.col("idx") - EARLY).otherwise(F.col("idx") + F.coalesce("early", F.lit(0)))
    return whole.select("file", (F.col("before") + place).alias("ordinal"), "name", "seq", "qual")


def listed(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """The files of each entry, a file, folder or glob, in order of their paths, empty ones too: the listing that Spark's driver keeps for any scan.

    An empty authority is left out, as files' metadata leave it out.
    """
    return [sorted(re.sub("^([^:/]+:)///", r"\1/", f) for f in spark.read.format("binaryFile").load(path).inputFiles()) for path in paths]


def _numbered_reads(spark: SparkSession, paths: list[str], files: list[list[str]]) -> DataFrame:
    """(read_id, name, seq, qual): records with a sequence; read_id tells the file's number and the record's place in it."""
    out = None
    for i, path in enumerate(paths):
        rows = read_fastq(spark, path).where(F.length("seq") > 0).withColumn("entry", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    # Files that Spark lists twice, in two entries, are read twice, under two numbers.
    places = [(i, file) for i, entry in enumerate(files) for file in entry]
    numbers = spark.createDataFrame([(i, file, n) for n, (i, file) in enumerate(places)], "entry int, file string, number long")
    return out.join(numbers, ["entry", "file"]).select((F.col("number") * PLACES + F.col("ordinal")).alias("read_id"), "name", "seq", "qual")


def read_reads(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(read_id, name, seq, qual): reads with a sequence, of a list of FASTQ files, folders and globs.

    read_id is unique and the same in every run: files are numbered by their entry of the list, then by path, and records by their
    place in their file.
    """
    paths = _files(paths)
    return _numbered_reads(spark, paths, listed(spark, paths))


def read_pairs(spark: SparkSession, forward: str | list[str], reverse: str | list[str]) -> DataFrame:
    """(read_id, name1, seq1, qual1, name2, seq2, qual2): mates by place in their files; the longer file's rest is left out.

    Files of a folder or glob are mates in order of their paths; entries of unequal numbers of files are an error.
    """
    sides = [(paths, listed(spark, paths)) for paths in (_files(forward), _files(reverse))]
    counts = [[len(entry) for entry in files] for _, files in sides]
    if counts[0] != counts[1]:
        raise ValueError(f"entries of {counts[0]} forward and {counts[1]} reverse files")
    a, b = (_numbered_reads(spark, *side).select("read_id", *(F.col(c).alias(f"{c}{i}") for c in ("name", "seq", "qual"))) for i, side in enumerate(sides, 1))
    return a.join(b, "read_id")
