"""Tables that accompany sequences, and the result tables: readers and writers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixtally.functions.sequences import significant
from mixtally.operators import diversity, taxonomy
from mixtally.operators.ordering import numbered, running_total
from mixtally.sources import bgzf

FAI = "name string, length long, offset long, linebases int, linewidth int"


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file with their order."""
    return spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, name, length, offset, linebases, linewidth) of a FASTA index. The first line of a name counts; ref_id is its place."""
    f = F.split("value", "\t")
    rows = _numbered(spark, path).where(F.size(f) >= 5).select("at", f[0].alias("name"), f[1].cast("long").alias("length"), f[2].cast("long").alias("offset"), f[3].cast("int").alias("linebases"), f[4].cast("int").alias("linewidth"))
    cols = ["length", "offset", "linebases", "linewidth"]
    first = rows.groupBy("name").agg(F.min("at").alias("at"), *(F.min_by(c, "at").alias(c) for c in cols))
    return numbered(first, "at", "ref_id").select("ref_id", "name", *cols)


def make_fai(refs: DataFrame) -> DataFrame:
    """The index of single-line FASTA that has these references (ref_id, name, seq) in order."""
    rows = running_total(refs.select("ref_id", "name", F.length("seq").alias("n")), "ref_id", F.length("name") + 2 + F.col("n") + 1, "before")
    return rows.select("name", F.col("n").cast("long").alias("length"), (F.col("before") + F.length("name") + 2).alias("offset"), F.col("n").alias("linebases"), (F.col("n") + 1).alias("linewidth"))


def fetch(fai: DataFrame, fasta: str, wanted: DataFrame, counted=None) -> DataFrame:
    """(ref_id, name, seq): the sequences of the references in `wanted` (ref_id), read from a FASTA file by its index's offsets.

    fai: as `read_fai` gives it. A task reads the byte ranges of its references, a contiguous part of the file's, and nothing else;
    sequences may take several lines. The file is opened through Arrow's file systems (local, S3, GCS, HDFS by URI). An index that
    points beyond the file is an error; a reference that the index doesn't have is left out; one asked for twice is given once.
    counted: an accumulator that gets the number of bytes read.
    """
    rows = fai.join(wanted.select("ref_id").distinct(), "ref_id").select("ref_id", "name", "length", "offset", "linebases", "linewidth")
    rows = rows.repartitionByRange("offset").sortWithinPartitions("offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = bgzf.opened(fasta)
        file = None
        for batch in batches:
            file = file or system.open_input_file(path)
            out = []
            for length, offset, bases, width in zip(*(batch.column(c).to_pylist() for c in ("length", "offset", "linebases", "linewidth"))):
                size = (length - 1) // bases * width + (length - 1) % bases + 1 if length else 0
                raw = file.read_at(size, offset)
                if counted is not None:
                    counted.add(size)
                seq = raw.translate(None, b"\r\n")
                if len(seq) != length:
                    raise ValueError(f"{fasta} isn't the file of its index: {len(seq)} bases at byte {offset}, not {length}")
                out.append(seq.decode())
            yield pa.RecordBatch.from_arrays([batch.column("ref_id"), batch.column("name"), pa.array(out, pa.string())], names=["ref_id", "name", "seq"])

    return rows.mapInArrow(read, "ref_id int, name string, seq string")


def missing_files(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Those of the paths (globs too) at which there is no file."""
    conf, Path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    out = []
    for name in [p.strip() for p in paths.split(",") if p.strip()] if isinstance(paths, str) else paths:
        path = Path(name)
        if not path.getFileSystem(conf).globStatus(path):
            out.append(name)
    return out


def stale_index(spark: SparkSession, fasta: str, fai: str) -> bool:
    """Whether the FASTA file is newer than its index."""
    def changed(path: str):
        return spark.read.format("binaryFile").load(path).agg(F.max("modificationTime")).first()[0]

    return changed(fasta) > changed(fai)


def read_taxonomy(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, label) of taxonomy files: two tab-separated columns; other lines are left out. The first line of a name counts."""
    files = [p.strip() for p in paths.split(",")] if isinstance(paths, str) else paths
    f = F.split("value", "\t")
    rows = None
    for i, path in enumerate(files):
        own = _numbered(spark, path).where(F.size(f) == 2).select(f[0].alias("name"), F.trim(f[1]).alias("label"), F.struct(F.lit(i).alias("i"), "at").alias("at"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("name").agg(F.min_by("label", "at").alias("label"))


def taxonomy_format(labels: DataFrame) -> tuple[str, bool]:
    """Delimiter and prefixing, from one label."""
    first = labels.select("label").head(1)
    if not first:
        raise ValueError("the taxonomy is empty")
    return taxonomy.sniff(first[0][0])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sample, path) of a sample list: two columns, separated by a tab or else by a comma."""
    f = F.when(F.col("value").contains("\t"), F.split("value", "\t")).otherwise(F.split("value", ","))
    return spark.read.text(path).where(F.size(f) == 2).select(F.trim(f[0]).alias("sample"), F.trim(f[1]).alias("path"))


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """(label, cnt, taxon) of a sample's result, by reference or by taxon. Lines of another width are left out; another header is an error."""
    lines = spark.read.text(path)
    head = lines.head(1)
    columns = head[0][0].split("\t") if head else []
    want = 3 if columns[:1] == ["Label"] else 5 if columns[:1] == ["taxlevel"] else 0
    if not want:
        raise ValueError(f"{path} doesn't begin with a header of results")
    f = F.split("value", "\t")
    rows = lines.where((F.size(f) == want) & (f[0] != columns[0]))
    return rows.select(f[0].alias("label"), f[1].cast("double").alias("cnt"), f[2].alias("taxon")) if want == 3 else rows.select(f[1].alias("label"), f[4].cast("double").alias("cnt"), f[2].alias("taxon"))


def malformed_lines(spark: SparkSession, path: str) -> int:
    """How many lines of a sample's result `read_result` leaves out: those of another width than the header's."""
    lines = spark.read.text(path)
    head = lines.head(1)
    width = len(head[0][0].split("\t")) if head else 0
    return lines.where(F.size(F.split("value", "\t")) != width).count()


def unlabelled(freqs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key) of frequencies without a label, which `result_rows` leaves out."""
    return freqs.select("key").join(labels.select("key"), "key", "left_anti")


def _qualified(spark: SparkSession, path: str) -> str:
    """A path as files' metadata name it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().getPath()


def read_samples(spark: SparkSession, manifest: str) -> DataFrame:
    """(sample, label, cnt, taxon) of all results in a sample list, in one plan. The list is short: a row for each sample.

    Lines of another width than their file's header has are left out; a sample without a header of results is an error.
    """
    listed = read_manifest(spark, manifest).collect()
    if not listed:
        raise ValueError(f"{manifest} lists no samples")
    known = spark.createDataFrame([(r["sample"], _qualified(spark, r.path)) for r in listed], "sample string, path string")
    place = F.regexp_replace(F.regexp_replace("_metadata.file_path", "^[a-zA-Z0-9+.-]+:(//[^/]*)?", ""), "/+", "/")
    lines = spark.read.text(sorted({r.path for r in listed})).select(F.split("value", "\t").alias("f"), F.url_decode(F.replace(place, F.lit("+"), F.lit("%2B"))).alias("file"))
    # A sample's path is a file or the folder of its parts.
    lines = lines.withColumn("path", F.explode(F.array("file", F.regexp_replace("file", "/[^/]*$", "")))).join(F.broadcast(known), "path").select("sample", "f")
    first, width = F.col("f")[0], F.size("f")
    lines = lines.withColumn("head", F.when((first == "Label") & (width == 3), 3).when((first == "taxlevel") & (width == 5), 5))
    kinds = lines.groupBy("sample").agg(F.max("head").alias("want"))
    lines = lines.join(F.broadcast(kinds), "sample").withColumn("want", F.coalesce("want", F.raise_error(F.concat("sample", F.lit(" doesn't begin with a header of results"))).cast("int")))
    rows = lines.where((width == F.col("want")) & F.col("head").isNull())
    by_taxon = F.col("want") == 5
    return rows.select("sample", F.when(by_taxon, F.get("f", 1)).otherwise(F.get("f", 0)).alias("label"), F.when(by_taxon, F.get("f", 4)).otherwise(F.get("f", 1)).cast("double").alias("cnt"), F.get("f", 2).alias("taxon"))


def write_tsv(df: DataFrame, path: str, header: bool = True, compression: str | None = None) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header, compression=compression or "none", quote="", escapeQuotes=False)


def result_rows(freqs: DataFrame, labels: DataFrame, mapped: float) -> DataFrame:
    """(Label, ExpectedCounts, Taxa) by reference. freqs: (key, f); labels: (key, label). Keys without a label are left out."""
    return freqs.join(labels, "key").select(F.col("key").alias("Label"), significant(F.col("f") * mapped).alias("ExpectedCounts"), F.col("label").alias("Taxa"))


def collapse_rows(rolled: DataFrame) -> DataFrame:
    """(taxlevel, rankID, taxon, daughterlevels, expected_counts) of `rolled_counts`, parents before children."""
    order = F.transform(F.split("rank_id", "[.]"), lambda x: x.cast("int"))
    return rolled.orderBy(order).select(F.col("level").alias("taxlevel"), F.col("rank_id").alias("rankID"), F.col("name").alias("taxon"), F.col("daughters").alias("daughterlevels"), significant("expected_count").alias("expected_counts"))


def failed_rows(unmapped: DataFrame, improbable: DataFrame) -> DataFrame:
    """(name, reason): reads that failed, pseudomapping or likelihood."""
    return unmapped.select("name", F.lit("Pseudomapping_Fails").alias("reason")).unionByName(improbable.select("name", F.lit("Likelihood_Filter_Fails").alias("reason")))


def readinfo_rows(post: DataFrame, reads: DataFrame, names: DataFrame, failed: DataFrame) -> DataFrame:
    """(name, info): of each read its references with posteriors, highest first, or why it has none.

    post: posterior(...); reads: (read_id, name); names: (key, ref); failed: failed_rows(...).
    """
    label = F.when(F.col("p") == 1, F.concat(F.lit("1:"), F.col("ref"))).otherwise(F.concat(F.format_string("%.6g", "p"), F.lit(":"), F.col("ref")))
    each = post.join(names, "key", "left").where("key IS NULL OR ref IS NOT NULL")
    rows = each.groupBy("read_id").agg(F.reverse(F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("p", "ref", label.alias("s")))))).alias("a"), F.max(F.when(F.col("key").isNull(), F.col("status"))).alias("why"))
    none = F.when(F.col("why") == "even", "Even_PostEM").otherwise("EM_Unmap")
    found = rows.join(reads, "read_id").select("name", F.when(F.col("why").isNull(), F.array_join(F.transform("a", lambda x: x["s"]), " ")).otherwise(none).alias("info"))
    return found.unionByName(failed.select("name", F.when(F.col("reason") == "Pseudomapping_Fails", "MapFail").otherwise("LikeFail").alias("info")))


def write_tabulation(otu: DataFrame, path: str) -> None:
    """Below path: combined counts by sample, labels, and individual, group and pairwise statistics."""
    rows = otu.persist()
    write_tsv(diversity.wide(rows.select("sample", "label", "cnt")).orderBy("sample"), f"{path}/combined_counts")
    write_tsv(rows.select("label", "taxon").distinct().orderBy("label"), f"{path}/labels")
    write_tsv(diversity.individual(rows).orderBy("sample"), f"{path}/individual")
    write_tsv(diversity.group(rows), f"{path}/group")
    write_tsv(diversity.pairwise(rows).orderBy("s1", "s2"), f"{path}/pairwise")
    rows.unpersist()
