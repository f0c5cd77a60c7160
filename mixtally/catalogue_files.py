"""Queries that write files and read them back, and those of operators that `catalogue` doesn't reach, with SQL that says the same.

Files stand in the folder that driver and executors share; what is read back is held against the tables they were written from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixtally.catalogue import K, SHORT_K, SQL_DNA, SQL_LK, SQL_OTU, SQL_REFS, _em_sql, _t, counts, dna, em_steps, even, halves, likelihoods, query, reads, references, spread, sql_kmers, sql_reads, sql_votes
from mixtally.functions import letters
from mixtally.functions import sequences as S
from mixtally.operators import candidates, em, kmer_index, quality, sieve, skip_ahead, taxonomy
from mixtally.operators.settle import checkpointed, shared_folder
from mixtally.plans import quantify as plans
from mixtally.sources import bgzf, fastx, tables

# Sequence files

SQL_READ_DOCS = f"(SELECT doc_id, {SQL_DNA} AS d FROM documents)"


def _lines(seq, width: int = 60):
    """A sequence in lines of `width` letters."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def _write_text(df: DataFrame, path: str, gzip: bool = False) -> str:
    df.write.text(path, compression="gzip" if gzip else "none")
    return path


@query(f"SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INT) AS ref_id, 'item' || item_id AS name, {SQL_DNA} AS seq FROM benchmark")
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as FASTA, in lines of 60 bases under headers with `>` in them, and read again."""
    items = _t(spark, sf_dir, "benchmark").select("item_id", dna("text").alias("seq")).orderBy("item_id")
    record = F.concat(F.lit(">item"), F.col("item_id").cast("string"), F.lit(" a -> b >c\n"), _lines(F.col("seq")))
    return fastx.read_fasta(spark, _write_text(items.select(record), shared_folder(spark, "fasta"))).select("ref_id", "name", "seq")


def _fastq(docs: DataFrame, mate: str = "") -> DataFrame:
    """Documents (doc_id, d) as FASTQ records in lines of 70; qualities are the letters' places modulo 60, so some lines begin with @ or +."""
    qual = F.rpad(F.lit(""), F.length("d"), F.lit("".join(chr(33 + i) for i in range(60))))
    return docs.select(F.concat(F.lit("@doc"), F.col("doc_id").cast("string"), F.lit(f"{mate} x\n"), _lines(F.col("d"), 70), F.lit("\n+\n"), _lines(qual, 70)))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letters.dna(spread(_t(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id").select("doc_id", F.coalesce("d", F.lit("")).alias("d"))


#: The qualities of `_fastq`, as many as a sequence is long.
SQL_QUALITIES = "md5(left(repeat(array_to_string([chr(CAST(33 + i AS INT)) for i in range(60)], ''), CAST(length(d) // 60 + 1 AS INT)), CAST(length(d) AS INT)))"


@query(f"SELECT 'doc' || doc_id AS name, md5(d) AS seq_md5, {SQL_QUALITIES} AS qual_md5, 1 AS same_id FROM {SQL_READ_DOCS} WHERE length(d) > 0")
def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as FASTQ of several lines a record, a third each in folders of plain, gzip and blocked gzip files, read again; how many reads share an id."""
    docs, folder = _sequences(spark, sf_dir), shared_folder(spark, "fastq")
    plain = _write_text(_fastq(docs.where("doc_id % 3 = 0")), f"{folder}/plain")
    packed = _write_text(_fastq(docs.where("doc_id % 3 = 1")), f"{folder}/packed", gzip=True)
    bgzf.write_lines(_fastq(docs.where("doc_id % 3 = 2")), f"{folder}/blocked")
    rows = checkpointed(fastx.read_reads(spark, [plain, packed, f"{folder}/blocked"]).select("read_id", "name", F.md5("seq").alias("seq_md5"), F.md5("qual").alias("qual_md5")))
    return rows.join(rows.groupBy("read_id").agg(F.count("*").cast("int").alias("same_id")), "read_id").drop("read_id")


@query(f"SELECT 'doc' || doc_id || '/1' AS name1, 'doc' || doc_id || '/2' AS name2, md5(d) AS seq_md5, md5(reverse(d)) AS mate_md5 FROM {SQL_READ_DOCS} WHERE length(d) > 0")
def paired_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as mate 1 and, read backward, as mate 2, in folders of several files, and joined again by place."""
    docs, folder = _t(spark, sf_dir, "documents").select("doc_id", "text"), shared_folder(spark, "pairs")
    # Each task writes the same documents, in the same order, for both mates.
    docs = letters.dna(docs.repartition(spark.sparkContext.defaultParallelism, "doc_id").sortWithinPartitions("doc_id"), "doc_id").select("doc_id", F.coalesce("d", F.lit("")).alias("d"))
    one = _write_text(_fastq(docs, "/1"), f"{folder}/one")
    two = _write_text(_fastq(docs.withColumn("d", F.reverse("d")), "/2"), f"{folder}/two", gzip=True)
    return fastx.read_pairs(spark, one, two).select("name1", "name2", F.md5("seq1").alias("seq_md5"), F.md5("seq2").alias("mate_md5"))


@query(f"""WITH r AS (SELECT item_id, 'item' || item_id AS name, CAST(length({SQL_DNA}) AS BIGINT) AS n FROM benchmark)
SELECT CAST(row_number() OVER w - 1 AS INT) AS ref_id, name, n AS length, CAST(coalesce(sum(length(name) + 2 + n + 1) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(name) + 2 AS BIGINT) AS "offset", CAST(n AS INT) AS linebases, CAST(n + 1 AS INT) AS linewidth FROM r WINDOW w AS (ORDER BY item_id)""")
def fai_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a FASTA file of benchmark items, written and read again."""
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("name"), dna("text").alias("seq"))
    path = f"{shared_folder(spark, 'fai')}/x.fai"
    tables.write_tsv(tables.make_fai(items).orderBy("offset"), path, header=False)
    return tables.read_fai(spark, path)


@query(f"SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INT) AS ref_id, 'item' || item_id AS name, {SQL_DNA} AS seq FROM benchmark")
def sequence_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references, read from a FASTA file by the byte ranges that its index tells."""
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("name"), dna("text").alias("seq"))
    folder = shared_folder(spark, "fetch")
    # One file, as an index is of one: its sequences in order of their ids.
    items.orderBy("ref_id").coalesce(1).select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq")).write.text(f"{folder}/fasta")
    tables.write_tsv(tables.make_fai(items).orderBy("offset"), f"{folder}/x.fai", header=False)
    fai = tables.read_fai(spark, f"{folder}/x.fai")
    return tables.fetch(fai, fastx.listed(spark, [f"{folder}/fasta"])[0][0], fai)


@query(f"WITH {SQL_REFS}, {sql_kmers('rk', 'refs', 'ref_id', K)} SELECT kmer, string_agg(CAST(ref_id AS VARCHAR), ',' ORDER BY ref_id) AS members FROM (SELECT DISTINCT kmer, ref_id FROM rk) GROUP BY kmer")
def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-mer index, written and loaded."""
    path = shared_folder(spark, "index")
    kmer_index.write(path, references(spark, sf_dir), K)
    index = kmer_index.load(spark, path)
    return index["kmer_ec"].join(index["ecs"], "ec_id").select("kmer", F.concat_ws(",", F.transform("members", lambda m: m.cast("string"))).alias("members"))


@query("""WITH t AS (SELECT n_nationkey AS ref_id, n_name AS name, r_name || ';' || n_regionkey || ';' AS label FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 4),
f AS (SELECT label, min(ref_id) AS first, count(*) AS size FROM t GROUP BY label), i AS (SELECT label, CAST(row_number() OVER (ORDER BY first) AS INT) AS label_id, size FROM f)
SELECT n_nationkey AS ref_id, coalesce(t.label, CAST(n_nationkey AS VARCHAR)) AS label, label_id, size, ';' AS delimiter, false AS prefixed FROM nation LEFT JOIN t ON n_nationkey = t.ref_id LEFT JOIN i ON t.label = i.label""")
def taxonomy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy of four in five nations, with a line too many and one that isn't whole, written, read and given to all nations."""
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    folder = shared_folder(spark, "taxa")
    label = F.concat(F.col("r_name"), F.lit(";"), F.col("n_regionkey").cast("string"), F.lit(";"))
    tables.write_tsv(n.where("n_nationkey % 5 <> 4").select("n_name", label), f"{folder}/one", header=False)
    # Of a name's lines the first file's counts, and lines of other widths don't.
    tables.write_tsv(n.where("n_nationkey % 5 <> 4").select("n_name", F.lit("X;Y;")), f"{folder}/two", header=False)
    tables.write_tsv(n.select("n_name"), f"{folder}/three", header=False)
    taxa = tables.read_taxonomy(spark, [f"{folder}/one", f"{folder}/two", f"{folder}/three"])
    refs = n.select(F.col("n_nationkey").alias("ref_id"), F.col("n_name").alias("name"))
    known = taxonomy.assign_labels(taxa, refs)
    delimiter, prefixed = tables.taxonomy_format(taxa)
    rows = taxonomy.with_default(refs, known).join(known.select("ref_id", "label_id"), "ref_id", "left").join(taxonomy.label_sizes(known), "label", "left")
    return rows.select("ref_id", "label", "label_id", "size", F.lit(delimiter).alias("delimiter"), F.lit(prefixed).alias("prefixed"))


@query(f"WITH {SQL_OTU} SELECT sample, label, cnt, 'of ' || label AS taxon, CAST(2 * (SELECT count(DISTINCT sample) FROM otu) AS INT) AS n_malformed FROM otu")
def sample_tables_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result file for each sample, with lines that aren't whole, and the list of them, read again."""
    folder = shared_folder(spark, "samples")
    rows = counts(spark, sf_dir).withColumn("file", F.regexp_replace("sample", "[^A-Za-z0-9]", "-"))
    files = rows.select("sample", "file").distinct()
    good = rows.select("file", F.lit(1).alias("i"), F.concat_ws("\t", "label", F.col("cnt").cast("string"), F.concat(F.lit("of "), F.col("label"))).alias("value"))
    other = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(v).alias("value")) for i, v in ((0, "Label\tExpectedCounts\tTaxa"), (2, "cut off"), (3, "a\tb\tc\td"))))
    lines = good.unionByName(files.select("file", F.explode(other).alias("x")).select("file", "x.i", "x.value"))
    lines.repartition("file").sortWithinPartitions("file", "i").select("file", "value").write.partitionBy("file").text(folder)
    path = F.concat(F.lit(f"{folder}/file="), F.col("file"))
    listed = files.select(F.concat(F.col("sample"), F.when(F.length("sample") % 2 == 0, ",").otherwise("\t"), path).alias("value"))
    listed.unionByName(spark.createDataFrame([("no path",)], "value string")).write.text(f"{folder}/list")
    bad = tables.malformed_lines(spark, folder + "/file=*")
    return tables.read_samples(spark, f"{folder}/list").select("sample", "label", "cnt", "taxon", F.lit(bad).alias("n_malformed"))


@query(f"WITH {sql_votes(K)} SELECT read_id, ref_id FROM vote WHERE n_ec = total_ec")
def pseudoalign_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of document tiles by a written index, in buckets, along whose unitigs reads jump: those that every window gives."""
    path = shared_folder(spark, "index")
    kmer_index.write(path, references(spark, sf_dir), K)
    index = kmer_index.load(spark, path)
    return candidates.strict(candidates.votes(skip_ahead.match(reads(spark, sf_dir), index["kmer_ec"], K), index["ecs"]))


@query(f"""WITH {SQL_REFS}, {sql_kmers('rk', 'refs', 'ref_id', K)}, ec AS (SELECT kmer, string_agg(CAST(ref_id AS VARCHAR), ',' ORDER BY ref_id) AS ec FROM (SELECT DISTINCT kmer, ref_id FROM rk) GROUP BY kmer)
SELECT ref_id, ec AS members FROM rk JOIN ec ON rk.kmer = ec.kmer GROUP BY ref_id, ec""")
def reference_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes along each reference, looked up by jumping along unitigs from end to end."""
    refs = references(spark, sf_dir)
    kmer_ec, ecs = kmer_index.build(refs, K)
    index = checkpointed(skip_ahead.segments(refs, kmer_ec, K))
    return skip_ahead.match(refs, index, K, "ref_id").join(ecs, "ec_id").select("ref_id", F.concat_ws(",", F.transform("members", lambda m: m.cast("string"))).alias("members"))


# Result files

SQL_SHARES = f"{SQL_LK}, n AS (SELECT key, count(*) AS n FROM lk GROUP BY key), share AS (SELECT key, n / (SELECT sum(n) FROM n) AS f FROM n)"
#: A count as tables print it, from the digits that its size asks for.
SQL_SHOWN = "CASE WHEN {0} = 0 THEN 0 ELSE round_even({0} * pow(10, d - 1 - p), 0) / pow(10, d - 1 - p) END"


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, f): each supplier's share of the likelihood rows."""
    n = likelihoods(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("key", (F.col("n") / F.col("all")).alias("f"))


@query(f"""WITH {SQL_SHARES}, e AS (SELECT key, f * 123456.0 AS x, s_name AS taxon FROM share JOIN supplier ON key = s_suppkey WHERE key % 7 <> 3), p AS (SELECT *, floor(log10(x)) AS p FROM e),
d AS (SELECT *, CASE WHEN p >= 3 THEN p + 2 WHEN p = 2 THEN 5 ELSE 4 END AS d FROM p)
SELECT CAST(key AS VARCHAR) AS "Label", round({SQL_SHOWN.format('x')}, 9) AS "ExpectedCounts", taxon AS "Taxa", (SELECT count(*) FROM share WHERE key % 7 = 3) AS n_unlabelled FROM d""")
def result_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected counts by supplier, written as the table of results and read again; suppliers without a label are left out and counted."""
    freqs = shares(spark, sf_dir)
    labels = _t(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 3").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("label"))
    path = f"{shared_folder(spark, 'results')}/freqs"
    tables.write_tsv(tables.result_rows(freqs, labels, 123456.0).orderBy("Label"), path)
    missing = tables.unlabelled(freqs, labels).agg(F.count("*").alias("n_unlabelled"))
    return tables.read_result(spark, path).select(F.col("label").alias("Label"), F.round("cnt", 9).alias("ExpectedCounts"), F.col("taxon").alias("Taxa")).crossJoin(F.broadcast(missing))


@query("""WITH c AS (SELECT r_name AS a, n_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT 'Root' AS path, NULL AS parent, 'Root' AS name, 0 AS taxlevel, count(*) AS x, count(DISTINCT a) AS daughterlevels FROM c
UNION ALL SELECT 'Root__' || a, 'Root', a, 1, count(*), count(DISTINCT b) FROM c GROUP BY a
UNION ALL SELECT 'Root__' || a || '__' || b, 'Root__' || a, b, 2, count(*), 1 FROM c GROUP BY a, b),
o AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY name) AS place FROM t),
i AS (SELECT o.*, CASE o.taxlevel WHEN 0 THEN '0' WHEN 1 THEN '0.' || o.place ELSE '0.' || p.place || '.' || o.place END AS rank_id, floor(log10(o.x)) AS p FROM o LEFT JOIN o p ON o.parent = p.path),
d AS (SELECT *, CASE WHEN p >= 3 THEN p + 2 WHEN p = 2 THEN 5 ELSE 4 END AS d FROM i)
SELECT CAST(taxlevel AS VARCHAR) AS taxlevel, rank_id AS "rankID", name AS taxon, CAST(daughterlevels AS VARCHAR) AS daughterlevels, round(""" + SQL_SHOWN.format("x") + """, 6) AS expected_counts FROM d""")
def collapse_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation, rolled up, written as the table of taxa and read again."""
    n = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    rows = n.join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    total = rows.agg(F.sum("n").alias("all"))
    freqs = rows.crossJoin(F.broadcast(total)).select(F.col("n_nationkey").alias("key"), (F.col("n") / F.col("all")).alias("f"))
    labels = rows.select(F.col("n_nationkey").alias("key"), F.concat_ws(";", "r_name", "n_name", F.lit("")).alias("label"))
    path = f"{shared_folder(spark, 'collapsed')}/freqs"
    rolled = taxonomy.rolled_counts(freqs, labels, float(total.first()[0]))
    tables.write_tsv(tables.collapse_rows(rolled), path)
    out = spark.read.csv(path, sep="\t", header=True)
    return out.withColumn("expected_counts", F.round(F.col("expected_counts").cast("double"), 6))


@query(f"""WITH {SQL_LK}, b AS (SELECT read_id, max(loglik) AS m FROM lk GROUP BY read_id)
SELECT 'read' || read_id AS name, CASE WHEN read_id % 3 = 0 THEN 'Pseudomapping_Fails' ELSE 'Likelihood_Filter_Fails' END AS reason, NULL AS best FROM b WHERE read_id % 3 = 0 OR m <= -5
UNION ALL SELECT 'best', 'max', round(m, 9) FROM b""")
def failed_reads_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that failed, and best log-likelihoods, written packed and read again."""
    lk, folder = likelihoods(spark, sf_dir), shared_folder(spark, "fails")
    best = quality.best_loglik(lk).withColumn("name", F.concat(F.lit("read"), F.col("read_id").cast("string")))
    tables.write_tsv(tables.failed_rows(best.where("read_id % 3 = 0"), best.where("read_id % 3 <> 0 AND max_ll <= -5")).orderBy("reason", "name"), f"{folder}/fails", compression="gzip")
    tables.write_tsv(best.orderBy("read_id").select("max_ll"), f"{folder}/maxlikes", header=False, compression="gzip")
    failed = spark.read.csv(f"{folder}/fails", sep="\t", header=True).withColumn("best", F.lit(None).cast("double"))
    likes = spark.read.csv(f"{folder}/maxlikes", schema="best double").select(F.lit("best").alias("name"), F.lit("max").alias("reason"), F.round("best", 9).alias("best"))
    return failed.unionByName(likes)


@query(_em_sql(1) + """, p AS (SELECT multi.read_id, multi.key, f * exp(loglik - multi.best) / m AS p FROM multi JOIN m0 ON multi.read_id = m0.read_id JOIN f0 ON multi.key = f0.key),
t AS (SELECT *, max(p) OVER (PARTITION BY read_id) AS top FROM p), r AS (SELECT read_id, key, CASE WHEN top >= 0.9995 THEN 1.0 ELSE p END AS p FROM t WHERE top < 0.9995 OR p = top UNION ALL SELECT read_id, lone, 1.0 FROM c WHERE n = 1),
s AS (SELECT read_id, count(*) AS n, CAST(printf('%.6g', max(p)) AS DOUBLE) AS best, string_agg('s' || key, ' ' ORDER BY 's' || key) AS refs FROM r GROUP BY read_id)
SELECT 'read' || read_id AS name, n, best, refs, true AS falling FROM s UNION ALL SELECT 'lost', 1, NULL, '', true""")
def readinfo_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors of each read, the highest first, written packed and read again: how many, the first, of which references, and whether they fall."""
    lk = checkpointed(likelihoods(spark, sf_dir))
    name = F.concat(F.lit("read"), F.col("read_id").cast("string")).alias("name")
    names = em.support(lk).select("key", F.concat(F.lit("s"), F.col("key").cast("string")).alias("ref"))
    failed = spark.createDataFrame([("lost", "Pseudomapping_Fails")], "name string, reason string")
    path = f"{shared_folder(spark, 'readinfo')}/readinfo"
    info = tables.readinfo_rows(em.posterior(lk, even(lk)), lk.select("read_id", name).distinct(), names, failed)
    # Sorting reads its input twice, once to find the ranges.
    tables.write_tsv(checkpointed(info).orderBy("name"), path, compression="gzip")
    rows = spark.read.csv(path, sep="\t", header=True).withColumn("p", F.transform(F.split("info", " "), lambda x: F.substring_index(x, ":", 1).try_cast("double")))
    return rows.select("name", F.size("p").cast("long").alias("n"), F.element_at("p", 1).alias("best"), F.array_join(F.array_sort(F.regexp_extract_all("info", F.lit(":(s[0-9]+)"))), " ").alias("refs"), F.coalesce(F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("p") - 1)), lambda i: F.coalesce(F.get("p", i) <= F.get("p", i - 1), F.lit(True))), F.lit(True)).alias("falling"))


@query(f"""WITH {SQL_OTU}, p AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY sample) AS p FROM otu), i AS (SELECT sample, sum(cnt) AS total, count(*) AS d0, round(sum(p * p), 9) AS d2 FROM p GROUP BY sample),
l AS (SELECT count(DISTINCT label) AS n_labels, count(DISTINCT sample) AS n_samples FROM otu)
SELECT sample, total, d0, d2, n_labels, n_samples * (n_samples - 1) // 2 AS n_pairs FROM i, l""")
def tabulation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of samples, written as files and read again, with the number of labels and of pairs of samples written."""
    path = shared_folder(spark, "tabulation")
    tables.write_tabulation(counts(spark, sf_dir).withColumn("taxon", F.col("label")), path)
    one = spark.read.csv(f"{path}/individual", sep="\t", header=True).select("sample", F.col("total").cast("double").alias("total"), F.col("d0").cast("long").alias("d0"), F.round(F.col("d2").cast("double"), 9).alias("d2"))
    labels = spark.read.csv(f"{path}/labels", sep="\t", header=True).agg(F.count_distinct("label").alias("n_labels"))
    pairs = spark.read.csv(f"{path}/pairwise", sep="\t", header=True).agg(F.count("*").alias("n_pairs"))
    return one.crossJoin(F.broadcast(labels)).crossJoin(F.broadcast(pairs))


# Reads and candidates


@query(f"WITH {sql_votes(SHORT_K)} SELECT (SELECT count(*) FROM reads) AS reads, count(DISTINCT read_id) FILTER (most = total_ec) AS strict, count(DISTINCT read_id) FILTER (most < total_ec AND most > 1) AS rescued FROM vote")
def read_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tiles of documents there are, and how many find strict and only lenient candidates."""
    kmer_ec, ecs = kmer_index.build(references(spark, sf_dir), SHORT_K, settled=True)
    rows = reads(spark, sf_dir)
    return plans.read_counters(rows, candidates.candidates(candidates.votes(kmer_index.match(rows, kmer_ec, SHORT_K), ecs)))


@query(f"""WITH {SQL_REFS}, {sql_reads()}, {sql_kmers('rk', 'refs', 'ref_id', SHORT_K)},
q AS (SELECT read_id, i - 1 AS pos, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT read_id, i, substr(seq, CAST(i AS INT), {SHORT_K}) AS w FROM (SELECT read_id, seq, unnest(range(1, length(seq) - {SHORT_K} + 2)) AS i FROM reads WHERE length(seq) >= {SHORT_K}))),
h AS (SELECT read_id, min(pos) AS a, max(pos) AS b, count(*) AS n FROM q WHERE kmer IN (SELECT kmer FROM rk) GROUP BY read_id) SELECT read_id, CAST(n AS BIGINT) AS n_hits, CAST(a AS BIGINT) AS first FROM h WHERE b - a + {SHORT_K} >= 100""")
def supported_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles whose hits span 100 bases or more, with the number of their hits and the place of the first."""
    kmer_ec, _ = kmer_index.build(references(spark, sf_dir), SHORT_K, settled=True)
    hits = kmer_index.hit_positions(reads(spark, sf_dir), kmer_ec, SHORT_K)
    rows = kmer_index.sorted_hits(hits).join(kmer_index.supported_range(hits, SHORT_K, 100), "read_id")
    return rows.select("read_id", F.size("hits").cast("long").alias("n_hits"), F.array_min("hits.pos").cast("long").alias("first"))


def _lenient_mates_sql() -> str:
    def side(i: int, seq: str) -> str:
        return f"""m{i} AS (SELECT read_id, {seq} AS seq FROM reads), {sql_kmers(f'k{i}', f'm{i}', 'read_id', SHORT_K)},
h{i} AS (SELECT DISTINCT read_id, ec FROM k{i} JOIN ec ON k{i}.kmer = ec.kmer), t{i} AS (SELECT read_id, count(*) AS total FROM h{i} GROUP BY read_id),
v{i} AS (SELECT read_id, ref_id, n, max(n) OVER (PARTITION BY read_id) AS most FROM (SELECT read_id, ref_id, count(*) AS n FROM h{i} JOIN member ON h{i}.ec = member.ec GROUP BY 1, 2)),
c{i} AS (SELECT v{i}.read_id, list(ref_id) AS c FROM v{i} JOIN t{i} ON v{i}.read_id = t{i}.read_id WHERE n = most AND (total = 1 OR most > 1) GROUP BY v{i}.read_id)"""

    return f"""WITH {SQL_REFS}, {sql_reads()}, {sql_kmers('rk', 'refs', 'ref_id', SHORT_K)},
ec AS (SELECT kmer, string_agg(CAST(ref_id AS VARCHAR), ',' ORDER BY ref_id) AS ec FROM (SELECT DISTINCT kmer, ref_id FROM rk) GROUP BY kmer),
member AS (SELECT DISTINCT ec.ec, rk.ref_id FROM ec JOIN rk ON ec.kmer = rk.kmer),
{side(1, 'substr(seq, 1, 75)')}, {side(2, 'substr(seq, 76)')},
pair AS (SELECT coalesce(c1.read_id, c2.read_id) AS read_id, coalesce(c1.c, []) AS c1, coalesce(c2.c, []) AS c2 FROM c1 FULL JOIN c2 ON c1.read_id = c2.read_id),
found AS (SELECT read_id, unnest(CASE WHEN len(c1) = 0 THEN c2 WHEN len(c2) = 0 THEN c1 WHEN len(list_intersect(c1, c2)) > 0 THEN list_intersect(c1, c2) WHEN len(c1) + len(c2) < 500 THEN list_distinct(list_concat(c1, c2)) END) AS ref_id FROM pair)
SELECT read_id, ref_id FROM found WHERE ref_id IS NOT NULL"""


@query(_lenient_mates_sql())
def mate_combine_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lenient rule for mates over lenient candidates of the halves of each tile."""
    kmer_ec, ecs = kmer_index.build(references(spark, sf_dir), SHORT_K, settled=True)
    voted = candidates.votes(kmer_index.match_mates(halves(spark, sf_dir), kmer_ec, SHORT_K), ecs, "read_id", "mate")
    return candidates.pair_candidates(candidates.mate_sets(voted, loose=True), ("lenient",)).drop("rule")


@query(f"WITH {SQL_REFS}, {sql_kmers('rk', 'refs', 'ref_id', SHORT_K)}, c AS (SELECT kmer, list_sort(list(DISTINCT ref_id)) AS members FROM rk GROUP BY kmer), e AS (SELECT DISTINCT members FROM c) SELECT array_to_string(a.members, ',') AS one, array_to_string(b.members, ',') AS two FROM e a JOIN e b ON a.members <> b.members AND list_has_all(b.members, a.members)")
def class_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All classes of which one is a subset of the other."""
    _, ecs = kmer_index.build(references(spark, sf_dir), SHORT_K)
    text = lambda c: F.concat_ws(",", F.transform(c, lambda m: m.cast("string")))
    return candidates.subsets(checkpointed(ecs)).select(text("one").alias("one"), text("two").alias("two"))


@query("""WITH s AS (SELECT doc_id, translate(text, 'acgtuU', 'ACGTTT') AS u FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(length(regexp_replace(u, '[ACGT]', '', 'g')) AS BIGINT) AS n_other, md5(regexp_replace(u, '[^ACGT]', 'N', 'g')) AS kept_md5, true AS bases_only, true AS repeatable FROM s""")
def replaced_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts normalised: bases stay where they are, and other letters become bases, the same whatever they are normalised with."""
    docs = spread(_t(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    return letters.replacement(docs, "doc_id", "text", F.col("doc_id").cast("string"))


@query(f"""WITH {SQL_REFS}, w AS (SELECT DISTINCT substr(seq, CAST(i AS INT), {SHORT_K}) AS w FROM (SELECT seq, unnest(range(1, length(seq) - {SHORT_K} + 2)) AS i FROM refs WHERE length(seq) >= {SHORT_K})),
c AS (SELECT w, [strpos('ACGT', w[i]) - 1 for i in range(1, {SHORT_K} + 1)] AS digits FROM w)
SELECT w AS kmer, array_to_string([w[2:] || b for b in ['A', 'C', 'G', 'T']] || [b || w[:-2] for b in ['A', 'C', 'G', 'T']], ' ') AS around, array_to_string([CAST(x // 2 AS VARCHAR) || CAST(x % 2 AS VARCHAR) for x in digits], ' ') AS bits, array_to_string(digits, ' ') AS digits, 1 AS same_hash, true AS hash_of_code FROM c""")
def kmer_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers before and after every distinct window of the references, its code in binary, its digits, how many windows have its hash, and
    whether the hash is that of the k-mer which its code stands for."""
    w = references(spark, sf_dir).select(F.explode(S.kmers("seq", SHORT_K)).alias("kmer")).distinct()
    digits = F.transform(F.filter(F.split("kmer", ""), lambda c: c != ""), lambda c: F.instr(F.lit("ACGT"), c) - 1)
    return w.select("kmer", S.shown(S.neighbours("kmer")).alias("around"), S.bits(S.encode("kmer"), SHORT_K).alias("bits"), S.shown(digits).alias("digits"), F.count("*").over(Window.partitionBy(S.kmer_hash("kmer"))).cast("int").alias("same_hash"), (S.kmer_hash("kmer") == S.kmer_hash(S.decode(S.encode("kmer"), SHORT_K))).alias("hash_of_code"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, format('{:,}', CAST(round(o_totalprice) AS BIGINT)) AS price, round(pow(10.0, -(o_orderkey % 42) / 10.0), 12) AS error,
CASE WHEN o_orderkey % 42 = 2 THEN 0.75 ELSE round(pow(10.0, -(o_orderkey % 42) / 10.0), 12) END AS error64,
(1 + o_orderkey % 5) || '=' || (1 + o_orderkey % 3) || 'X2D1I' || (1 + o_orderkey % 7) || 'S' AS cigar,
repeat('0', (1 + o_orderkey % 5)::INT) || repeat('1', (1 + o_orderkey % 3 + 1 + 1 + o_orderkey % 7)::INT) AS units, 2 AS deleted FROM orders""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times, thousands, error chances and alignments' units, from orders' columns."""
    o, n = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    part = lambda m, c: F.concat((n % m + 1).cast("string"), F.lit(c))
    o = o.withColumn("cigar", F.concat(part(5, "="), part(3, "X"), F.lit("2D1I"), part(7, "S")))
    return o.select(
        "o_orderkey", S.timestamp_text("o_orderdate").alias("at"), S.thousands(F.round("o_totalprice").cast("long")).alias("price"), F.round(S.error_probability(F.chr(n % 42 + 33)), 12).alias("error"),
        F.round(S.error_probability(F.chr(n % 42 + 64), 64), 12).alias("error64"), "cigar", F.array_join(F.transform(S.cigar_units("cigar"), lambda u: u.cast("string")), "").alias("units"), S.cigar_deletions("cigar").alias("deleted"),
    )


# Frequencies


@query(f"WITH {SQL_SHARES}, k AS (SELECT * FROM share WHERE f >= 1.0 / (SELECT count(*) FROM share)) SELECT key, round(f / (SELECT sum(f) FROM k), 9) AS f FROM k")
def frequency_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with at least an even share of the rows, scaled to 1."""
    freqs = checkpointed(shares(spark, sf_dir))
    return em.cut(freqs, 1.0 / freqs.count()).select("key", F.round("f", 9).alias("f"))


@query(f"""WITH {SQL_SHARES}, k AS (SELECT key FROM share WHERE f >= 1.0 / (SELECT count(*) FROM share)), c AS (SELECT read_id, count(*) AS n, min(key) AS lone FROM lk GROUP BY read_id)
SELECT count(*) AS mapped FROM c WHERE n > 1 OR lone IN (SELECT key FROM k)""")
def mapped_after_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that stay mapped when suppliers with less than an even share drop out."""
    freqs = checkpointed(shares(spark, sf_dir))
    return em.mapped_left(likelihoods(spark, sf_dir), em.cut(freqs, 1.0 / freqs.count()))


@query(_em_sql(2) + " SELECT round(sum((f2.f - f1.f) * (f2.f - f1.f)), 12) AS r2 FROM f1 JOIN f2 ON f1.key = f2.key")
def em_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squared distance between the frequencies after one and after two evaluations."""
    f = em_steps(spark, sf_dir, 2)
    return em.residual2(f[1], f[2]).select(F.round("r2", 12).alias("r2"))


@query(_em_sql(1) + " SELECT round(sum(ln(m) + best), 3) AS loglik FROM m0")
def em_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-likelihood of reads with several suppliers at even frequencies."""
    model = em.Likelihoods(likelihoods(spark, sf_dir))
    _, loglik = model.step({k: 1 / len(model.keys) for k in model.keys})
    model.release()
    return spark.createDataFrame([(loglik,)], "x double").select(F.round("x", 3).alias("loglik"))


@query(f"WITH {SQL_LK} SELECT DISTINCT key, false AS moved, true AS summed FROM lk")
def em_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the accelerated EM finds is a fixed point: one more plain evaluation moves no frequency, and they sum to 1."""
    lk = checkpointed(likelihoods(spark, sf_dir))
    model = em.Likelihoods(lk)
    out = model.estimate(min_freq=0.0, controls=em.Controls(tolerance=1e-7))
    model.release()
    f = out.frame(spark, lk)
    multi, singles = em.split_single(lk)
    again = em.em_step(multi, f, singles).withColumnRenamed("f", "g")
    total = f.agg((F.abs(F.sum("f") - 1) < 1e-9).alias("summed"))
    rows = em.support(lk).join(f, "key", "left").join(again, "key", "left")
    return rows.select("key", (F.abs(F.coalesce("f", F.lit(0.0)) - F.coalesce("g", F.lit(0.0))) > 1e-5).alias("moved")).crossJoin(F.broadcast(total))


@query(f"""WITH deep AS (SELECT l_orderkey AS read_id, l_suppkey AS key, -600 - 10 * sum(l_quantity) AS loglik FROM lineitem GROUP BY l_orderkey, l_suppkey), taxa AS (SELECT s_suppkey AS ref_id, n_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey), z AS (SELECT label, count(*) AS size FROM taxa GROUP BY label),
r AS (SELECT read_id, coalesce(label, CAST(key AS VARCHAR)) AS key, loglik FROM deep LEFT JOIN taxa ON deep.key = taxa.ref_id), g AS (SELECT read_id, r.key, max(loglik) AS best, count(*) AS n, coalesce(max(size), 1) AS size FROM r LEFT JOIN z ON r.key = z.label GROUP BY read_id, r.key),
s AS (SELECT g.*, CASE WHEN size > n THEN greatest(best, -150) ELSE best END AS shift FROM g)
SELECT r.read_id, r.key, round(any_value(shift) + ln((sum(exp(loglik - shift)) + any_value(CASE WHEN size > n THEN (size - n) * exp(-150 - shift) ELSE 0 END)) / any_value(size)), 6) AS loglik FROM r JOIN s ON r.read_id = s.read_id AND r.key = s.key GROUP BY r.read_id, r.key""")
def collapse_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihoods of e ** -610 and less, collapsed by nation."""
    taxa = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("ref_id"), F.col("n_name").alias("label"))
    deep = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("read_id"), F.col("l_suppkey").alias("ref_id")).agg((-600 - 10 * F.sum("l_quantity")).alias("loglik"))
    return em.collapse(deep, taxa).select("read_id", "key", F.round("loglik", 6).alias("loglik"))


@query("""WITH deep AS (SELECT l_orderkey AS read_id, l_suppkey AS key, -600 - 10 * sum(l_quantity) AS loglik FROM lineitem GROUP BY l_orderkey, l_suppkey), k AS (SELECT count(DISTINCT key) AS n FROM deep),
c AS (SELECT read_id, count(*) AS n FROM deep GROUP BY read_id),
p AS (SELECT deep.read_id, key, c.n, exp(loglik + 150) / (sum(exp(loglik + 150)) OVER (PARTITION BY deep.read_id) + (k.n - c.n)) AS p FROM deep JOIN c ON deep.read_id = c.read_id, k)
SELECT read_id, key, round(CASE WHEN n = 1 THEN 1.0 ELSE p END, 9) AS p, CASE WHEN n = 1 THEN 'single' ELSE 'multi' END AS status FROM p""")
def posterior_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors of likelihoods of e ** -610 and less: nearly all weight is on the suppliers that a read doesn't hit."""
    deep = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("read_id"), F.col("l_suppkey").alias("key")).agg((-600 - 10 * F.sum("l_quantity")).alias("loglik"))
    return em.posterior(deep, even(deep)).select("read_id", "key", F.round("p", 9).alias("p"), "status")
