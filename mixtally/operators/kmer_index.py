"""The k-mer index: canonical k-mers, their equivalence classes, and looking reads up in it.

A k-mer's equivalence class is the set of references that hold it or its reverse complement. Everything is a group-by or an
equi-join on the k-mer; a k-mer meets a reference once, because repeats within a reference are dropped before the shuffle.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtally.functions.sequences import canonical_kmers, check_k, clip_poly_a, normalise
from mixtally.operators import sieve
from mixtally.operators.settle import checkpointed, small

INDEX_VERSION = 2


def prepare(refs: DataFrame, seq: str = "seq", name: str = "name") -> DataFrame:
    """References (ref_id, name, seq) ready for the index: bases only, poly-A tails clipped; len is the length before the clip."""
    clean = normalise(seq, name)
    return refs.withColumn(seq, clean).withColumn("len", F.length(seq)).withColumn(seq, clip_poly_a(seq))


def input_warnings(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """One row (n_seqs, n_other, n_u, n_poly_a): sequences, letters other than ACGTU, U's, and sequences with a poly-A tail."""
    u = F.translate(seq, "acgtu", "ACGTU")
    return seqs.agg(F.count("*").alias("n_seqs"), F.sum(F.length(F.regexp_replace(u, "[ACGTU]", ""))).alias("n_other"), F.sum(F.length(u) - F.length(F.replace(u, F.lit("U"), F.lit("")))).alias("n_u"), F.count_if(F.translate(u, "U", "T").rlike("A{10}$")).alias("n_poly_a"))


def sequence_kmers(seqs: DataFrame, k: int, key: str, seq: str = "seq") -> DataFrame:
    """(key, pos, kmer) of each window of bases, canonical, with positions from 0. Windows with other letters are left out."""
    return seqs.select(key, F.posexplode(canonical_kmers(F.upper(seq), k)).alias("pos", "kmer")).where("kmer IS NOT NULL")


def canonical_counts(seqs: DataFrame, k: int, key: str, seq: str = "seq") -> DataFrame:
    """(kmer, occurrences, refs): how often each canonical k-mer occurs, and in how many sequences."""
    each = sequence_kmers(seqs, k, key, seq).groupBy("kmer", key).agg(F.count("*").alias("n"))
    return each.groupBy("kmer").agg(F.sum("n").alias("occurrences"), F.count("*").alias("refs"))


def build(refs: DataFrame, k: int, key: str = "ref_id", seq: str = "seq", settled: bool = False) -> tuple[DataFrame, DataFrame]:
    """The index: kmer_ec (kmer, ec_id) and ecs (ec_id, members: sorted references); settled: made once, for several uses.

    A class is named by a 64-bit hash of its members, so naming classes needs no numbering of all of them in one task.
    """
    check_k(k)
    classes = _classes(refs, k, key, seq)
    return _index(checkpointed(classes) if settled else classes)


def _classes(refs: DataFrame, k: int, key: str, seq: str) -> DataFrame:
    """(kmer, ec_id, members) of each canonical k-mer."""
    members = sequence_kmers(refs, k, key, seq).select("kmer", key).distinct().groupBy("kmer").agg(F.array_sort(F.collect_list(key)).alias("members"))
    return members.withColumn("ec_id", F.xxhash64(F.concat_ws(",", F.transform("members", lambda m: m.cast("string")))))


def _index(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """kmer_ec and ecs. Two classes of one name would be taken for one: that is an error, not a wrong result."""
    ecs = classes.groupBy("ec_id").agg(F.min("members").alias("members"), F.max("members").alias("other"))
    sound = F.when(F.col("members") == F.col("other"), F.col("members")).otherwise(F.raise_error(F.lit("two classes have one hash")).cast(classes.schema["members"].dataType))
    return classes.select("kmer", "ec_id"), ecs.select("ec_id", sound.alias("members"))


def bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Writes a table below path in buckets by a key, sorted in each. The catalogue needn't know it afterwards: see `open_bucketed`."""
    name = "bucketed_" + uuid.uuid4().hex
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # an external table's files stay


def open_bucketed(spark: SparkSession, path: str, columns: str, key: str, buckets: int) -> DataFrame:
    """A table that `bucketed` wrote, its buckets told to the planner: joins on the key shuffle only the other side."""
    name = "bucketed_" + hashlib.md5(f"{path} {buckets}".encode()).hexdigest()
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write(path: str, refs: DataFrame, k: int, key: str = "ref_id", seq: str = "seq", buckets: int | None = None) -> None:
    """Writes an index below path: refs, ecs, meta, and kmer_ec in buckets by k-mer, some 2,000,000 k-mers in each unless told.

    kmer_ec has for each k-mer its class and its place along the graph, for `skip_ahead.match`.
    """
    from mixtally.operators import skip_ahead

    spark = refs.sparkSession
    check_k(k)
    kmer_ec, ecs = _index(checkpointed(_classes(refs, k, key, seq)))
    buckets = buckets or max(spark.sparkContext.defaultParallelism, kmer_ec.count() // 2_000_000)
    refs.write.parquet(f"{path}/refs")
    bucketed(skip_ahead.segments(refs, kmer_ec, k, seq), f"{path}/kmer_ec", "kmer", buckets)
    ecs.write.parquet(f"{path}/ecs")
    spark.createDataFrame([(INDEX_VERSION, k, buckets)], "version int, k int, buckets int").coalesce(1).write.parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> dict:
    """{k, refs, kmer_ec, ecs} of a written index. An index of another version is an error; tables are read when used."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta is None or meta.version != INDEX_VERSION:
        raise ValueError(f"{path} isn't an index of version {INDEX_VERSION}")
    kmer_ec = open_bucketed(spark, f"{path}/kmer_ec", "kmer STRING, ec_id BIGINT, segment BIGINT, place BIGINT, forward BOOLEAN", "kmer", meta.buckets)
    return {"k": meta.k, "kmer_ec": kmer_ec} | {t: spark.read.parquet(f"{path}/{t}") for t in ("refs", "ecs")}


def match(reads: DataFrame, kmer_ec: DataFrame, k: int, key: str = "read_id", seq: str = "seq", sifted: sieve.Sieve | None = None) -> DataFrame:
    """(key, ec_id, hits): the classes that a read's k-mers hit, and by how many of its windows. Every window is looked up.

    sifted: the sieve of kmer_ec, if there is one already. Hits are dealt out by key once; what is grouped by key later stays.
    """
    return hit_positions(reads, kmer_ec, k, key, seq, sifted).groupBy(key, "ec_id").agg(F.count("*").alias("hits"))


def hit_positions(reads: DataFrame, kmer_ec: DataFrame, k: int, key: str = "read_id", seq: str = "seq", sifted: sieve.Sieve | None = None) -> DataFrame:
    """(key, pos, kmer, ec_id) of each window that hits, dealt out by key, for predicates on the range that hits span."""
    sifted = sifted or sieve.sieve(kmer_ec, k)
    hits = sieve.windows(reads, sifted, key, seq).join(small(kmer_ec.select("kmer", "ec_id"), sifted.n), "kmer")
    return hits.select(key, "pos", "kmer", "ec_id").repartition(F.col(key))


def tile_hits(docs: DataFrame, kmer_ec: DataFrame, k: int, key: str, size: int, stride: int, least: int) -> DataFrame:
    """(key, at, ec_id) of each window of the tiles of docs (key, text) that hits; tiles as `letters.tiles` cuts them. Not dealt out by key."""
    sifted = sieve.sieve(kmer_ec, k)
    return sieve.tile_windows(docs, sifted, key, size, stride, least).join(small(kmer_ec.select("kmer", "ec_id"), sifted.n), "kmer").select(key, "at", "ec_id")


def match_mates(pairs: DataFrame, kmer_ec: DataFrame, k: int, key: str = "read_id", seqs: tuple[str, str] = ("seq1", "seq2")) -> DataFrame:
    """(key, mate, ec_id, hits) of both mates, 1 and 2, as `match` gives it. Pairs (key, a sequence of each mate) are read and looked up once."""
    sifted = sieve.sieve(kmer_ec, k)
    mates = F.array(*(F.struct(F.struct(F.col(key), F.lit(i).alias("mate")).alias("of"), F.col(s).alias("seq")) for i, s in enumerate(seqs, 1)))
    hits = sieve.windows(pairs.select(F.inline(mates)), sifted, "of").join(small(kmer_ec.select("kmer", "ec_id"), sifted.n), "kmer")
    return hits.select(f"of.{key}", "of.mate", "ec_id").repartition(F.col(key)).groupBy(key, "mate", "ec_id").agg(F.count("*").alias("hits"))


def sorted_hits(hits: DataFrame, key: str = "read_id") -> DataFrame:
    """(key, hits): a read's hits (ec_id, pos) in order of class, then position. A read has as many as it has windows, at most."""
    return hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ec_id", "pos"))).alias("hits"))


def supported_range(hits: DataFrame, k: int, least: int = 1, key: str = "read_id") -> DataFrame:
    """Keys whose hits span at least `least` bases, from the first hit's first base to the last hit's last."""
    return hits.groupBy(key).agg((F.max("pos") - F.min("pos") + k).alias("span")).where(F.col("span") >= least).select(key)


def positions(seqs: DataFrame, k: int, key: str = "ref_id", seq: str = "seq") -> DataFrame:
    """(key, kmer, pos, forward): where each canonical k-mer stands in a sequence, from 0, and whether it reads forward there."""
    rows = seqs.select(key, F.upper(seq).alias("s"), F.posexplode(canonical_kmers(F.upper(seq), k)).alias("pos", "kmer"))
    return rows.where("kmer IS NOT NULL").select(key, "kmer", "pos", (F.substring("s", F.col("pos") + 1, F.lit(k)) == F.col("kmer")).alias("forward"))


def fragment_lengths(one: DataFrame, two: DataFrame, refs: DataFrame, k: int, key: str = "read_id") -> DataFrame:
    """(key, ref_id, length): bases from the first to the last of the mates' first hits on a reference, where both hit it.

    one and two: (key, seq) of the mates; a mate's first hit is that of its first window that the reference has, at its first place.
    """
    at = checkpointed(positions(refs, k).groupBy("ref_id", "kmer").agg(F.min("pos").alias("at")))
    sifted = sieve.sieve(at, k)

    def first(mates: DataFrame, name: str) -> DataFrame:
        return sieve.windows(mates, sifted, key).join(small(at, sifted.n), "kmer").groupBy(key, "ref_id").agg(F.min_by("at", "pos").alias(name))

    return first(one, "a").join(first(two, "b"), [key, "ref_id"]).select(key, "ref_id", (F.abs(F.col("a") - F.col("b")) + k).alias("length"))


def class_read_counts(found: DataFrame, key: str = "read_id") -> DataFrame:
    """(members, n): how many reads have each set of candidates. found: (key, ref_id)."""
    sets = found.groupBy(key).agg(F.array_sort(F.collect_set("ref_id")).alias("members"))
    return sets.groupBy("members").agg(F.count("*").alias("n"))
