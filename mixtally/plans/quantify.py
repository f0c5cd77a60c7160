"""The three commands as plans over DataFrames: index, quantify and tabulate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtally.functions.sequences import check_k
from mixtally.operators import align, candidates, em, kmer_index, quality, skip_ahead, taxonomy, windows
from mixtally.sources import fastx, tables


@dataclass(frozen=True)
class Options:
    """What quantify may be told; the defaults are the command line's."""

    phred: int = 33
    paired: bool = False
    collapse: bool = False
    lenient: bool = True
    likelihood_filter: bool = True
    threshold: float = -2.0
    min_freq: float | None = None
    max_evaluations: int = 2500
    tolerance: float = 1e-12
    scoring: align.Scoring = field(default_factory=align.Scoring)
    #: Least bases that a read's hits must span, from the first hit's first to the last hit's last.
    min_range: int = 1
    #: Whether mate 2's qualities are turned around with its sequence.
    reverse_quality: bool = True
    #: Whether reads jump along unitigs instead of looking every window up (see `skip_ahead`).
    skip_ahead: bool = False
    #: Whether single reads are aligned with windows of their candidates, equal ones once (see `windows`).
    windows: bool = False
    #: A folder for the EM's states: a run that was killed goes on from them (see `em.CycleLog`).
    state: str | None = None

    def __post_init__(self):
        if self.phred not in (33, 64):
            raise ValueError("phred is 33 or 64")


def build_index(spark: SparkSession, fasta: str, path: str, k: int = 31) -> dict:
    """Writes the index of FASTA files below path; what is to be warned of: letters that were replaced, U's, poly-A tails, repeated names."""
    check_k(k)
    raw = fastx.read_fasta(spark, fasta)
    kmer_index.write(path, kmer_index.prepare(raw).select("ref_id", "name", "seq", "len"), k)
    return kmer_index.input_warnings(raw).first().asDict() | {"n_repeated_names": fastx.repeated_names(spark, fasta).count()}


def read_counters(reads: DataFrame, cands: DataFrame) -> DataFrame:
    """One row (reads, strict, rescued): reads, and those with strict and with only lenient candidates. cands: (read_id, ref_id, mode)."""
    modes = cands.select("read_id", "mode").distinct().agg(F.count_if(F.col("mode") == "strict").alias("strict"), F.count_if(F.col("mode") == "lenient").alias("rescued"))
    return reads.agg(F.count("*").alias("reads")).crossJoin(F.broadcast(modes))


def missed_references(cands: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref_id, n): candidates that the index's references don't have, and how often; they can't be scored."""
    return cands.join(refs.select("ref_id"), "ref_id", "left_anti").groupBy("ref_id").agg(F.count("*").alias("n"))


@dataclass
class Quantified:
    """Results of quantify: likelihoods (read_id, key, loglik) that passed, the EM's result, and who failed where."""

    lk: DataFrame
    em: em.Result
    freqs: DataFrame
    unmapped: DataFrame
    improbable: DataFrame
    best: DataFrame
    names: DataFrame
    counters: dict


def read_candidates(reads: DataFrame, index: dict, options: Options) -> DataFrame:
    """(read_id, ref_id, mode) of reads or pairs: strict, and lenient where strict has none."""
    k, kmer_ec, ecs = index["k"], index["kmer_ec"], index["ecs"]

    def matched(rows: DataFrame) -> DataFrame:
        found = skip_ahead.match(rows, kmer_ec, k) if options.skip_ahead else kmer_index.match(rows, kmer_ec, k)
        if options.min_range <= k:  # any hit spans k bases
            return found
        return found.join(kmer_index.supported_range(kmer_index.hit_positions(rows, kmer_ec, k), k, options.min_range), "read_id", "left_semi")

    if not options.paired:
        return candidates.candidates(candidates.votes(matched(reads), ecs), options.lenient)
    hits = [matched(reads.select("read_id", F.col(f"seq{i}").alias("seq"))) for i in (1, 2)]
    voted = [candidates.votes(h, ecs) for h in hits]
    found = candidates.mates_strict(candidates.strict(voted[0]), candidates.strict(voted[1]), *hits).withColumn("mode", F.lit("strict"))
    if not options.lenient:
        return found
    loose = candidates.mates_lenient(candidates.lenient(voted[0]), candidates.lenient(voted[1])).withColumn("mode", F.lit("lenient"))
    return found.unionByName(loose.join(found.select("read_id").distinct(), "read_id", "left_anti"))


def score(reads: DataFrame, cands: DataFrame, refs: DataFrame, options: Options, k: int | None = None) -> DataFrame:
    """(read_id, ref_id, loglik) of candidates that align. Reads with equal bases and qualities are aligned once for a reference.

    With options.windows single reads are aligned once for all references that have the same window for them; k is the index's.
    """
    if options.windows and not options.paired:
        own = cands.select("read_id", "ref_id").join(reads.select("read_id", "seq", "qual"), "read_id")
        return windows.score(own, refs, k, options.phred, options.scoring).where("loglik IS NOT NULL").select("read_id", "ref_id", "loglik")
    names = ["seq1", "qual1", "seq2", "qual2"] if options.paired else ["seq", "qual"]
    rows = cands.join(reads.select("read_id", *names), "read_id")
    distinct = rows.select(*names, "ref_id").distinct().join(refs.select("ref_id", F.col("seq").alias("ref_seq")), "ref_id")
    scored = align.score_paired(distinct, options.phred, options.scoring, reverse_quality=options.reverse_quality) if options.paired else align.score_single(distinct, options.phred, options.scoring)
    return rows.join(scored.select(*names, "ref_id", "loglik"), [*names, "ref_id"]).where("loglik IS NOT NULL").select("read_id", "ref_id", "loglik")


def quantify(reads: DataFrame, index: dict, labelled: DataFrame | None = None, options: Options = Options()) -> Quantified:
    """Mixture frequencies of references, or of taxa if options.collapse, from reads (or pairs).

    reads: (read_id, name, seq, qual), or (read_id, name1, seq1, qual1, name2, seq2, qual2). labelled: (ref_id, label).
    """
    if options.paired:
        reads = reads.withColumn("name", F.col("name1"))
    cands = read_candidates(reads, index, options).persist()
    scored = score(reads, cands, index["refs"], options, index["k"])
    if options.collapse:
        labels = labelled if labelled is not None else index["refs"].select("ref_id", F.col("name").alias("label"))
        lk = em.collapse(scored, labels.select("ref_id", "label"))
    else:
        lk = scored.withColumnRenamed("ref_id", "key")
    lk = lk.persist()
    unmapped = reads.join(lk.select("read_id").distinct(), "read_id", "left_anti").select("read_id", "name")
    best = quality.best_loglik(lk)
    kept = lk
    text = F.concat("qual1", "qual2") if options.paired else F.col("qual")
    hist = quality.histogram(reads.select(text.alias("qual")), offset=options.phred).persist()
    if options.likelihood_filter:
        moments = quality.expected_loglik(hist)
        kept = quality.passing(lk, moments, options.threshold).persist()
    improbable = lk.select("read_id").distinct().join(kept.select("read_id").distinct(), "read_id", "left_anti").join(reads.select("read_id", "name"), "read_id")
    model = em.Likelihoods(kept)
    out = model.estimate(options.min_freq, em.Controls(tolerance=options.tolerance, max_evaluations=options.max_evaluations), options.state)
    model.release()
    counters = read_counters(reads, cands).first().asDict()
    counters |= {"missed_references": missed_references(cands, index["refs"]).count(), "mapped": lk.select("read_id").distinct().count(), "passed": kept.select("read_id").distinct().count(), "left": out.mapped}
    # Reads that the filter removed, reads with a single key, and bases of a quality that none should have.
    counters |= {"removed": counters["mapped"] - counters["passed"], "singles": sum(model.singles.values()), "high_qualities": quality.unlikely(hist).first().n_high}
    return Quantified(kept, out, out.frame(reads.sparkSession, kept), unmapped, improbable, best, reads.select("read_id", "name"), counters)


def posteriors(result: Quantified) -> DataFrame:
    """Posteriors of the reads that passed."""
    return em.posterior(result.lk, result.freqs)


def write_results(result: Quantified, path: str, index: dict, labelled: DataFrame | None, options: Options, fails: bool = False, max_likes: bool = False, readinfo: bool = False, lineage_format: tuple[str, bool] = (";", False)) -> None:
    """Below path: freqs, and what is asked for of fails, maxlikes and readinfo."""
    refs = index["refs"].select(F.col("ref_id").alias("key"), F.col("name").alias("ref"))
    if options.collapse:
        names = result.freqs.select("key", F.col("key").alias("ref"))
        rolled = taxonomy.rolled_counts(result.freqs, names.withColumnRenamed("ref", "label"), result.em.mapped, *lineage_format)
        tables.write_tsv(tables.collapse_rows(rolled), f"{path}/freqs")
    else:
        names = refs
        labels = refs.withColumnRenamed("ref", "label")
        if labelled is not None:
            labels = labels.join(labelled.select(F.col("ref_id").alias("key"), F.col("label").alias("taxon")), "key", "left").select("key", F.coalesce("taxon", "label").alias("label"))
        result.counters["unlabelled"] = tables.unlabelled(result.freqs, labels).count()
        tables.write_tsv(tables.result_rows(result.freqs, labels, result.em.mapped).orderBy("Label"), f"{path}/freqs")
    failed = tables.failed_rows(result.unmapped, result.improbable).orderBy("reason", "name")
    if fails or readinfo:
        tables.write_tsv(failed, f"{path}/fails", compression="gzip")
    if max_likes:
        tables.write_tsv(result.best.orderBy("read_id").select("max_ll"), f"{path}/maxlikes", header=False, compression="gzip")
    if readinfo:
        tables.write_tsv(tables.readinfo_rows(posteriors(result), result.names, names, failed).orderBy("name"), f"{path}/readinfo", compression="gzip")


def write_log(spark: SparkSession, path: str, options: Options, result: Quantified) -> None:
    """Below path: what was asked for and what was counted, a line each."""
    rows = [*vars(options).items(), *result.counters.items(), ("evaluations", result.em.evaluations), ("converged", result.em.converged), ("loglik", result.em.loglik)]
    spark.createDataFrame([(f"{name}: {value}",) for name, value in rows], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/log")


def tabulate(spark: SparkSession, manifest: str, path: str, min_freq: float = -99.0) -> None:
    """Counts and diversity of the samples in a list, written below path."""
    from mixtally.operators import diversity

    tables.write_tabulation(diversity.keep_frequent(tables.read_samples(spark, manifest), min_freq), path)
