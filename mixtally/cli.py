"""Command line: python -m mixtally.cli -c index|quantify|tabulate ..."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from mixtally.functions.sequences import check_k
from mixtally.operators import kmer_index, taxonomy
from mixtally.plans import quantify as plans
from mixtally.sources import fastx, tables

VERSION = "0.1"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mixtally", description="Mixture quantification of sequencing reads")
    p.add_argument("-c", "--command", required=True, choices=("index", "quantify", "tabulate"))
    p.add_argument("-r", "--ref", help="FASTA files, comma-separated")
    p.add_argument("-f", "--forward", help="FASTQ files, comma-separated; mate 1 if paired")
    p.add_argument("-q", "--reverse", help="FASTQ files of mate 2")
    p.add_argument("-t", "--tax", help="taxonomy files")
    p.add_argument("--samples", help="list of samples and their results")
    p.add_argument("-i", "--index", help="index folder")
    p.add_argument("-k", "--kmer", type=int, default=31, help="odd, 3 to 31; quantify takes the index's")
    p.add_argument("--paired", action="store_true")
    p.add_argument("--threads", type=int, default=1, help="cores of a local session")
    p.add_argument("--phred", type=int, default=33, choices=(33, 64))
    p.add_argument("--max_em_it", type=int, default=2500, help="evaluations of the EM map")
    p.add_argument("--em_tolerance", type=float, default=1e-12)
    p.add_argument("--min_freq", type=float, default=-99.0, help="quantify: one mapped read by default; tabulate: off by default")
    p.add_argument("--like_thresh", type=float, default=-2.0)
    p.add_argument("--min_range", type=int, default=1, help="least bases that a read's hits must span")
    p.add_argument("-o", "--out", default="mixtally")
    for name, text in (("collapse", "frequencies of taxa"), ("fail", "write failed reads"), ("no_harp_filter", "no likelihood filter"), ("keep_mate2_quality", "leave mate 2's qualities in the order of the file"), ("strict", "no lenient candidates"), ("max_like_out", "write best likelihoods"), ("readinfo", "write posteriors of reads"), ("skip_ahead", "jump along unitigs instead of looking every window of a read up"), ("windows", "align single reads with windows of references, equal ones once")):
        p.add_argument(f"--{name}", action="store_true", help=text)
    p.add_argument("--state", help="a folder for the EM's states, from which a killed run goes on")
    p.add_argument("--version", action="version", version=VERSION)
    return p


def checked(args: argparse.Namespace, p: argparse.ArgumentParser) -> argparse.Namespace:
    need = {"index": ("ref", "index"), "quantify": ("ref", "forward", "index"), "tabulate": ("samples",)}[args.command]
    for name in need:
        if getattr(args, name) is None:
            p.error(f"{args.command} needs --{name}")
    if args.command == "index":
        try:
            check_k(args.kmer)
        except ValueError as e:
            p.error(str(e))
    if args.command == "quantify" and args.paired:
        if args.reverse is None or len(args.reverse.split(",")) != len(args.forward.split(",")):
            p.error("paired reads need as many files of either mate")
    if args.collapse and args.tax is None:
        p.error("--collapse needs a taxonomy")
    return args


def inputs(args: argparse.Namespace) -> list[str]:
    """The files that a command reads."""
    names = {"index": ("ref",), "quantify": ("forward", "reverse", "tax", "index"), "tabulate": ("samples",)}[args.command]
    return [p.strip() for n in names if getattr(args, n) for p in getattr(args, n).split(",") if p.strip()]


def stale_indexes(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """Of the FASTA files with a .fai beside them, those that are newer than it."""
    files = [p.strip() for p in (args.ref or "").split(",") if p.strip()]
    return [p for p in files if not tables.missing_files(spark, [p, f"{p}.fai"]) and tables.stale_index(spark, p, f"{p}.fai")]


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Runs a command; what it counted and warns of."""
    began = time.time()
    gone = tables.missing_files(spark, inputs(args))
    if gone:
        raise FileNotFoundError(f"no such file: {', '.join(gone)}")
    if args.command == "index":
        warned = plans.build_index(spark, args.ref, args.index, args.kmer)
        return warned | {"stale": stale_indexes(spark, args), "seconds": time.time() - began}
    if args.command == "tabulate":
        plans.tabulate(spark, args.samples, args.out, args.min_freq)
        return {"seconds": time.time() - began}
    index = kmer_index.load(spark, args.index)
    labelled, form = None, (";", False)
    if args.tax:
        taxa = tables.read_taxonomy(spark, args.tax)
        form = tables.taxonomy_format(taxa)
        labelled = taxonomy.assign_labels(taxa, index["refs"])
    options = plans.Options(phred=args.phred, paired=args.paired, collapse=args.collapse, lenient=not args.strict, likelihood_filter=not args.no_harp_filter, threshold=args.like_thresh, min_freq=None if args.min_freq < 0 else args.min_freq, max_evaluations=args.max_em_it, tolerance=args.em_tolerance, min_range=args.min_range, reverse_quality=not args.keep_mate2_quality, skip_ahead=args.skip_ahead, windows=args.windows, state=args.state)
    reads = fastx.read_pairs(spark, args.forward, args.reverse) if args.paired else fastx.read_reads(spark, args.forward)
    result = plans.quantify(reads, index, labelled, options)
    plans.write_results(result, args.out, index, labelled, options, args.fail, args.max_like_out, args.readinfo, form)
    plans.write_log(spark, args.out, options, result)
    return result.counters | {"stale": stale_indexes(spark, args), "evaluations": result.em.evaluations, "converged": result.em.converged, "loglik": result.em.loglik, "seconds": time.time() - began}


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = checked(p.parse_args(argv), p)
    spark = SparkSession.builder.appName("mixtally").getOrCreate() if args.threads <= 1 else SparkSession.builder.appName("mixtally").master(f"local[{args.threads}]").getOrCreate()
    for name, value in run(spark, args).items():
        print(f"{name}: {value}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
