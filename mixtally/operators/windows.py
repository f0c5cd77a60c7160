"""Windows of references: what of a reference a read can align with, so that equal windows of different references are aligned once.

A read's k-mers that a candidate reference has, in the same sense, lie on diagonals (place in the reference less place in the read).
The window reaches from the least diagonal to the greatest, with the read's length and a margin around: strains that differ elsewhere
give a read the same window, letter by letter, and then the same alignment, but for where it begins. A read with no such k-mer (one
from the other strand, say) has the whole reference for its window.

The alignment found is the whole reference's wherever that shares a k-mer with the read within the margin of its gaps; one that
shares none, and so has an edit in each k bases, isn't looked for beyond the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtally.functions.sequences import canonical_kmers
from mixtally.operators import align
from mixtally.operators.kmer_index import positions

#: Bases of the reference on each side beyond the read's own length.
MARGIN = 32


def cut(cands: DataFrame, refs: DataFrame, k: int, margin: int = MARGIN) -> DataFrame:
    """cands (read_id, ref_id, seq, ...) with `window`, a part of the reference's bases, and `at`, its place there.

    refs: (ref_id, seq). Only k-mers that a read has in common with its own candidates are met; a window is a row, not a group.
    """
    rows = cands.select("read_id", "ref_id", F.upper("seq").alias("s"))
    own = rows.select("read_id", "ref_id", "s", F.posexplode(canonical_kmers("s", k)).alias("i", "kmer")).where("kmer IS NOT NULL")
    own = own.select("read_id", "ref_id", "kmer", "i", (F.substring("s", F.col("i") + 1, F.lit(k)) == F.col("kmer")).alias("forward"))
    at = positions(refs.join(cands.select("ref_id").distinct(), "ref_id", "left_semi"), k)
    # A k-mer of both senses at once doesn't exist for odd k; of hits against the read's sense nothing is known here.
    hits = own.join(at, ["ref_id", "kmer", "forward"]).groupBy("read_id", "ref_id").agg(F.min(F.col("pos") - F.col("i")).alias("low"), F.max(F.col("pos") - F.col("i")).alias("high"))
    out = cands.join(hits, ["read_id", "ref_id"], "left").join(refs.select("ref_id", F.col("seq").alias("r")), "ref_id")
    begin = F.greatest(F.lit(0), F.col("low") - margin)
    size = F.col("high") + F.length("seq") + margin - begin
    window = F.when(F.col("low").isNull(), F.col("r")).otherwise(F.substring(F.col("r"), (begin + 1).cast("int"), size.cast("int")))
    return out.select(*cands.columns, window.alias("window"), F.coalesce(begin, F.lit(0)).cast("int").alias("at"))


def score(cands: DataFrame, refs: DataFrame, k: int, offset: int = 33, scoring: align.Scoring = align.Scoring(), margin: int = MARGIN) -> DataFrame:
    """cands (read_id, ref_id, seq, qual) with the alignment's columns, as `align.score_single` on whole references; places are the reference's.

    Reads and windows that are equal, letter by letter, are one alignment: distinct ones are aligned and joined back.
    """
    rows = cut(cands, refs, k, margin)
    found = align.score_single(distinct(rows).withColumnRenamed("window", "ref_seq"), offset, scoring).withColumnRenamed("ref_seq", "window")
    moved = [(F.when(F.col(c) >= 0, F.col(c) + F.col("at")).otherwise(F.col(c))).alias(c) if c in ("ref_begin", "ref_end") else F.col(c) for c in (f.name for f in align.ALIGNMENT)]
    return rows.join(found, ["seq", "qual", "window"]).select(*cands.columns, *moved)


def distinct(rows: DataFrame) -> DataFrame:
    """What there is to align: distinct reads, with their qualities, and windows."""
    return rows.select("seq", "qual", "window").distinct()
