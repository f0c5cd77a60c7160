"""Looking reads up along unitigs: a read that follows a stretch of the graph is probed at its ends and its middle, not at every window.

A segment is a stretch of a unitig whose k-mers all have one class. If two windows of a read hit one segment, in one sense and as far
apart on it as in the read, the windows between them are taken to lie on it too, and have its class. Lookup is in rounds of joins over
open intervals of windows, each a row with what its two ends hit:

* ends that agree close the interval once its middle agrees with them;
* ends that don't, or of which one misses, are halved at the middle, which is probed;
* where both miss there is nothing to jump along, so every window between them is looked up, all such intervals in one last join.

Reads of which no window passes the index's sieve hit nothing, and no round sees them.

A round so leaves, of each read, the intervals around the places where it enters or leaves a segment; there are log2 of the longest
read's windows at most. A read probes some log2 of its windows for each such place, and all windows only where it misses.

The classes found are those that every window would give, unless a read leaves a segment between two windows that agree and comes
back to it where it would have been (a substitution in a long repeat-free stretch, say), and only those windows hit another class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixtally.functions.sequences import canonical, is_kmer
from mixtally.operators import sieve, unitigs
from mixtally.operators.kmer_index import positions, sequence_kmers
from mixtally.operators.settle import checkpointed, small

HIT = "struct<ec_id:bigint,segment:bigint,place:bigint,sense:boolean>"


def segments(refs: DataFrame, kmer_ec: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, ec_id, segment, place, forward): of each k-mer of the index its segment, its place there and whether it reads forward."""
    paths = checkpointed(unitigs.unitigs(refs, k, seq))
    inside = positions(paths.select("unitig", "seq"), k, "unitig").join(kmer_ec, "kmer")
    along = Window.partitionBy("unitig").orderBy("pos")
    change = F.when(F.lag("ec_id").over(along) == F.col("ec_id"), 0).otherwise(1)
    rows = inside.withColumn("change", change).withColumn("run", F.sum("change").over(along))
    place = (F.col("pos") - F.min("pos").over(Window.partitionBy("unitig", "run"))).cast("long")
    return rows.select("kmer", "ec_id", F.xxhash64("unitig", "run").alias("segment"), place.alias("place"), "forward")


def _probed(rows: DataFrame, index: DataFrame, k: int, at: str, out: str) -> DataFrame:
    """rows with what the window that begins at `at` hits, null if nothing."""
    rows = rows.withColumn("window", F.substring("s", F.col(at) + 1, F.lit(k)))
    rows = rows.withColumn("kmer", F.when(is_kmer("window"), canonical("window")))
    own = index.select("kmer", F.col("ec_id").alias("e"), F.col("segment").alias("g"), F.col("place").alias("p"), F.col("forward").alias("f"))
    hit = F.struct(F.col("e").alias("ec_id"), F.col("g").alias("segment"), F.col("p").alias("place"), (F.col("f") == (F.col("window") == F.col("kmer"))).alias("sense"))
    return rows.join(own, "kmer", "left").withColumn(out, F.when(F.col("e").isNotNull(), hit).otherwise(F.lit(None).cast(HIT))).drop("kmer", "window", "e", "g", "p", "f")


def _agree(a: Column, at: Column, b: Column, bt: Column) -> Column:
    """Whether two hits lie on one segment as far apart as in the read; false if either is none."""
    apart = F.when(a["sense"], bt - at).otherwise(at - bt)
    same = (a["segment"] == b["segment"]) & (a["sense"] == b["sense"]) & (b["place"] - a["place"] == apart)
    return F.coalesce(same, F.lit(False))


def match(reads: DataFrame, index: DataFrame, k: int, key: str = "read_id", seq: str = "seq", counts: list[int] | None = None) -> DataFrame:
    """(key, ec_id): the classes that each read hits. index: as `segments` gives it; counts gets the number of windows probed in each join."""
    sifted = sieve.sieve(index, k)
    index = small(index.select("kmer", "ec_id", "segment", "place", "forward"), sifted.n)
    if counts is None and sifted.bits is not None:
        reads = sieve.touched(reads, sifted, key, seq)
    rows = reads.select(key, F.upper(seq).alias("s"), F.lit(0).alias("lo"), (F.length(seq) - k).alias("hi")).where("hi >= 0")
    rows = checkpointed(_probed(_probed(rows, index, k, "lo", "left"), index, k, "hi", "right"))
    found = [rows.select(key, "left.ec_id"), rows.select(key, "right.ec_id")]
    missed = []
    lo, hi, mid = F.col("lo"), F.col("hi"), F.col("mid")
    left, right, middle = F.col("left"), F.col("right"), F.col("middle")
    if counts is not None:
        counts += [rows.count(), rows.where("hi > lo").count()]
    rows = rows.where(hi - lo > 1)
    while True:
        none = left.isNull() & right.isNull()
        missed.append(rows.where(none).select(key, "s", "lo", "hi"))
        rows = rows.where(~none).withColumn("mid", F.floor((lo + hi) / 2).cast("int"))
        rows = checkpointed(_probed(rows, index, k, "mid", "middle"))
        n = rows.count()
        if n == 0:
            break
        if counts is not None:
            counts.append(n)
        found.append(rows.select(key, "middle.ec_id"))
        halves = F.array(
            F.struct(lo.alias("lo"), mid.alias("hi"), left.alias("left"), middle.alias("right"), _agree(left, lo, middle, mid).alias("closed")),
            F.struct(mid.alias("lo"), hi.alias("hi"), middle.alias("left"), right.alias("right"), _agree(middle, mid, right, hi).alias("closed")),
        )
        rows = rows.select(key, "s", F.explode(halves).alias("h")).select(key, "s", "h.*").where((hi - lo > 1) & ~F.col("closed")).drop("closed")
    # The letters between the ends of an interval, of which all inner windows are looked up.
    inner = None
    for part in missed:
        own = part.select(key, F.expr(f"substring(s, lo + 2, hi - lo - 2 + {k})").alias(seq))
        inner = own if inner is None else inner.unionByName(own)
    if counts is not None:
        counts.append(sequence_kmers(inner, k, key, seq).count())
    out = sieve.windows(inner, sifted, key, seq).join(index, "kmer").select(key, "ec_id")
    for part in found:
        out = out.unionByName(part.where("ec_id IS NOT NULL"))
    return out.distinct()
