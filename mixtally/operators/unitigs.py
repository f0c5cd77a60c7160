"""Unitigs: maximal non-branching paths of the k-mer graph, and references as walks along them.

Nodes are oriented k-mers, each of a sequence's k-mers and its twin. An edge leads to the only successor of a node whose only
predecessor that node is. Places on paths are found by pointer doubling: each step every node learns the node twice as far
back, and the least node on the way with its distance. A path's nodes learn their head and their distance from it; a cycle has no
head, but once the steps span it every node knows the cycle's least node and how far back it is, so the cycle is cut there. A
path or cycle of length L takes log2 L joins, three of them between checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixtally.functions.sequences import append_base, is_kmer, kmers, reverse_complement
from mixtally.operators.kmer_index import positions
from mixtally.operators.settle import checkpointed

#: Doublings in one plan.
DOUBLINGS = 3


def oriented(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer): each k-mer of the sequences, and its twin."""
    one = seqs.select(F.explode(kmers(F.upper(seq), k)).alias("kmer")).where(is_kmer("kmer")).distinct()
    return one.unionByName(one.select(reverse_complement("kmer").alias("kmer"))).distinct()


def edges(nodes: DataFrame) -> DataFrame:
    """(a, b): oriented k-mers and their unique successors, where both are unique."""
    nexts = nodes.select(F.col("kmer").alias("a"), F.explode(F.array(*(append_base("kmer", F.lit(b)) for b in "ACGT"))).alias("b"))
    found = nexts.join(nodes.select(F.col("kmer").alias("b")), "b", "left_semi")
    out_one = found.groupBy("a").agg(F.count("*").alias("n"), F.first("b").alias("b")).where("n = 1").select("a", "b")
    in_one = found.groupBy("b").agg(F.count("*").alias("n")).where("n = 1").select("b")
    # A node that leads to itself or to its own twin ends a path.
    return out_one.join(in_one, "b", "left_semi").select("a", "b").where((F.col("a") != F.col("b")) & (F.col("b") != reverse_complement("a")))


def _doubled(at: DataFrame) -> DataFrame:
    """at (a, head, dist, low, far), each row of which spans twice as many nodes back."""
    behind = at.select(F.col("a").alias("head"), F.col("head").alias("h2"), F.col("dist").alias("d2"), F.col("low").alias("l2"), F.col("far").alias("f2"))
    nearer = F.col("low") <= F.col("l2")
    return at.join(behind, "head").select("a", F.col("h2").alias("head"), (F.col("dist") + F.col("d2")).alias("dist"), F.least("low", "l2").alias("low"), F.when(nearer, F.col("far")).otherwise(F.col("dist") + F.col("f2")).alias("far"))


def places(nodes: DataFrame) -> DataFrame:
    """(kmer, path, place, cycle): of each node its path, named by its first node, and the steps from there. A cycle begins at its least node."""
    back = edges(nodes).select(F.col("b").alias("a"), F.col("a").alias("p"))
    step = F.when(F.col("p").isNull(), 0).otherwise(1).cast("long")
    low = F.least("a", F.coalesce("p", "a"))
    at = nodes.select(F.col("kmer").alias("a")).join(back, "a", "left").select("a", F.coalesce("p", "a").alias("head"), step.alias("dist"), low.alias("low"), F.when(low == F.col("a"), F.lit(0)).otherwise(step).alias("far"))
    at = checkpointed(at)
    heads = at.where("head = a").select(F.col("a").alias("head"))
    size, before = 1, -1
    while True:
        moving = at.join(heads, "head", "left_anti")
        n = moving.count()
        # Rows that no step brings to a head, though the steps span more nodes than there are such rows, lie on cycles.
        if n == 0 or n == before and size >= n:
            break
        before = n
        for _ in range(DOUBLINGS):
            at = _doubled(at)
            size *= 2
        at = checkpointed(at)
    ended = at.join(heads, "head", "left_semi").select(F.col("a").alias("kmer"), F.col("head").alias("path"), F.col("dist").alias("place"), F.lit(False).alias("cycle"))
    return ended.unionByName(moving.select(F.col("a").alias("kmer"), F.col("low").alias("path"), F.col("far").alias("place"), F.lit(True).alias("cycle")))


def unitigs(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(unitig, n_kmers, seq): each path once, as the lesser of itself and its reverse complement; unitig is its number by hash.

    Of a cycle and its twin, that with the lesser least node stays, from that node on.
    """
    at = places(oriented(seqs, k, seq))
    ordered = at.groupBy("path", "cycle").agg(F.array_sort(F.collect_list(F.struct("place", "kmer"))).alias("x"), F.min(reverse_complement("kmer")).alias("twin"))
    text = F.concat(F.element_at("x", 1)["kmer"], F.array_join(F.transform(F.slice("x", F.lit(2), F.size("x")), lambda s: F.substring(s["kmer"], k, 1)), ""))
    paths = ordered.where("NOT cycle OR path <= twin").select("cycle", F.size("x").alias("n_kmers"), text.alias("seq"))
    out = paths.select("n_kmers", F.when(F.col("cycle"), F.col("seq")).otherwise(F.least("seq", reverse_complement("seq"))).alias("seq")).distinct()
    return out.select(F.xxhash64("seq").alias("unitig"), "n_kmers", "seq")


def map_targets(seqs: DataFrame, paths: DataFrame, k: int, key: str = "ref_id", seq: str = "seq") -> DataFrame:
    """(key, pos, unitig, sense, start, stop): each sequence as a walk along unitigs.

    From place pos on, the sequence follows k-mers [start, stop) of the unitig, forward or, without sense, backward. Windows with
    other letters than bases are in no unitig and end a stretch.
    """
    inside = positions(paths, k, "unitig").select("kmer", "unitig", F.col("pos").alias("at"), F.col("forward").alias("own"))
    hits = positions(seqs, k, key, seq).join(inside, "kmer").withColumn("sense", F.col("forward") == F.col("own"))
    # Along one stretch the unitig's place runs with the sequence's, or against it.
    line = F.when(F.col("sense"), F.col("at") - F.col("pos")).otherwise(F.col("at") + F.col("pos"))
    along = Window.partitionBy(key, "unitig", "sense", "line").orderBy("pos")
    rows = hits.withColumn("line", line).withColumn("stretch", F.col("pos") - F.row_number().over(along))
    return rows.groupBy(key, "unitig", "sense", "line", "stretch").agg(F.min("pos").alias("pos"), F.min("at").alias("start"), (F.max("at") + 1).alias("stop")).select(key, "pos", "unitig", "sense", "start", "stop")


def target_pieces(walk: DataFrame, paths: DataFrame, k: int, key: str = "ref_id") -> DataFrame:
    """(key, pos, seq): the letters that each stretch of a walk spells, for `intervals.rebuild` with an overlap of k - 1."""
    rows = walk.join(paths.select("unitig", "seq"), "unitig")
    piece = F.substring("seq", F.col("start") + 1, F.col("stop") - F.col("start") + F.lit(k - 1))
    return rows.select(key, "pos", F.when(F.col("sense"), piece).otherwise(reverse_complement(piece)).alias("seq"))
