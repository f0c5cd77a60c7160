"""Half-open intervals cut at each other's ends: segments, what covers them, and rebuilding sequences from pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(spans: DataFrame, group: str, start: str, stop: str) -> DataFrame:
    """(group, lo, hi): neighbouring distinct ends of a group's intervals, as half-open segments."""
    ends = spans.select(group, F.explode(F.array(start, stop)).alias("lo")).distinct()
    following = F.lead("lo").over(Window.partitionBy(group).orderBy("lo"))
    return ends.withColumn("hi", following).where("hi IS NOT NULL")


def coverage(spans: DataFrame, group: str, start: str, stop: str, what: str) -> DataFrame:
    """(group, lo, hi, what): the intervals that overlap each segment. No interval crosses a segment's end.

    Segments of a group are numbered along it, so an interval covers those from its start's number to the one before its stop's:
    two equi-joins and a sequence instead of a range join. The work is that of the ends and of the result. An interval without
    length covers nothing; one with a null end neither cuts nor covers.
    """
    own = spans.where(F.col(start).isNotNull() & F.col(stop).isNotNull())
    ends = own.select(group, F.explode(F.array(start, stop)).alias("lo")).distinct()
    along = Window.partitionBy(group).orderBy("lo")
    cut = ends.select(group, "lo", F.lead("lo").over(along).alias("hi"), F.row_number().over(along).alias("__n"))
    first = cut.select(group, F.col("lo").alias(start), F.col("__n").alias("__first"))
    behind = cut.select(group, F.col("lo").alias(stop), F.col("__n").alias("__behind"))
    placed = own.where(F.col(start) < F.col(stop)).select(group, start, stop, what).join(first, [group, start]).join(behind, [group, stop])
    each = placed.select(group, what, F.explode(F.sequence("__first", F.col("__behind") - 1)).alias("__n"))
    return each.join(cut, [group, "__n"]).select(group, "lo", "hi", what)


def depth(spans: DataFrame, group: str, start: str, stop: str) -> DataFrame:
    """(group, lo, hi, n): how many intervals cover each segment, by a running sum of starts and stops instead of a range join."""
    steps = spans.select(group, F.col(start).alias("lo"), F.lit(1).alias("d")).unionByName(spans.select(group, F.col(stop).alias("lo"), F.lit(-1).alias("d")))
    steps = steps.groupBy(group, "lo").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(group).orderBy("lo")
    return steps.select(group, "lo", F.lead("lo").over(w).alias("hi"), F.sum("d").over(w).alias("n")).where("hi IS NOT NULL")


def runs(hits: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, run, value, n): runs of equal neighbouring values, numbered from 1."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return hits.withColumn("__new", new).withColumn("run", F.sum("__new").over(w)).groupBy(key, "run", value).agg(F.count("*").alias("n"))


def rebuild(pieces: DataFrame, key: str, position: str, seq: str, overlap: int) -> DataFrame:
    """(key, seq): pieces joined in order of position; each after the first without its first `overlap` letters."""
    ordered = F.array_sort(F.collect_list(F.struct(position, seq)))
    text = F.array_join(F.transform(ordered, lambda p, i: F.when(i == 0, p[seq]).otherwise(F.substring(p[seq], F.lit(overlap + 1), F.length(p[seq])))), "")
    return pieces.groupBy(key).agg(text.alias(seq))
