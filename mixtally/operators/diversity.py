"""Tables of samples by label, and their diversity.

Input is long: (sample, label, cnt), a row for each label of a sample. Proportions are of a sample's total. D1 is exp(sum p ln p) and
D2 is sum p ** 2, as the tables have always shown them; the columns d1_hill and d2_hill are the Hill numbers, their reciprocals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _entropy(p):
    return F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))


def totals(otu: DataFrame) -> DataFrame:
    """(sample, label, cnt, level): totals by sample, by label, and of all."""
    level = F.when(F.grouping("sample") + F.grouping("label") == 2, "all").when(F.grouping("label") == 1, "sample").otherwise("label")
    sets = [[F.col("sample")], [F.col("label")], []]
    return otu.groupingSets(sets, "sample", "label").agg(F.sum("cnt").alias("cnt"), level.alias("level"))


def keep_frequent(otu: DataFrame, min_freq: float = -99.0) -> DataFrame:
    """Rows whose count is at least min_freq times their sample's total; a negative min_freq keeps all."""
    total = F.sum("cnt").over(Window.partitionBy("sample"))
    return otu if min_freq < 0 else otu.withColumn("__t", total).where(F.col("cnt") >= F.col("__t") * min_freq).drop("__t")


def individual(otu: DataFrame) -> DataFrame:
    """(sample, total, d0, d1, d2, d1_hill, d2_hill) of each sample; d0 counts its rows, those of count 0 too."""
    p = F.col("cnt") / F.col("total")
    rows = otu.join(otu.groupBy("sample").agg(F.sum("cnt").alias("total")), "sample")
    out = rows.groupBy("sample").agg(F.first("total").alias("total"), F.count("*").alias("d0"), F.exp(_entropy(p)).alias("d1"), F.sum(p * p).alias("d2"))
    return out.withColumn("d1_hill", 1 / F.col("d1")).withColumn("d2_hill", 1 / F.col("d2"))


def group(otu: DataFrame) -> DataFrame:
    """One row (d1_gamma, d2_gamma, d1_beta, d2_beta): gamma of the pooled counts, and its ratio to the samples' weighted mean."""
    by_label = otu.groupBy("label").agg(F.sum("cnt").alias("cnt"))
    all_ = by_label.agg(F.sum("cnt").alias("total"))
    p = F.col("cnt") / F.col("total")
    gamma = by_label.crossJoin(F.broadcast(all_)).agg(F.exp(_entropy(p)).alias("d1_gamma"), F.sum(p * p).alias("d2_gamma"))
    each = individual(otu)
    alpha = each.agg((F.sum(F.col("total") * F.col("d1")) / F.sum("total")).alias("a1"), (F.sum(F.col("total") * F.col("d2")) / F.sum("total")).alias("a2"))
    return gamma.crossJoin(F.broadcast(alpha)).select("d1_gamma", "d2_gamma", (F.col("d1_gamma") / F.col("a1")).alias("d1_beta"), (F.col("d2_gamma") / F.col("a2")).alias("d2_beta"))


#: Parts that each label's samples are dealt to as a pair's first one.
PARTS = 16


def _shared(otu: DataFrame) -> DataFrame:
    """(s1, s2, sum_min, sum_prod): of pairs of samples with a common label, s1 < s2, over common labels.

    A label that all samples have would be one task: its samples meet in PARTS, each of which has a part of the first ones and all second ones.
    """
    part = F.pmod(F.xxhash64("sample"), F.lit(PARTS))
    a = otu.select("label", F.col("sample").alias("s1"), F.col("cnt").alias("c1"), part.alias("part"))
    b = otu.select("label", F.col("sample").alias("s2"), F.col("cnt").alias("c2"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
    return a.join(b, ["label", "part"]).where("s1 < s2").groupBy("s1", "s2").agg(F.sum(F.least("c1", "c2")).alias("sum_min"), F.sum(F.col("c1") * F.col("c2")).alias("sum_prod"))


def pairwise(otu: DataFrame) -> DataFrame:
    """(s1, s2, bray_curtis, d2_beta) of each pair of samples, s1 < s2.

    Both follow from sums over the labels that two samples share (sum |x - y| = t1 + t2 - 2 sum min(x, y)), so one join on the
    label serves both, and pairs without a common label are filled in by their totals.
    """
    each = individual(otu).select("sample", "total", "d2")
    x = each.select(F.col("sample").alias("s1"), F.col("total").alias("t1"), F.col("d2").alias("x1"))
    y = each.select(F.col("sample").alias("s2"), F.col("total").alias("t2"), F.col("d2").alias("x2"))
    pairs = x.join(y, F.col("s1") < F.col("s2")).join(_shared(otu), ["s1", "s2"], "left")
    t = F.col("t1") + F.col("t2")
    common, product = F.coalesce("sum_min", F.lit(0.0)), F.coalesce("sum_prod", F.lit(0.0))
    squares = F.col("x1") * F.col("t1") * F.col("t1") + F.col("x2") * F.col("t2") * F.col("t2") + 2 * product
    alpha = (F.col("t1") * F.col("x1") + F.col("t2") * F.col("x2")) / t
    return pairs.select("s1", "s2", ((t - 2 * common) / t).alias("bray_curtis"), (squares / (t * t) / alpha).alias("d2_beta"))


def wide(otu: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """A row for each sample, a column for each label, 0 where a sample lacks it. Naming the labels saves a pass."""
    pivot = otu.groupBy("sample").pivot("label", labels) if labels else otu.groupBy("sample").pivot("label")
    return pivot.agg(F.sum("cnt")).na.fill(0)
