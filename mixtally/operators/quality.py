"""Base qualities: their histogram, the log-likelihood they lead to expect, and the filter of improbable reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(reads: DataFrame, qual: str = "qual", offset: int = 33) -> DataFrame:
    """(pos, q, n): reads with quality q at place pos, from 0. Of a pair, pass mate 1's and mate 2's qualities joined."""
    each = reads.select(F.posexplode(F.split(qual, "")).alias("pos", "c")).where("c <> ''")
    return each.select("pos", (F.ascii("c") - offset).alias("q")).groupBy("pos", "q").agg(F.count("*").alias("n"))


#: Qualities beyond this are rarely meant: a file of another offset, perhaps.
HIGHEST = 42


def unlikely(hist: DataFrame, highest: int = HIGHEST) -> DataFrame:
    """One row (n_high): bases whose quality is above `highest`."""
    return hist.agg(F.coalesce(F.sum(F.when(F.col("q") > highest, F.col("n"))), F.lit(0)).alias("n_high"))


def error_of(q: Column) -> Column:
    """Chance of a wrong base for the filter: 10 ** (-q / 10), but 0.75 for q = 2 and 0 for q = 0."""
    return F.when(q == 2, 0.75).when(q == 0, 0.0).otherwise(F.pow(F.lit(10.0), -q / 10.0))


def expected_loglik(hist: DataFrame) -> DataFrame:
    """One row (mean, var): of the log-likelihood of a read whose bases have the histogram's qualities and errors of that chance."""
    e = error_of(F.col("q"))
    right = F.when(e < 1, F.log(1 - e)).otherwise(0.0)
    wrong = F.when(e > 0, F.log(e / 3)).otherwise(0.0)
    m1 = (1 - e) * right + e * wrong
    m2 = (1 - e) * right * right + e * wrong * wrong
    pos = hist.groupBy("pos").agg((F.sum(F.col("n") * m1) / F.sum("n")).alias("m1"), (F.sum(F.col("n") * m2) / F.sum("n")).alias("m2"))
    return pos.agg(F.sum("m1").alias("mean"), F.sum(F.col("m2") - F.col("m1") * F.col("m1")).alias("var"))


def best_loglik(lk: DataFrame, key: str = "read_id") -> DataFrame:
    """(key, max_ll): the best of each read's log-likelihoods."""
    return lk.groupBy(key).agg(F.max("loglik").alias("max_ll"))


def passing(lk: DataFrame, moments: DataFrame, threshold: float = -2.0, key: str = "read_id") -> DataFrame:
    """Rows of reads whose best log-likelihood is over mean + threshold * sd. The moments are one row, and are broadcast."""
    limit = moments.select((F.col("mean") + F.sqrt("var") * F.lit(threshold)).alias("__limit"))
    good = best_loglik(lk, key).join(F.broadcast(limit)).where("max_ll > __limit").select(key)
    return lk.join(good, key, "left_semi")
