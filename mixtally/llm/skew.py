"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from one in so many of the left rows on; so there are at most as many hot keys, and they may be broadcast.
SHARE = 1000


def unused(name: str, *frames: DataFrame) -> str:
    """The name, with underscores behind it until no column of the frames is called so."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """left joined with right, of which each key has one row; left's rows of hot keys are spread over all partitions.

    Hot keys are those with at least 1 / SHARE of left's rows, so there are SHARE at most. Their rows of left get a salt, from a hash of
    all their columns, and their rows of right a copy for each salt. left is read twice. A null key meets nothing.
    """
    salts = max(16, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    total = left.agg(F.count("*").alias("__all"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("__n") * SHARE >= F.col("__all")).where(F.col("__n") > salts).select(F.col(key).alias("__hot"))
    a, b = F.broadcast(hot), F.broadcast(hot)
    salt = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)), F.lit(salts))).otherwise(0).cast("int")
    own = left.join(a, F.col(key) == F.col("__hot"), "left").withColumn("__salt", salt).drop("__hot")
    copies = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    other = right.join(b, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return own.join(other, [key, "__salt"], how).drop("__salt")
