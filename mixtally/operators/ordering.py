"""Places and running totals along a whole table, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixtally.operators.settle import checkpointed


def running_total(rows: DataFrame, order: str, amount: Column, out: str) -> DataFrame:
    """rows with `out`, the sum of `amount` over the rows before, by a distinct, sortable column.

    Rows are sorted into ranges; each range sums within itself, and the ranges' totals, a row for each partition, are added up.
    """
    parts = checkpointed(rows.withColumn("__amount", amount.cast("long")).orderBy(order).withColumn("__part", F.spark_partition_id()))
    before = parts.groupBy("__part").agg(F.sum("__amount").alias("__n"))
    before = before.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    along = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumn("__own", F.coalesce(F.sum("__amount").over(along), F.lit(0)))
    return own.join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + F.col("__own")).drop("__amount", "__part", "__own", "__before")


def numbered(rows: DataFrame, order: str, out: str, first: int = 0) -> DataFrame:
    """rows with `out`, first, first + 1, ... by a distinct, sortable column."""
    return running_total(rows, order, F.lit(1), out).withColumn(out, (F.col(out) + first).cast("int"))
