"""Candidates of reads as they arrive. The index stands still, so the stream has no state; the EM runs on what it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtally.operators import candidates, kmer_index

READS = "read_id long, name string, seq string, qual string"


def read_stream(spark: SparkSession, path: str, files_at_once: int = 16) -> DataFrame:
    """Reads from a folder of Parquet files that grows."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_at_once).parquet(path)


def write_candidates(reads: DataFrame, index: dict, path: str, checkpoint: str, lenient: bool = True):
    """Starts a query that appends (read_id, ref_id, mode, batch) below path and ends when it has caught up.

    Each batch is a plan of its own, so its group-bys need no watermark; a batch that is repeated after a failure overwrites
    its own part, and no candidate is written twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        voted = candidates.votes(kmer_index.match(batch, index["kmer_ec"], index["k"]), index["ecs"])
        found = candidates.candidates(voted, lenient).withColumn("batch", F.lit(number))
        found.drop("batch").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
