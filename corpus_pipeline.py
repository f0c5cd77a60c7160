"""A corpus pipeline: five stages over documents, each of which applies one operator to all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All but
the last return the columns of documents; further columns, whatever their names, are left out. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtally.llm import bpe, decontaminate, jaccard, quality, substring_words
from mixtally.llm.warc import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score, learned from labels that aren't held out, is 0.5 or more.

    A null or empty text has the score of its length. Repeated rows and rows without a doc_id are scored like any; rows of equal
    texts go or stay together. Texts are scored whole, a block of 256 bytes at a time.
    """
    model = quality.fit_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, out="__score").where("__score >= 0.5").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group that near-duplicate links connect.

    Null, empty and blank texts link with nothing and stay, as do rows without a doc_id. Rows that repeat one doc_id are one
    document: all of them go or stay, even if their texts differ.
    """
    found = jaccard.near_duplicates(docs.select("doc_id", "text"))
    gone = jaccard.C.checkpointed(found.where("component_id <> doc_id").select("doc_id").distinct())
    if gone.count() <= jaccard.BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 13-word windows that an earlier document has; those with no word left go, others that lose none stay as they are.

    Null, empty and short texts lose nothing and stay. Rows that repeat one doc_id never take each other's words; a row without a
    doc_id comes after all others. What stays of a cut text is joined by single spaces, and n_chars counts it anew.
    """
    found = substring_words.remove_repeats(docs.select(*COLUMNS))
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.where(~cut | (F.col("n_removed") < F.col("n_words"))).select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs.

    Null and empty texts have none and stay; repeated rows go or stay together; a null item or one without words matches nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_contamination(docs.select(*COLUMNS), items).where("not contaminated").select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to.

    A null or empty text has no ids and an empty text; repeated rows and rows without a doc_id are encoded like any.
    """
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    ids = bpe.encode(docs.select(*COLUMNS), ranks, public_tokenizers.PATTERN, decoded="decoded")
    return ids.withColumn("text", F.decode("decoded", "UTF-8")).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "text")


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: The first and the last stage can't be written in SQL; tests hold run() against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
