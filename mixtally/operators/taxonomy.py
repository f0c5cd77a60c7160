"""Taxonomy: labels of references, their sizes, and counts rolled up the lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixtally.functions.sequences import lineage
from mixtally.operators.ordering import numbered


def sniff(label: str) -> tuple[str, bool]:
    """The delimiter of a lineage (`; ` or `;`) and whether its ranks have prefixes such as `k__`."""
    delimiter = "; " if "; " in label else ";" if ";" in label else None
    if delimiter is None:
        raise ValueError(f"no lineage delimiter in {label!r}")
    return delimiter, "__" in label.split(delimiter)[0]


def assign_labels(taxa: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref_id, name, label, label_id): labels of known references. Ids count labels by the first reference that has each.

    taxa: (name, label); refs: (ref_id, name). The ids number labels, of which there is one for each taxon, not rows.
    """
    known = taxa.dropDuplicates(["name"]).join(refs.select("ref_id", "name"), "name")
    first = known.groupBy("label").agg(F.min("ref_id").alias("first"))
    ids = numbered(first, "first", "label_id", 1).select("label", "label_id")
    return known.join(ids, "label").select("ref_id", "name", "label", "label_id")


def label_sizes(labelled: DataFrame) -> DataFrame:
    """(label, size): references of each label."""
    return labelled.groupBy("label").agg(F.count("*").alias("size"))


def with_default(refs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(ref_id, label): each reference's label; one without is a taxon of its own, named by its id."""
    return refs.select("ref_id").join(labelled.select("ref_id", "label"), "ref_id", "left").select("ref_id", F.coalesce("label", F.col("ref_id").cast("string")).alias("label"))


def rollup(freqs: DataFrame, ranks: str = "ranks") -> DataFrame:
    """(path, parent, name, level, f, line, daughters): sums at each lineage prefix below Root (level 0); line has the paths from Root on.

    freqs: (ranks: array of names, f). Paths join names by `__`. daughters counts a node's children, unknown ones too.
    """
    prefixes = F.transform(F.sequence(F.lit(0), F.size(ranks)), lambda i: F.concat(F.array(F.lit("Root")), F.slice(F.col(ranks), F.lit(1), i)))
    rows = freqs.select(F.explode(prefixes).alias("p"), "f").groupBy("p").agg(F.sum("f").alias("f"))
    rows = rows.select(F.array_join("p", "__").alias("path"), F.when(F.size("p") > 1, F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "__")).alias("parent"), F.element_at("p", -1).alias("name"), (F.size("p") - 1).alias("level"), "f", F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", F.lit(1), i), "__")).alias("line"))
    kids = rows.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("daughters")).withColumnRenamed("parent", "path")
    return rows.join(kids, "path", "left").withColumn("daughters", F.coalesce("daughters", F.lit(0)))


def visible(rolled: DataFrame) -> DataFrame:
    """Nodes that are shown: unknown ones and all below them are hidden."""
    return rolled.where(~F.col("path").rlike("(^|__)unknown_"))


def rank_ids(rolled: DataFrame) -> DataFrame:
    """visible nodes with rank_id, such as 0.2.1: the place of each ancestor among its sisters, by name, as a path of numbers."""
    nodes = visible(rolled).withColumn("place", F.when(F.col("level") == 0, 0).otherwise(F.row_number().over(Window.partitionBy("parent").orderBy("name"))))
    up = nodes.select("path", F.posexplode("line").alias("i", "at")).join(nodes.select(F.col("path").alias("at"), "place"), "at")
    ids = up.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "place"))), lambda x: x["place"].cast("string")), ".").alias("rank_id"))
    return nodes.drop("place", "line").join(ids, "path")


def rolled_counts(freqs: DataFrame, labels: DataFrame, mapped: float, delimiter: str = ";", prefixed: bool = False) -> DataFrame:
    """(level, rank_id, name, daughters, expected_count) of taxon frequencies. freqs: (key, f); labels: (key, label)."""
    ranked = freqs.join(labels, "key").select(lineage("label", delimiter, prefixed).alias("ranks"), "f")
    return rank_ids(rollup(ranked)).select("level", "rank_id", "name", "daughters", (F.col("f") * F.lit(mapped)).alias("expected_count"))
