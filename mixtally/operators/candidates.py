"""Candidate references of reads by set algebra on equivalence classes.

Strict: references in every class that a read hits. Counting classes for each reference and comparing with the read's number of
classes is the same as intersecting the sets, needs one group-by, and combines before its shuffle. Lenient, for reads
without a strict candidate: the references in most classes, if in more than one; a read with a single class takes its members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixtally.operators.settle import small

#: Lenient mates without a common reference keep both lists if these have fewer references together.
DISJOINT_LIMIT = 500


def votes(matched: DataFrame, ecs: DataFrame, key: str = "read_id", *also: str) -> DataFrame:
    """(key, ref_id, n_ec, total_ec, most): classes of a read that hold the reference, all it hits, and the most of any reference.

    also: further columns of the key, as `mate`. A class has one more member, null, which so counts a read's classes; nothing is joined by key.
    """
    n = ecs.agg(F.coalesce(F.sum(F.size("members") + 1), F.lit(0))).first()[0]
    members = F.concat("members", F.array(F.lit(None).cast(ecs.schema["members"].dataType.elementType)))
    each = matched.select(key, *also, "ec_id").join(small(ecs.select("ec_id", members.alias("members")), n), "ec_id").select(key, *also, F.explode("members").alias("ref_id"))
    each = each.groupBy(key, *also, "ref_id").agg(F.count("*").alias("n_ec"))
    of = Window.partitionBy(key, *also)
    rows = each.withColumn("total_ec", F.max(F.when(F.col("ref_id").isNull(), F.col("n_ec"))).over(of)).withColumn("most", F.max(F.when(F.col("ref_id").isNotNull(), F.col("n_ec"))).over(of))
    return rows.where("ref_id IS NOT NULL").select(key, *also, "ref_id", "n_ec", "total_ec", "most")


def strict(voted: DataFrame, key: str = "read_id") -> DataFrame:
    """(key, ref_id) of references in all classes of a read."""
    return voted.where("n_ec = total_ec").select(key, "ref_id")


def lenient(voted: DataFrame, key: str = "read_id") -> DataFrame:
    """(key, ref_id) of the references in most classes of a read, ties too; of a read of several classes only if that is more than one."""
    return voted.where("n_ec = most AND (total_ec = 1 OR most > 1)").select(key, "ref_id")


def candidates(voted: DataFrame, allow_lenient: bool = True, key: str = "read_id") -> DataFrame:
    """(key, ref_id, mode): strict candidates, and lenient ones of reads that have none."""
    best = (F.col("most") == F.col("total_ec")).alias("has_strict")
    rows = voted.withColumn("has_strict", best)
    mode = F.when(F.col("has_strict"), F.lit("strict")).otherwise(F.lit("lenient"))
    keep = F.when(F.col("has_strict"), F.col("n_ec") == F.col("total_ec"))
    keep = keep.otherwise((F.col("n_ec") == F.col("most")) & ((F.col("total_ec") == 1) | (F.col("most") > 1)) if allow_lenient else F.lit(False))
    return rows.where(keep).select(key, "ref_id", mode.alias("mode"))


def _lists(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    def gathered(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.array_sort(F.collect_set("ref_id")).alias(name))

    empty = F.array().cast(dict(gathered(one, "x").dtypes)["x"])
    return gathered(one, "c1").join(gathered(two, "c2"), key, "full_outer").select(key, F.coalesce("c1", empty).alias("c1"), F.coalesce("c2", empty).alias("c2"))


def _strict_pair():
    """Of columns c1, c2, h1, h2: what `mates_strict` gives."""
    both = (F.size("c1") > 0) & (F.size("c2") > 0)
    return F.when(both, F.array_intersect("c1", "c2")).when((F.size("c1") == 0) & F.col("h1").isNull(), F.col("c2")).when((F.size("c2") == 0) & F.col("h2").isNull(), F.col("c1"))


def _lenient_pair(limit: int):
    """Of columns c1, c2: what `mates_lenient` gives."""
    common = F.array_intersect("c1", "c2")
    return F.when(F.size("c1") == 0, F.col("c2")).when(F.size("c2") == 0, F.col("c1")).when(F.size(common) > 0, common).when(F.size("c1") + F.size("c2") < limit, F.array_union("c1", "c2"))


def mates_strict(one: DataFrame, two: DataFrame, hit_one: DataFrame, hit_two: DataFrame, key: str = "read_id") -> DataFrame:
    """(key, ref_id) of pairs: the references that both mates have; those of one mate if no k-mer of the other hit at all.

    one, two: strict candidates of the mates; hit_one, hit_two: keys of mates of which some k-mer hit. A mate that hit and yet has
    no candidate fails the pair.
    """
    rows = _lists(one, two, key)
    rows = rows.join(hit_one.select(key).distinct().withColumn("h1", F.lit(True)), key, "left").join(hit_two.select(key).distinct().withColumn("h2", F.lit(True)), key, "left")
    return rows.select(key, F.explode(_strict_pair()).alias("ref_id"))


def mates_lenient(one: DataFrame, two: DataFrame, limit: int = DISJOINT_LIMIT, key: str = "read_id") -> DataFrame:
    """(key, ref_id) of pairs: common references; one mate's if the other has none; both lists if disjoint and fewer than `limit` together."""
    return _lists(one, two, key).select(key, F.explode(_lenient_pair(limit)).alias("ref_id"))


def mate_sets(voted: DataFrame, loose: bool = False, key: str = "read_id") -> DataFrame:
    """(key, c1, c2, h1, h2): strict (loose: lenient) candidates of both mates, and whether they hit, from votes by key and `mate` (1 or 2).

    One group-by of rows that lie together by key already, so mates are read, looked up and exchanged once for both rules.
    """
    kept = (F.col("n_ec") == F.col("most")) & ((F.col("total_ec") == 1) | (F.col("most") > 1)) if loose else F.col("n_ec") == F.col("total_ec")
    sets = [F.array_sort(F.collect_set(F.when(kept & (F.col("mate") == i), F.col("ref_id")))).alias(f"c{i}") for i in (1, 2)]
    return voted.groupBy(key).agg(*sets, *(F.max(F.when(F.col("mate") == i, True)).alias(f"h{i}") for i in (1, 2)))


def pair_candidates(sets: DataFrame, rules: tuple[str, ...], limit: int = DISJOINT_LIMIT, key: str = "read_id") -> DataFrame:
    """(key, ref_id, rule) of `mate_sets` by each of the rules, strict or lenient, as `mates_strict` and `mates_lenient` have them."""
    by = {"strict": _strict_pair, "lenient": lambda: _lenient_pair(limit)}
    each = F.array(*(F.struct(F.lit(r).alias("rule"), by[r]().alias("refs")) for r in rules))
    return sets.select(key, F.inline(each)).select(key, F.explode("refs").alias("ref_id"), "rule")


def unmapped(reads: DataFrame, found: DataFrame, key: str = "read_id") -> DataFrame:
    """Reads without a candidate."""
    return reads.join(found.select(key).distinct(), key, "left_anti")


def unmapped_tiles(counts: DataFrame, found: DataFrame, key: str, stride: int) -> DataFrame:
    """(key, n_unmapped) of texts with tiles without a candidate. counts: (key, n) of each text; found: (key, at) of tiles that have one.

    Only tiles that have one are met by key: all others are a number. Of several texts of one key, a place found counts for each.
    """
    good = found.distinct().groupBy(key).agg(F.collect_list(F.expr(f"at div {stride}")).alias("good"))
    left = F.col("n") - F.coalesce(F.size(F.filter("good", lambda i: i < F.col("n"))), F.lit(0))
    rows = counts.where("n > 0").join(good, key, "left").withColumn("good", F.coalesce("good", F.array().cast("array<bigint>")))
    return rows.groupBy(key).agg(F.sum(left).alias("n_unmapped")).where("n_unmapped > 0")


def is_subset(a: str, b: str):
    """Whether all members of array a are in array b."""
    return F.size(F.array_except(a, b)) == 0


def subsets(ecs: DataFrame) -> DataFrame:
    """(one, two): every pair of different classes (ec_id, members) of which the first's members are all in the second.

    A class asks only those that hold the rarest of its members, so a reference that all classes have pairs none of them.
    """
    each = ecs.select("ec_id", "members", F.explode("members").alias("m"))
    often = each.groupBy("m").agg(F.count("*").alias("n"))
    rare = each.join(often, "m").groupBy("ec_id").agg(F.min_by("m", F.struct("n", "m")).alias("m"), F.first("members").alias("one"))
    holds = each.select("m", F.col("ec_id").alias("other"), F.col("members").alias("two"))
    return rare.join(holds, "m").where((F.col("ec_id") != F.col("other")) & is_subset(F.col("one"), F.col("two"))).select("one", "two")
