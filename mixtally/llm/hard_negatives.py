"""Hard-negative mining by inner products, with bounds from an orthogonal PCA rotation.

Vectors become integers, floor(256 * x). An anchor's positives are its highest-scoring other rows of the same label; its negatives,
for each positive, are the highest-scoring rows of another label whose scores lie between LOW and HIGH per cent of the positive's.

The second moments of all vectors give an orthogonal rotation whose leading components carry most of each product. A task holds a
block of anchors and streams vectors past it. It multiplies the leading components of all pairs, bounds what is left of each by the
product of the residual norms plus a slack for rounding, and drops the pairs that can't reach the anchor's worst kept score, or can't
come down to its bands. For the others, the next components are added, and so on; what survives is verified by integer products, which
alone decide. The rotation so only decides how much is computed, never what is found.

Vectors are packed by the thousand and written once. Each block of at most some BLOCK anchors meets all vectors, dealt to as many tasks
as keep the cluster busy; tasks send their best few rows for each anchor. Labels that a third of all rows share cost nothing beyond
their rows, as work is split by anchors and vectors and not by labels.

Rows with a null vec_id, label or vector, or with any null or non-finite component, take no part. Rows that repeat a vec_id count
once, as the least by label, then vector. Vectors may differ in length: the missing components are 0. Scores must fit: a component
beyond +-MOST / 256 fails the query. Anchors without positives, and positives without negatives, have no rows. An empty table gives
none. Other columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import checkpointed, pack, release, small_batches, unpack
from .textops import ranges, segments

#: Rows whose id is divisible by this are anchors; positives for each, negatives for each of these.
ANCHORS, POSITIVES, NEGATIVES = 50, 5, 3
#: Band of a negative's score, in per cent of the positive's.
LOW, HIGH = 50, 95
#: What components are multiplied by, and the greatest magnitude of the product.
SCALE, MOST = 256, 1 << 22
#: Anchors of a block, vectors of a packed row, and steps in which components are added.
BLOCK, PACKED, STEPS = 8192, 4096, 4
#: Vectors, and anchors, whose products are computed at a time, and components gathered at a time.
TILE, GATHERED = 512, 1 << 22


def prepared(vectors: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """(vec_id, label, v): rows that take part, once for each vec_id, as integers."""
    whole = lambda c: F.floor(F.lit(float(SCALE)) * c)
    beyond = F.raise_error(F.lit(f"a component is beyond +-{MOST // SCALE}")).cast("long")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    rows = rows.select("vec_id", "label", F.transform("x", lambda c: F.when(F.abs(whole(c)) <= MOST, whole(c)).otherwise(beyond).cast("int")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")


def matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Lists of integers as rows of a matrix, with zeros behind short ones."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(size.max(initial=0)) if width is None else width
    out = np.zeros((len(size), width), np.int32)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(size)), size), ranges(np.zeros(len(size), np.int64), size)] = values
    return out


def packed_vectors(rows: DataFrame) -> DataFrame:
    """(chunk, width, blob): vectors by the thousand, checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = 0, max(1, batch.column("v").flatten().__len__() // max(1, batch.num_rows))
            step = max(1, min(PACKED, GATHERED // values))
            while at < batch.num_rows:
                part = batch.slice(at, step)
                x = matrix(part.column("v"))
                small = x.astype(np.int16) if np.abs(x).max(initial=0) < 1 << 15 else x
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                blob = pack(ids, part.column("label").to_numpy(zero_copy_only=False), small.ravel())
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([int(ids[0])], pa.int64()), "width": pa.array([x.shape[1]], pa.int32()), "blob": pa.array([blob], pa.binary())})
                at += step

    return checkpointed(rows.mapInArrow(run, "chunk long, width int, blob binary"))


def opened(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and integer vectors of a packed row, as wide as asked for."""
    ids, labels, flat = unpack(blob)
    x = flat.reshape(len(ids), -1) if len(ids) else flat.reshape(0, 0)
    return ids, labels, np.pad(x, ((0, 0), (0, width - x.shape[1]))).astype(np.int64)


def rotation(packed: DataFrame, width: int) -> np.ndarray:
    """An orthogonal matrix whose columns are the principal directions of all vectors, strongest first.

    Second moments are sums, width * (width + 1) / 2 of them for each task, added up by Spark; only the sums reach the driver.
    """
    low, high = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for blob in batch.column("blob"):
                x = opened(blob.as_py(), width)[2].astype(np.float64)
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(low)), pa.int64()), "moment": pa.array(total[low, high], pa.float64())})

    sums = packed.select("blob").mapInArrow(run, "place long, moment double").groupBy("place").agg(F.sum("moment").alias("moment")).collect()
    moments = np.zeros((width, width))
    for r in sums:
        moments[low[r.place], high[r.place]] = moments[high[r.place], low[r.place]] = r.moment
    return np.linalg.eigh(moments)[1][:, ::-1].copy()


class Side:
    """Rotated vectors, with the norms of what is left behind each step's components."""

    def __init__(self, x: np.ndarray, turn: np.ndarray, cuts: list[int]):
        self.x = x
        self.y = x.astype(np.float64) @ turn
        self.norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        # Rotating rounds each component by a little of the norm; residual norms are raised by as much.
        error = 4e-15 * (x.shape[1] + 1) ** 1.5 * self.norm
        self.left = {c: np.sqrt((self.y[:, c:] ** 2).sum(axis=1)) + error for c in cuts}


class Targets:
    """What a block of anchors looks for: one target or several for each anchor, each with a band of scores and its best rows so far."""

    def __init__(self, anchors: int, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.of, self.low, self.high, self.k = of, low, high, k
        self.count = np.bincount(of, minlength=anchors)
        self.start = np.cumsum(self.count) - self.count
        self.target = self.row = self.score = np.zeros(0, np.int64)
        self.worst = low.copy()
        self._bounds()

    def _bounds(self) -> None:
        """Scores below `need` or above `cap` can't matter to an anchor."""
        none = np.iinfo(np.int64).max
        self.need = np.full(len(self.count), none)
        np.minimum.at(self.need, self.of, self.worst)
        self.cap = np.full(len(self.count), -none)
        np.maximum.at(self.cap, self.of, self.high)

    def add(self, anchor: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        """Verified scores of pairs; each target keeps its k best, ties by the smaller id."""
        if not len(anchor):
            return
        size = self.count[anchor]
        target = ranges(self.start[anchor], size)
        row, score = np.repeat(row, size), np.repeat(score, size)
        fit = (score >= self.worst[target]) & (score <= self.high[target])
        if not fit.any():
            return
        target, row, score = target[fit], row[fit], score[fit]
        touched = np.zeros(len(self.worst), bool)
        touched[target] = True
        again = touched[self.target]
        rest = [old[~again] for old in (self.target, self.row, self.score)]
        target, row, score = (np.concatenate([old[again], new]) for old, new in ((self.target, target), (self.row, row), (self.score, score)))
        order = np.lexsort((row, -score, target))
        target, row, score = target[order], row[order], score[order]
        begin = segments(target)
        size = np.diff(np.append(begin, len(target)))
        keep = np.arange(len(target)) - np.repeat(begin, size) < self.k
        full = begin[size >= self.k]
        self.worst[target[full]] = np.maximum(self.worst[target[full]], score[full + self.k - 1])
        self.target, self.row, self.score = (np.concatenate([old, new[keep]]) for old, new in zip(rest, (target, row, score)))
        self._bounds()


def compare(targets: Targets, anchors: Side, anchor_ids: np.ndarray, anchor_labels: np.ndarray, rows: Side, ids: np.ndarray, labels: np.ndarray, same: bool, cuts: list[int]) -> int:
    """Gives the targets all pairs that matter; returns how many were verified by integer products."""
    verified = 0
    width = rows.x.shape[1]
    for a in range(0, len(anchor_ids), TILE):
        aa = slice(a, a + TILE)
        for b in range(0, len(ids), TILE):
            bb = slice(b, b + TILE)
            able = (labels[bb][:, None] == anchor_labels[aa][None, :]) == same
            if same:
                able &= ids[bb][:, None] != anchor_ids[aa][None, :]
            cut = cuts[0]
            sums = rows.y[bb, :cut] @ anchors.y[aa, :cut].T
            slack = 8e-15 * (width + 1) ** 2 * rows.norm[bb].max(initial=0) * anchors.norm[aa].max(initial=0)
            rest = np.outer(rows.left[cut][bb], anchors.left[cut][aa]) + slack
            need, cap = targets.need[aa].astype(np.float64), targets.cap[aa].astype(np.float64)
            i, j = np.nonzero(able & (sums + rest >= need) & (sums - rest <= cap))
            part = sums[i, j]
            i, j = i + b, j + a
            for last, cut in zip(cuts, cuts[1:]):
                step = max(1, GATHERED // max(1, cut - last))
                for s in range(0, len(i), step):
                    part[s : s + step] += np.einsum("ij,ij->i", rows.y[i[s : s + step], last:cut], anchors.y[j[s : s + step], last:cut])
                rest = rows.left[cut][i] * anchors.left[cut][j] + slack
                stay = (part + rest >= targets.need[j]) & (part - rest <= targets.cap[j])
                i, j, part = i[stay], j[stay], part[stay]
            score = np.zeros(len(i), np.int64)
            step = max(1, GATHERED // max(1, width))
            for s in range(0, len(i), step):
                score[s : s + step] = np.einsum("ij,ij->i", rows.x[i[s : s + step]], anchors.x[j[s : s + step]])
            verified += len(i)
            targets.add(j, ids[i], score)
    return verified


FOUND = "anchor_id long, positive_id long, positive_score long, other_id long, score long"


def search(packed: DataFrame, anchors: DataFrame, n_anchors: int, turn: np.ndarray, k: int, same: bool) -> DataFrame:
    """FOUND: for each target of the anchors (vec_id, label, v, targets), the k best rows of each task that streams vectors.

    Targets are structs (positive_id, positive_score); positives are looked for (same) without any: one target for each anchor.
    """
    spark = packed.sparkSession
    width = len(turn)
    cuts = sorted({max(1, width * s // STEPS) for s in range(1, STEPS)}) or [width]
    blocks = max(1, -(-n_anchors // BLOCK))
    splits = max(1, -(-2 * spark.sparkContext.defaultParallelism // blocks))

    def bundle(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id").combine_chunks()
        lists = table.column("targets").combine_chunks()
        flat = lists.flatten()
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        blob = pack(*(table.column(c).to_numpy() for c in ("vec_id", "label")), matrix(table.column("v").combine_chunks(), width).ravel(), size, *(flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("positive_id", "positive_score")))
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

    asked = anchors.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")).groupBy("block").applyInArrow(bundle, "block int, blob binary")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select("block", each(splits).alias("split"), F.lit(0).alias("kind"), "blob")
    given = packed.select(each(blocks).alias("block"), F.pmod(F.xxhash64("chunk"), F.lit(splits)).cast("int").alias("split"), F.lit(1).alias("kind"), "blob")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, place = None, None

        def done() -> pa.RecordBatch:
            targets, ids, positives, scores = state[0], state[2], state[4], state[5]
            t = targets.target
            columns = [ids[targets.of[t]], positives[t], scores[t], targets.row, targets.score]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "positive_id", "positive_score", "other_id", "score"])

        for batch in batches:
            for *now, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "split", "kind")), batch.column("blob")):
                if now != place:
                    if state is not None:
                        yield done()
                    state, place = None, now  # a block may have no anchors
                if kind == 0:
                    ids, labels, x, size, positives, scores = unpack(blob.as_py())
                    side = Side(x.reshape(len(ids), width).astype(np.int64), turn, cuts)
                    if same:
                        of, far = np.arange(len(ids)), np.full(len(ids), 1 << 62)
                        state = Targets(len(ids), of, -far, far, k), side, ids, labels, np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                    else:
                        state = Targets(len(ids), np.repeat(np.arange(len(ids)), size), -(-LOW * scores // 100), HIGH * scores // 100, k), side, ids, labels, positives, scores
                elif state is not None:
                    ids, labels, x = opened(blob.as_py(), width)
                    compare(state[0], state[1], state[2], state[3], Side(x, turn, cuts), ids, labels, same, cuts)
        if state is not None:
            yield done()
        release()

    return asked.unionByName(given).repartition(blocks * splits, "block", "split").sortWithinPartitions("block", "split", "kind").mapInArrow(scan, FOUND)


def _first(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k best of each key, with their rank."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc("other_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), as the module says."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = prepared(vectors, vec_id, vector, F.col(f"`{label}`") if isinstance(label, str) else label)
    packed = packed_vectors(rows)
    width = max(1, packed.agg(F.max("width")).first()[0] or 0)
    turn = rotation(packed, width)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob"):
                ids, labels, x = opened(blob.as_py(), width)
                own = ids % ANCHORS == 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(own.sum() + 1) * width, pa.int32()), pa.array(x[own].ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(labels[own]), lists], names=["vec_id", "label", "v"])

    anchors = packed.select("blob").mapInArrow(pick, "vec_id long, label long, v array<int>")
    n_anchors = anchors.count()
    none = F.array().cast("array<struct<positive_id:bigint,positive_score:bigint>>").alias("targets")
    positives = checkpointed(_first(search(packed, anchors.select("*", none), n_anchors, turn, POSITIVES, True), ["anchor_id"], POSITIVES))
    targets = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("targets"))
    found = search(packed, anchors.join(targets, "vec_id"), n_anchors, turn, NEGATIVES, False)
    return _first(found, ["anchor_id", "positive_id"], NEGATIVES).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings; every seventh row has the next label."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=shifted)


OP13_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3
"""
