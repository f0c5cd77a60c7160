"""Mixture frequencies by an accelerated EM.

Likelihoods are a long table (read_id, key, loglik). Reads with one key add to that key's count whatever the frequencies are, and
leave the iteration. An evaluation of the map is one pass over the cached likelihoods with the frequencies broadcast, which
sums by key within each task (or, for many references, a join and two group-bys); a read gives each key it doesn't hit a
likelihood of e**-150, whose sum has a closed form, so that no read-by-key product is made. The likelihoods are shifted by
each read's best, or the floor if that is more, before they are exponentiated: nothing under- or overflows. Frequencies are one row for each reference and live on the driver between evaluations, of which there are up to
2500, so that no plan grows from one to the next; likelihoods stay cached on the executors.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from mixtally.operators.settle import checkpointed

#: Log-likelihood of a read at a key that it doesn't hit.
FLOOR = -150.0
#: Most keys whose frequencies, 8 bytes each in every task, are broadcast; more are joined. Least marginal likelihood, relative to a read's best.
BROADCAST_KEYS, TINY = 1_000_000, 1e-300


def collapse(lk: DataFrame, taxa: DataFrame) -> DataFrame:
    """(read_id, key, loglik) by taxon: the mean likelihood over the taxon's references, with the floor for those not hit.

    lk: (read_id, ref_id, loglik); taxa: (ref_id, label). A reference without a label is a taxon of its own.
    """
    sizes = taxa.groupBy("label").agg(F.count("*").alias("size"))
    rows = lk.join(taxa, "ref_id", "left").withColumn("key", F.coalesce("label", F.col("ref_id").cast("string")))
    # One shuffle: a taxon's few likelihoods for a read stay together. If references aren't hit, nothing lies below the floor.
    own = rows.groupBy("read_id", "key").agg(F.max("loglik").alias("best"), F.collect_list("loglik").alias("lls"))
    own = own.join(sizes.withColumnRenamed("label", "key"), "key", "left").withColumn("missed", F.coalesce("size", F.lit(1)) - F.size("lls"))
    own = own.withColumn("shift", F.when(F.col("missed") > 0, F.greatest("best", F.lit(FLOOR))).otherwise(F.col("best")))
    total = F.aggregate("lls", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("shift"))) + F.col("missed") * F.when(F.col("missed") > 0, F.exp(F.lit(FLOOR) - F.col("shift"))).otherwise(0.0)
    return own.select("read_id", "key", (F.col("shift") + F.log(total / F.coalesce("size", F.lit(1)))).alias("loglik"))


def split_single(lk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of reads with several keys, and (key, n): how many reads have that key alone."""
    n = lk.groupBy("read_id").agg(F.count("*").alias("n_cand"), F.first("key").alias("only"))
    single = n.where("n_cand = 1").groupBy(F.col("only").alias("key")).agg(F.count("*").alias("n"))
    return lk.join(n.where("n_cand > 1").select("read_id"), "read_id", "left_semi"), single


def support(lk: DataFrame) -> DataFrame:
    """The keys that some read has."""
    return lk.select("key").distinct()


def em_step(lk: DataFrame, freqs: DataFrame, singles: DataFrame) -> DataFrame:
    """(key, f) after one plain evaluation of the map, without a cutoff, as one lazy plan.

    lk: rows of reads with several keys; freqs: (key, f); singles: (key, n). Keys outside freqs count for nothing.
    """
    total = freqs.agg(F.sum("f").alias("sum_f"))
    # A read's rows, one for each key it has, stay together: one shuffle by read and one by key.
    reads = lk.join(freqs, "key").groupBy("read_id").agg(F.greatest(F.max("loglik"), F.lit(FLOOR)).alias("shift"), F.sum("f").alias("h"), F.collect_list(F.struct("key", "f", "loglik")).alias("r")).crossJoin(F.broadcast(total))
    reads = reads.withColumn("low", F.exp(F.lit(FLOOR) - F.col("shift"))).withColumn("s", F.aggregate("r", F.lit(0.0), lambda s, x: s + x["f"] * F.exp(x["loglik"] - F.col("shift"))))
    reads = reads.withColumn("m", F.greatest(F.col("s") + F.greatest(F.lit(0.0), F.col("sum_f") - F.col("h")) * F.col("low"), F.lit(TINY)))
    hits = F.transform("r", lambda x: F.struct(x["key"].alias("key"), ((F.exp(x["loglik"] - F.col("shift")) - F.col("low")) / F.col("m")).alias("v"), F.lit(0).alias("n")))
    every = F.array(F.struct(F.lit(None).cast(lk.schema["key"].dataType).alias("key"), (F.col("low") / F.col("m")).alias("v"), F.lit(1).alias("n")))
    sums = reads.select(F.explode(F.concat(hits, every)).alias("x")).groupBy("x.key").agg(F.sum("x.v").alias("v"), F.sum("x.n").alias("n"))
    every = sums.where("key IS NULL").agg(F.sum("v").alias("all_floor"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_multi"))
    hits = sums.where("key IS NOT NULL").select("key", F.col("v").alias("hit"))
    kept = freqs.join(singles, "key", "left").join(hits, "key", "left")
    priors = freqs.join(singles, "key").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_single"))
    rows = kept.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(priors))
    up = F.col("f") * (F.coalesce("hit", F.lit(0.0)) + F.coalesce("all_floor", F.lit(0.0))) + F.coalesce("n", F.lit(0))
    return rows.select("key", (up / (F.col("n_multi") + F.col("n_single"))).alias("f"))


@dataclass(frozen=True)
class Controls:
    """Of the acceleration: tolerance, most evaluations, step bounds and the factor by which they grow, and the residual allowed."""

    tolerance: float = 1e-12
    max_evaluations: int = 2500
    step_min: float = 1.0
    step_max: float = 1.0
    step_factor: float = 4.0
    residual: float = 1.0
    ramp: int = 50


@dataclass
class Result:
    """Frequencies by key, the log-likelihood of reads with several keys, evaluations, whether it converged, and mapped reads that remain."""

    freqs: dict
    loglik: float
    evaluations: int
    converged: bool
    mapped: float = 0.0
    trace: list = field(default_factory=list)

    def frame(self, spark: SparkSession, like: DataFrame) -> DataFrame:
        schema = StructType([StructField("key", like.schema["key"].dataType), StructField("f", DoubleType())])
        return spark.createDataFrame(list(self.freqs.items()), schema)


def distance2(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of squared differences of two frequency vectors; keys without a frequency have 0."""
    return float(np.square(a - b).sum())


def cut(freqs: DataFrame, least: float, strict: bool = False) -> DataFrame:
    """(key, f) of at least (or, if strict, over) the cutoff, scaled to a sum of 1."""
    kept = freqs.where(F.col("f") > least if strict else F.col("f") >= least)
    return kept.crossJoin(F.broadcast(kept.agg(F.sum("f").alias("__sum")))).select("key", (F.col("f") / F.col("__sum")).alias("f"))


def residual2(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row (r2): the sum of squared differences of two tables of frequencies over the first one's keys; a missing one is 0."""
    rows = one.join(two.select("key", F.col("f").alias("g")), "key", "left")
    return rows.agg(F.sum(F.pow(F.coalesce("g", F.lit(0.0)) - F.col("f"), F.lit(2))).alias("r2"))


def mapped_left(lk: DataFrame, freqs: DataFrame) -> DataFrame:
    """One row (mapped): reads but those whose only key has no frequency any more."""
    multi, singles = split_single(lk)
    return singles.join(freqs.select("key"), "key", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).crossJoin(multi.agg(F.count_distinct("read_id").alias("m"))).select((F.col("s") + F.col("m")).alias("mapped"))


def step_length(r2: float, v2: float, bounds: tuple[float, float]) -> float:
    """Length of an extrapolation, |r| / |v| (scheme S3 of the squared iterative methods), within its bounds."""
    return bounds[1] if v2 <= 0 else min(max(math.sqrt(r2 / v2), bounds[0]), bounds[1])


def extrapolated(p0: np.ndarray, p1: np.ndarray, p2: np.ndarray, alpha: float) -> np.ndarray:
    """The squared extrapolation p0 + 2 alpha r + alpha ** 2 v, where r = p1 - p0 and v = p2 - p1 - r."""
    r = p1 - p0
    return p0 + 2 * alpha * r + alpha**2 * (p2 - p1 - r)


class CutoffSchedule:
    """The frequency below which keys drop out: a share of the full cutoff that grows with each evaluation, or jumps to all of it."""

    def __init__(self, full: float, ramp: int):
        self.full, self.ramp, self.done = max(0.0, full), ramp, 1
        self.jumping = False

    @property
    def now(self) -> float:
        return self.full * min(1.0, self.done / self.ramp)

    @property
    def is_full(self) -> bool:
        return self.now >= self.full

    def advance(self) -> None:
        self.done = self.ramp if self.jumping else self.done + 1


class FixedPoint:
    """Evaluations of a map on frequency vectors, with the cutoff applied to each result."""

    def __init__(self, step: Callable[[dict], tuple[dict, float]], keys: list, schedule: CutoffSchedule):
        self.step, self.keys, self.schedule = step, keys, schedule
        self.count, self.trace = 0, []

    def as_dict(self, p: np.ndarray) -> dict:
        at = np.flatnonzero(p > 0)
        return {self.keys[i]: float(p[i]) for i in at}

    def normal(self, p: np.ndarray, strict: bool = False) -> np.ndarray:
        """p without what is below the cutoff, scaled to a sum of 1; zeros if nothing stays."""
        kept = np.where(p > self.schedule.now if strict else p >= self.schedule.now, np.maximum(p, 0.0), 0.0)
        total = kept.sum()
        return kept / total if total > 0 else np.zeros_like(kept)

    def __call__(self, p: np.ndarray) -> tuple[np.ndarray, bool]:
        """The map's value at p, and whether the full cutoff was applied to it."""
        found, loglik = self.step(self.as_dict(p))
        self.trace.append(loglik)
        self.count += 1
        out, full = self.normal(np.array([found.get(k, 0.0) for k in self.keys])), self.schedule.is_full
        self.schedule.advance()
        return out, full


def squarem(step: Callable[[dict], tuple[dict, float]], start: dict, min_freq: float, controls: Controls = Controls(), saved: dict | None = None, save: Callable[[dict], None] | None = None) -> Result:
    """Fixed point of `step` (frequencies -> frequencies, log-likelihood), accelerated by squared extrapolation.

    A cycle makes two evaluations, p1 and p2, extrapolates along them and, unless the extrapolation is about the second
    evaluation itself (alpha near 1), steadies it by one more; if that moves it too far, the cycle ends at p2. Whenever the length is
    held back by its upper bound, the bound grows by step_factor. An evaluation that moves nothing ends the search if it was made at
    the full cutoff; otherwise the schedule jumps there.

    After each cycle `save` gets what the next one begins with, and a search that gets it as `saved` goes on from there, as if it
    had never stopped.
    """
    schedule = CutoffSchedule(min_freq, controls.ramp)
    f = FixedPoint(step, list(start), schedule)
    p = np.array([float(v) for v in start.values()])
    bounds = (controls.step_min, controls.step_max)
    converged = False
    if saved:
        p, bounds = np.array(saved["p"]), tuple(saved["bounds"])
        f.count, f.trace, schedule.done, schedule.jumping = saved["count"], list(saved["trace"]), saved["done"], saved["jumping"]

    def still(moved: float, full: bool) -> bool:
        """Whether the search is over, as an evaluation moved so little."""
        if moved >= controls.tolerance:
            return False
        schedule.jumping = True
        return full

    while f.count < controls.max_evaluations and not converged:
        p1, full = f(p)
        r2 = distance2(p, p1)
        if still(math.sqrt(r2), full):
            p, converged = p1, True
            break
        p2, full = f(p1)
        q2 = distance2(p1, p2)
        if still(q2, full):
            p, converged = p2, True
            break
        alpha = step_length(r2, distance2(p2 - p1, p1 - p), bounds)
        ahead, held = f.normal(extrapolated(p, p1, p2, alpha), strict=True), alpha == bounds[1]
        if not ahead.any():
            ahead = p2
        if abs(alpha - 1) > 0.01:
            steadied, _ = f(ahead)
            here = p2[p2 > 0]
            allowed = controls.residual * (1 + math.sqrt(float(np.square(here).mean()) if len(here) else 0.0)) + q2
            ahead = steadied if math.sqrt(distance2(ahead, steadied)) <= allowed else p2
        if held:
            bounds = (bounds[0], bounds[1] * controls.step_factor)
        p = ahead
        if save:
            save({"p": p.tolist(), "bounds": list(bounds), "count": f.count, "trace": f.trace, "done": schedule.done, "jumping": schedule.jumping})
    freqs = f.as_dict(p)
    return Result(freqs, step(freqs)[1] if freqs else 0.0, f.count, converged, trace=f.trace)


def starting_point(keys: list, singles: dict, mapped: float) -> dict:
    """Initial frequencies of the supported keys: single reads' shares, and what remains evenly."""
    rest = max(0.0, 1 - sum(singles.values()) / mapped) if mapped else 1.0
    return {k: singles.get(k, 0) / mapped + rest / len(keys) if mapped else 1 / len(keys) for k in keys}


class Likelihoods:
    """The EM's data: likelihoods of reads with several keys, cached on the executors, and single counts."""

    def __init__(self, lk: DataFrame):
        self.spark = lk.sparkSession
        self.key_type = lk.schema["key"].dataType
        # One row for each read, made once: keys, single reads and likelihoods all come from it.
        reads = checkpointed(lk.groupBy("read_id").agg(F.collect_list(F.struct("key", "loglik")).alias("own")))
        self.keys = sorted(r["key"] for r in reads.select(F.explode("own.key").alias("key")).distinct().collect())  # a row for each reference
        self.place = {k: i for i, k in enumerate(self.keys)}
        single = reads.where(F.size("own") == 1).groupBy(F.col("own")[0]["key"].alias("key")).agg(F.count("*").alias("n"))
        self.singles = {r["key"]: r["n"] for r in single.collect()}
        multi = reads.where(F.size("own") > 1).withColumn("shift", F.greatest(F.array_max("own.loglik"), F.lit(FLOOR)))
        own = F.array_sort(F.transform("own", lambda x: F.struct(x["key"].alias("key"), (x["loglik"] - F.col("shift")).alias("d"))))
        # Reads with equal rows are one weighted row: the map depends on a read through its likelihoods only.
        packed = multi.select("shift", own.alias("rows")).groupBy("shift", "rows").agg(F.count("*").alias("w"))
        classes = packed.select("shift", F.col("w").cast("double").alias("w"), F.col("rows.key").alias("key"), F.col("rows.d").alias("d"))
        self.classes = self._numbered(classes).persist()
        self.n_multi = float(self.classes.agg(F.coalesce(F.sum("w" if len(self.keys) > BROADCAST_KEYS else "n"), F.lit(0.0))).first()[0])
        self.mapped = self.n_multi + sum(self.singles.values())

    def _numbered(self, classes: DataFrame) -> DataFrame:
        """classes (shift, w, key, d) with keys' numbers: (n, shift, w, i, d, size), a row and vectors of bytes for each batch of classes.

        For more keys than are broadcast (shift, w, i, d), a row for each class.
        """
        if len(self.keys) > BROADCAST_KEYS:
            numbers = self.spark.createDataFrame(list(self.place.items()), StructType([StructField("key", self.key_type), StructField("i", IntegerType())]))
            rows = classes.withColumn("id", F.monotonically_increasing_id()).select("id", "shift", "w", F.inline(F.arrays_zip("key", "d"))).join(numbers, "key")
            rows = rows.groupBy("id", "shift", "w").agg(F.array_sort(F.collect_list(F.struct("i", "d"))).alias("rows"))
            return rows.select("shift", "w", F.col("rows.i").alias("i"), F.col("rows.d").alias("d"))
        shared = self.spark.sparkContext.broadcast(self.keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, d, w = batch.column("key"), batch.column("d"), np.asarray(batch.column("w"), float)
                i = pa.compute.index_in(keys.flatten(), value_set=pa.array(shared.value, keys.type.value_type))
                vectors = (np.asarray(batch.column("shift"), float), w, np.asarray(i, np.int32), np.asarray(d.flatten(), float), np.asarray(d.value_lengths(), np.int32))
                yield pa.record_batch([pa.array([float(w.sum())]), *(pa.array([v.tobytes()], pa.binary()) for v in vectors)], ["n", "shift", "w", "i", "d", "size"])

        return classes.mapInArrow(run, "n double, shift binary, w binary, i binary, d binary, size binary")

    def _sums(self, f: np.ndarray) -> DataFrame:
        """(i, v): of each key the reads' gains over the floor, and at -1 and -2 the sums of floors and of log-likelihoods."""
        if len(f) > BROADCAST_KEYS:
            return self._joined_sums(f)
        shared, total = self.spark.sparkContext.broadcast(f), float(f.sum())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = shared.value
            gain, floors, ll = np.zeros(len(f)), 0.0, 0.0
            for row in (r for batch in batches for r in batch.to_pylist()):
                shift, w, d = (np.frombuffer(row[c], np.float64) for c in ("shift", "w", "d"))
                i, count = (np.frombuffer(row[c], np.int32) for c in ("i", "size"))
                e = np.exp(d)
                at = np.cumsum(count) - count
                low = np.exp(FLOOR - shift)
                m = np.maximum(np.add.reduceat(f[i] * e, at) + np.maximum(0.0, total - np.add.reduceat(f[i], at)) * low, TINY)
                gain += np.bincount(i, np.repeat(w / m, count) * (e - np.repeat(low, count)), minlength=len(f))
                floors += float((w * low / m).sum())
                ll += float((w * (shift + np.log(m))).sum())
            own = np.flatnonzero(gain)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, [-1, -2]]), pa.int32()), pa.array(np.concatenate([gain[own], [floors, ll]]), pa.float64())], names=["i", "v"])

        return self.classes.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))

    def _joined_sums(self, f: np.ndarray) -> DataFrame:
        """The same by joins, for more keys than are broadcast."""
        freqs = self.spark.createDataFrame(list(enumerate(f.tolist())), "i int, f double")
        rows = self.classes.withColumn("id", F.xxhash64("shift", "i", "d")).select("id", "shift", "w", F.explode(F.arrays_zip("i", "d")).alias("r")).select("id", "shift", "w", "r.i", "r.d").join(freqs, "i")
        low = F.exp(F.lit(FLOOR) - F.col("shift"))
        part = rows.groupBy("id", "shift", "w").agg((F.sum(F.col("f") * F.exp("d"))).alias("s"), F.sum("f").alias("h"), F.collect_list(F.struct("i", "d")).alias("hits"))
        part = part.withColumn("m", F.greatest(F.col("s") + F.greatest(F.lit(0.0), F.lit(float(f.sum())) - F.col("h")) * low, F.lit(TINY)))
        gains = F.transform("hits", lambda r: F.struct(r["i"].alias("i"), (F.col("w") * (F.exp(r["d"]) - low) / F.col("m")).alias("v")))
        sums = F.array(F.struct(F.lit(-1).alias("i"), (F.col("w") * low / F.col("m")).alias("v")), F.struct(F.lit(-2).alias("i"), (F.col("w") * (F.col("shift") + F.log("m"))).alias("v")))
        return part.select(F.explode(F.concat(gains, sums)).alias("r")).groupBy("r.i").agg(F.sum("r.v").alias("v"))

    def step(self, freqs: dict) -> tuple[dict, float]:
        """One evaluation: new frequencies of the same keys, and the log-likelihood of the old."""
        priors = sum(n for k, n in self.singles.items() if k in freqs)
        if self.n_multi == 0:
            return {k: self.singles.get(k, 0) / priors if priors else 0.0 for k in freqs}, 0.0
        f = np.zeros(len(self.keys))
        f[[self.place[k] for k in freqs]] = list(freqs.values())
        got = {r["i"]: r["v"] for r in self._sums(f).collect()}  # a row for each reference at most
        new = {k: (f0 * (got.get(self.place[k], 0.0) + got[-1]) + self.singles.get(k, 0)) / (self.n_multi + priors) for k, f0 in freqs.items()}
        return new, float(got[-2])

    def release(self) -> None:
        """Gives the cached likelihoods' room back."""
        self.classes.unpersist()

    def estimate(self, min_freq: float | None = None, controls: Controls = Controls(), folder: str | None = None) -> Result:
        """Mixture frequencies. Without min_freq the cutoff is one mapped read. `mapped` loses reads whose only key dropped out.

        With a folder, each cycle's state is committed there, and a run that finds states of the same reads, cutoff and controls
        goes on from the last; states of others are an error.
        """
        if not self.keys:
            return Result({}, 0.0, 0, True)
        least = 1 / self.mapped if min_freq is None else min_freq
        log = CycleLog(self.spark, folder, [self.mapped, len(self.keys), str(self.keys[0]), str(self.keys[-1]), least, str(controls)]) if folder else None
        out = squarem(self.step, starting_point(self.keys, self.singles, self.mapped), least, controls, log.last() if log else None, log.add if log else None)
        out.mapped = self.mapped - sum(n for k, n in self.singles.items() if k not in out.freqs)
        return out


class CycleLog:
    """States of an EM's cycles in a folder, each a file that is there whole or not at all: written aside, then renamed.

    A state is a row for each reference at most, like the frequencies themselves. The last KEPT stay.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, folder: str, about: list):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.spark, self.folder, self.about = spark, folder, about
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(folder))

    def _cycles(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.folder))]
        return sorted(int(n.removeprefix("cycle-")) for n in names if re.fullmatch("cycle-[0-9]+", n))

    def last(self) -> dict | None:
        """The last state; ValueError if it is another search's."""
        found = self._cycles()
        if not found:
            return None
        state = json.loads("".join(r.value for r in self.spark.read.option("wholetext", True).text(f"{self.folder}/cycle-{found[-1]}").collect()))
        if state.pop("about") != self.about:
            raise ValueError(f"{self.folder} has the states of other reads or options")
        return state

    def add(self, state: dict) -> None:
        """Commits a state, and drops the oldest."""
        found = self._cycles()
        name = f"{self.folder}/cycle-{found[-1] + 1 if found else 1}"
        self.spark.createDataFrame([(json.dumps(state | {"about": self.about}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{name}-unfinished")
        if not self.fs.rename(self.path(f"{name}-unfinished"), self.path(name)):
            raise OSError(f"{name} can't be written")
        for old in found[: -self.KEPT + 1]:
            self.fs.delete(self.path(f"{self.folder}/cycle-{old}"), True)


def posterior(lk: DataFrame, freqs: DataFrame, collapse_at: float = 0.9995) -> DataFrame:
    """(read_id, key, p, status) of each read's keys that survive.

    status: multi, or single for reads with one key, whose p is 1. Reads of which no key survives have one row without a key:
    even (several keys) or dropped (one). A key with p of at least collapse_at stands alone, with p 1.
    """
    joined = lk.join(freqs.select("key", "f"), "key", "left")
    # A read's rows, one for each key it has, stay together: one shuffle by read.
    known = F.col("f").isNotNull()
    reads = joined.groupBy("read_id").agg(F.count("*").alias("n_cand"), F.greatest(F.max(F.when(known, F.col("loglik"))), F.lit(FLOOR)).alias("shift"), F.coalesce(F.sum("f"), F.lit(0.0)).alias("h"), F.collect_list(F.when(known, F.struct("key", "f", "loglik"))).alias("r"))
    reads = reads.crossJoin(F.broadcast(freqs.agg(F.sum("f").alias("sum_f")))).withColumn("u", F.transform("r", lambda x: x["f"] * F.exp(x["loglik"] - F.col("shift"))))
    missed = F.greatest(F.lit(0.0), F.col("sum_f") - F.col("h")) * F.exp(F.lit(FLOOR) - F.col("shift"))
    reads = reads.withColumn("t", F.greatest(F.aggregate("u", F.lit(0.0), lambda t, x: t + x) + missed, F.lit(TINY)))
    reads = reads.withColumn("ps", F.when(F.col("n_cand") == 1, F.transform("u", lambda x: F.lit(1.0))).otherwise(F.transform("u", lambda x: x / F.col("t")))).withColumn("top", F.array_max("ps"))
    # Reads of which no key survives are rows of the same explode, so that nothing is grouped twice.
    rows = reads.select("read_id", "n_cand", "top", F.explode_outer(F.arrays_zip("r", "ps")).alias("x")).select("read_id", "n_cand", "top", "x.r.key", F.col("x.ps").alias("p"))
    rows = rows.where(F.col("key").isNull() | (F.col("top") < collapse_at) | (F.col("p") == F.col("top")))
    status = F.when(F.col("key").isNull(), F.when(F.col("n_cand") == 1, "dropped").otherwise("even")).otherwise(F.when(F.col("n_cand") == 1, "single").otherwise("multi"))
    return rows.select("read_id", "key", F.when(F.col("key").isNotNull() & (F.col("top") >= collapse_at), F.lit(1.0)).otherwise(F.col("p")).alias("p"), status.alias("status"))
