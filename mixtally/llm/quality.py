"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A text is cut into blocks, all of it. Each block is compressed with the dictionary trained on good text and with the one
trained on bad text; the difference of the sizes, divided by the block's length, says which it resembles, and is near zero
for text that any compressor shrinks to nothing. The mean, the least, the lower quartile and the median of the blocks'
differences, with the text's length, become a probability by logistic calibration.

Dictionaries and calibration are fitted on bounded samples of labelled rows (for each label SAMPLE_ROWS and SAMPLE_BYTES at
most), drawn from the table of labels by a hash of the key, one half for either, so that the calibration sees texts that the
dictionaries haven't. Texts are scored in one pass, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import release, row_groups, small_batches
from .textops import flat

#: Bytes of text compressed at once, of a dictionary, and zstandard's level.
BLOCK, DICTIONARY, LEVEL = 256, 112_640, 3
#: Bounds of each of the four samples (good and bad, for dictionaries and for the calibration).
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 16 << 20


@dataclass(frozen=True)
class Model:
    """Trained dictionaries and the calibration: probability = 1 / (1 + exp(-(bias + weights . features)))."""

    good: bytes
    bad: bytes
    bias: float
    weights: tuple[float, ...]

    def scorer(self) -> Scorer:
        return Scorer(self.good, self.bad, np.array(self.weights), self.bias)


class Scorer:
    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray | None = None, bias: float = 0.0):
        def compressor(raw: bytes) -> zstandard.ZstdCompressor:
            own = zstandard.ZstdCompressionDict(raw) if raw else None
            if own:
                own.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad = compressor(good).compress, compressor(bad).compress
        self.weights, self.bias = weights, bias

    def features(self, text: bytes) -> tuple[float, ...]:
        """Mean, least, lower quartile and median of the blocks' differences, and the logarithm of the length; zeros for no text."""
        if not text:
            return 0.0, 0.0, 0.0, 0.0, 0.0
        differ = []
        for i in range(0, len(text), BLOCK):
            block = text[i : i + BLOCK]
            differ.append((len(self.bad(block)) - len(self.good(block))) / (len(block) + 8))
        differ.sort()
        n = len(differ)
        return sum(differ) / n, differ[0], differ[n // 4], differ[n // 2], float(np.log1p(len(text)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, 5)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -500, 500)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, tuple[float, ...]]:
    """Logistic regression by Newton's method on standardised features; bias and weights for the raw ones."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] - (w[1:] * mean / scale).sum()), tuple(float(v) for v in w[1:] / scale)


def _dictionary(texts: list[bytes]) -> bytes:
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too short texts: the texts themselves are the dictionary
        return b"".join(texts)[:DICTIONARY]


def samples(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str) -> dict[tuple[int, int], list[bytes]]:
    """Texts by label (0 or 1) and half: of each, SAMPLE_ROWS labels at most, the first by a hash of the key, and of these the
    first whose whole texts, with all rows of a key, are SAMPLE_BYTES together at most."""
    known = labels.select(F.col(key), F.col(label).alias("__label"), F.xxhash64(F.col(key).cast("string")).alias("__hash"), F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(7)), F.lit(2)).cast("int").alias("__half")).distinct()
    parts = [known.where((F.col("__label") == v) & (F.col("__half") == h)).orderBy("__hash", key).limit(SAMPLE_ROWS) for v in (0, 1) for h in (0, 1)]
    few = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    # At most 4 * SAMPLE_ROWS keys are broadcast, so no text is shuffled but the sample's. Their texts' lengths bound the sample first.
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    lengths = docs.select(key, size.alias("__size")).join(F.broadcast(few), key).groupBy(key, "__label", "__half", "__hash").agg(F.sum("__size").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy("__label", "__half").orderBy("__hash", key))
    chosen = lengths.withColumn("__before", before).where((F.col("__before") <= SAMPLE_BYTES) & (F.col("__size") > 0)).drop("__before", "__size")
    rows = docs.select(key, text).join(F.broadcast(chosen), key).orderBy("__hash", key, text)
    out: dict[tuple[int, int], list[bytes]] = {(v, h): [] for v in (0, 1) for h in (0, 1)}
    for row in rows.select("__label", "__half", text).toLocalIterator():
        if row[2]:
            out[row[0], row[1]].append(row[2].encode())
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """A model from labels (key, label), 1 for good and 0 for bad, of documents (key, text). Other labels, null ones too, are left out.

    Without documents of both labels the dictionaries say nothing, and the model scores the share of the label it saw, or 0.5.
    """
    labels = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    parts = samples(docs, labels, text, key, label)
    good, bad = _dictionary(parts[1, 0]), _dictionary(parts[0, 0])
    known = Scorer(good, bad)
    texts = parts[1, 1] + parts[0, 1]
    y = np.array([1.0] * len(parts[1, 1]) + [0.0] * len(parts[0, 1]))
    if not len(y):
        return Model(good, bad, 0.0, (0.0,) * 5)
    if 0 < y.sum() < len(y):
        # The samples of both labels have one bound; the rows' shares weigh in again through the bias.
        bias, weights = calibrate(np.array([known.features(t) for t in texts]), y)
        shares = {r[label]: r["n"] for r in labels.groupBy(label).agg(F.count("*").alias("n")).collect()}
        bias += np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum()))
        return Model(good, bad, float(bias), weights)
    share = (y.sum() + 0.5) / (len(y) + 1)
    return Model(good, bad, float(np.log(share / (1 - share))), (0.0,) * 5)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with `out`, the probability that a text is good. All columns stay (one of that name is replaced).

    A null or empty text has the score that its calibrated length gives; repeated rows have equal scores; an empty table
    gives an empty result.
    """
    docs = docs.drop(out)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{out}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in row_groups(batches, text):
            data, offs = flat(batch.column(text))
            raw = data.tobytes()
            scores = scorer.scores([raw[a:b] for a, b in zip(offs[:-1], offs[1:])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])
        release()

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row's label is kept from learning: crc32 of the key as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) == 1, F.lit(False))


def fit_labels(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the documents whose labels aren't held out."""
    return fit(docs, labels.where(~held_out()))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document as labels.quality marks it, learned from labels that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
