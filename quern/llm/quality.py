"""A quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Each whole text gives a row of statistics. Labelled rows outside the held-out fold give normal equations, summed by partition and
then by row of the matrix, so that a matrix of fixed size comes to the driver however many rows are labelled. A fold kept from the
fit gives counts by bin of raw score, from which pool-adjacent-violators makes calibrated probabilities.

Defined cases: a null or empty text has zero statistics and a score like any other; without labels, or with one value only, each
score is the mean label (0.5 without labels); a row with a null id is scored and not held out; rows that repeat an id are scored
each; a label given twice counts once, the larger; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, cut, summed, table, trimming, without_ids

#: Random features; the normal equations are DIM x DIM.
DIM = 256
RIDGE = 1e-4
BINS = 1000
THRESHOLD = 0.3
STATISTICS = 22
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4

_SYMBOLS = np.array([chr(k) in "#$%&*+<=>@\\^_`~{}[]" for k in range(256)])
_LETTERS = np.array([chr(k).isascii() and chr(k).isalpha() or k >= 128 for k in range(256)])
_UPPER = np.array([65 <= k <= 90 for k in range(256)])
_DIGITS = np.array([48 <= k <= 57 for k in range(256)])
_SPACES = np.array([k == 32 or 9 <= k <= 13 for k in range(256)])


def statistics(text: bytes | None) -> list[float]:
    """Of a whole text in UTF-8, each finite."""
    text = text or b""
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    n, n_words, n_lines = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts[counts > 0] / n
    letters = max(1, int(counts[_LETTERS].sum()))
    often = Counter(words)
    most = sorted(often.values(), reverse=True)[:5] or [0]
    pairs = len(set(zip(words, words[1:], strict=False)))
    once = sum(1 for x in often.values() if x == 1)
    return [
        math.log1p(len(words)), math.log1p(len(lines)), math.log1p(len(words) / n_lines), (len(text) - int(counts[_SPACES].sum())) / n_words / 10,
        counts[_UPPER].sum() / letters, counts[_DIGITS].sum() / n, counts[_SYMBOLS].sum() / n, counts[_SPACES].sum() / n, letters / n,
        counts[ord("!")] / n_words, counts[ord("|")] / n_words, counts[ord(".")] / n_words, counts[ord(",")] / n_words, counts[ord("?")] / n_words, counts[ord(":")] / n_words,
        len(often) / n_words, once / n_words, pairs / n_words, most[0] / n_words, sum(most) / n_words, len(set(lines)) / n_lines, float(-(share * np.log(share)).sum()) if len(share) else 0.0,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.float64()))], names=["id", "x"])


class Features:
    """Standardised statistics through cosines of random projections: a Gaussian kernel of width sqrt(STATISTICS)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, dim: int = DIM, seed: int = 7):
        random = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.directions = random.normal(size=(len(mean), dim - 1)) / math.sqrt(len(mean))
        self.phases = random.uniform(0, 2 * math.pi, dim - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack((np.cos(z @ self.directions + self.phases) * math.sqrt(2 / len(self.phases)), np.ones((len(x), 1))))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _equations(features: Features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                z, y = features(_matrix(batch)), batch.column("y").to_numpy()
                part = np.hstack((z.T @ z, (z.T @ y)[:, None]))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([x.tobytes() for x in total], pa.binary())], names=["row", "values"])

    return trimming(run)


def isotonic(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing values, by pooling adjacent violators."""
    stack: list[list[float]] = []
    for w, m in zip(weights, means, strict=True):
        stack.append([w, m, 1])
        while len(stack) > 1 and stack[-2][1] >= stack[-1][1]:
            w2, m2, k2 = stack.pop()
            w1, m1, k1 = stack.pop()
            stack.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), k1 + k2])
    return np.concatenate([np.full(int(k), m) for _, m, k in stack]) if stack else np.zeros(0)


class Model:
    def __init__(self, features: Features | None, weights: np.ndarray | None, at: np.ndarray, values: np.ndarray, constant: float):
        self.features, self.weights, self.at, self.values, self.constant = features, weights, at, values, constant

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; where calibration is flat, the raw score still orders."""
        if self.features is None:
            return np.full(len(x), self.constant)
        raw = self.raw(x)
        flat = 1 / (1 + np.exp(-8 * (raw - 0.5)))
        return 0.999 * np.interp(raw, self.at, self.values) + 0.001 * flat


def _raw(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch)) if batch.num_rows else np.zeros(0)
            bins = np.clip((raw + 0.5) * (BINS / 2), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("y"), pa.array(raw)], names=["bin", "y", "raw"])

    return trimming(run)


def fit(measured: DataFrame, labels: DataFrame) -> Model:
    """measured: id, x. labels: id, y (0 or 1) of rows to learn from, with their fold: the calibration fold sets the bins."""
    known = cut(measured.join(labels, "id").select("x", F.col("y").cast("double").alias("y"), (F.col("fold") == CALIBRATION).alias("later")))
    n, mean = known.agg(F.count(F.lit(1)), F.avg("y")).first()
    if not n or mean in (0.0, 1.0):
        return Model(None, None, np.zeros(0), np.zeros(0), 0.5 if not n else float(mean))
    moments = known.agg(*[f(F.col("x")[k]) for k in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    features = Features(np.array(moments[::2]), np.maximum(np.array(moments[1::2]), 1e-6))
    rows_of = summed(known.where("not later").mapInArrow(_equations(features), "row int, values binary"), "row", "values", np.frombuffer, lambda x: x.tobytes())
    found = {r["row"]: np.frombuffer(r["values"]) for r in rows_of.toLocalIterator()}  # DIM rows
    if not found:
        return Model(None, None, np.zeros(0), np.zeros(0), float(mean))
    both = np.stack([found[k] for k in range(DIM)])
    weights = np.linalg.solve(both[:, :-1] + RIDGE * both[-1, -2] * np.eye(DIM), both[:, -1])
    model = Model(features, weights, np.zeros(0), np.zeros(0), float(mean))
    later = known.where("later") if known.where("later").limit(1).count() else known
    binned = later.mapInArrow(_raw(model), "bin int, y double, raw double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), F.avg("raw").alias("raw")).toPandas()  # BINS rows at most
    binned = binned.sort_values("bin")
    model.at, model.values = binned["raw"].to_numpy(), isotonic(binned["n"].to_numpy(float), binned["y"].to_numpy())
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.clip(model.score(_matrix(batch)), 0, 1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], names=["id", "score"])

    return trimming(run)


def fold_of(column) -> F.Column:
    return F.crc32(column.cast("string").cast("binary")) % FOLDS


def learning_labels(labels: DataFrame, value: str, id_col: str = "doc_id") -> DataFrame:
    """Labels outside the held-out fold: id, y, fold."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(value).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(value).alias("y"))
    return known.withColumn("fold", fold_of(F.col("id"))).where(F.col("fold") != HELD_OUT)


@bounded_batches
def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", value: str = "quality") -> DataFrame:
    """Returns id and score for each document."""
    measured = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_measure, "id long, x array<double>"))
    model = fit(measured, learning_labels(labels, value))
    return measured.mapInArrow(_score(model), "id long, score double").withColumnRenamed("id", id_col)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score THRESHOLD or more, with their columns; rows with a null id stay."""
    scored = quality_scores(docs, table(spark, sf_dir, "labels"))
    return without_ids(docs, scored.where(F.col("score") < THRESHOLD).select("doc_id"))
