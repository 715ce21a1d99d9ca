"""Toxicity by multiple-instance learning: a document's sentences are scored, and noisy-or makes the document's score of them.

Labels are of documents only. A sentence's score is the logistic function of a bias and the weights of its distinct words, by parts; a document
is toxic unless all its sentences are not: 1 - prod(1 - p). The weights are fitted by the gradient of that likelihood on a bounded
sample of labelled rows (SAMPLE rows, those with the least hashes; the words of all their sentences come to the driver, no texts). All documents are then
scored, and sentences that score SENTENCE or more are located.

Defined cases: a null or empty text has no sentence and scores 0; without labels, or with one value only, weights stay at their
start and scores near 0; a row with a null id is scored and not held out; rows that repeat an id are scored each; texts of any length
are scored whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import cut, table
from quern.llm.quality import HELD_OUT, fold_of, learning_labels

#: Labelled rows that weights are fitted on, at most; those with the least hash of their id.
SAMPLE = 3_500
#: Labelled rows that a part of a word has to occur in, in the sample, to have a weight.
LEAST = 6
PARTS = (4, 5, 6)
ROUNDS = 140
#: By how much each round draws weights to 0.
SHRINK = 0.01
#: Words whose weights are remembered in a worker, about 100 bytes each.
WORDS = 500_000
THRESHOLD = 0.5
SENTENCE = 0.3

_SENTENCES = re.compile(rb"[.!?\n]+")
#: Upper case to lower case, and what is no letter to a space; bytes over 127 stay, as letters of UTF-8.
_PLAIN = bytes(k + 32 if 65 <= k <= 90 else k if 97 <= k <= 122 or k >= 128 else 32 for k in range(256))
_EDGES = re.compile(rb"[^.!?\n]+")


def sentences(text: bytes | None) -> list[list[bytes]]:
    """The words of each sentence that has some; sentences end at . ! ? or a line's end."""
    return [w for x in _SENTENCES.split(text or b"") if (w := x.translate(_PLAIN).split())]


def parts_of(word: bytes) -> list[bytes]:
    """What a word is known by: itself, and its first 4, 5 and 6 bytes, so that other forms of a stem count too."""
    return [b"=" + word, *(b"^" + word[:k] for k in PARTS if len(word) >= k)]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of labelled rows: the distinct words of each sentence, a line each."""
    for batch in batches:
        bags = []
        for text in batch.column("text").to_pylist():
            bags.append(b"\n".join(b" ".join(sorted(set(x))) for x in sentences(text)))
        yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("y"), pa.array(bags, pa.binary())], names=["rank", "y", "bag"])


class Model:
    """Weights of parts of words, and a bias. Sums for whole words are remembered, up to a bound."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words: dict[bytes, float] = {}

    def __getstate__(self) -> tuple:
        return self.weights, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def weight(self, word: bytes) -> float:
        if (found := self.words.get(word)) is None:
            if len(self.words) >= WORDS:
                self.words.clear()
            found = self.words[word] = sum(self.weights.get(x, 0.0) for x in parts_of(word))
        return found

    def sentence_scores(self, found: list[list[bytes]]) -> np.ndarray:
        z = np.array([sum(map(self.weight, set(x))) for x in found], float) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(bags: list[tuple[float, bytes]]) -> Model:
    """bags: label and sentences of each labelled row."""
    bags = [x for x in bags if x[1]]
    y = np.array([x[0] for x in bags])
    if not len(y) or y.min() == y.max():
        return Model({}, -6.0)
    number: dict[bytes, int] = {}
    word_at, per_sentence, of_doc, docs_with = [], [], [], Counter()
    for _, bag in bags:
        lines = [x.split(b" ") for x in bag.split(b"\n")]
        of_doc.append(len(lines))
        per_sentence += map(len, lines)
        for x in lines:
            word_at += [number.setdefault(w, len(number)) for w in x]
        docs_with.update({q for w in {w for x in lines for w in x} for q in parts_of(w)})
    names = sorted(q for q, k in docs_with.items() if k >= LEAST)
    part_number = {q: k for k, q in enumerate(names)}
    pairs = [(k, part_number[q]) for w, k in number.items() for q in parts_of(w) if q in part_number]
    part_of, part = np.array(pairs, np.int64).reshape(-1, 2).T
    at, sentence_of = np.array(word_at), np.repeat(np.arange(len(per_sentence)), per_sentence)
    first, doc_of = np.concatenate(([0], np.cumsum(of_doc)[:-1])), np.repeat(np.arange(len(y)), of_doc)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5

    theta = np.append(np.zeros(len(names)), -6.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        word = np.bincount(part_of, theta[part], len(number))
        z = theta[-1] + np.bincount(sentence_of, word[at], len(per_sentence))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        q = np.add.reduceat(np.logaddexp(0, z), first)  # -log of "no sentence is toxic"
        slope = np.where(y == 1, -1 / np.expm1(np.clip(q, 1e-6, 30)), 1.0) * balance / len(y)
        by_sentence = slope[doc_of] * p
        by_word = np.bincount(at, by_sentence[sentence_of], len(number))
        gradient = np.append(np.bincount(part, by_word[part_of], len(names)), by_sentence.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - SHRINK, 0)  # parts that tell nothing go to 0
    return Model({names[k]: float(theta[k]) for k in np.flatnonzero(theta[:-1])}, float(theta[-1]))


def _score(model: Model, sentence: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text").to_pylist():
                found = sentences(text)
                p = model.sentence_scores(found)
                scores.append(float(1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0)
                hits = np.flatnonzero(p >= sentence)
                if len(hits):
                    ranges = [x.span() for x in _EDGES.finditer(text) if x.group().translate(_PLAIN).split()]
                    spans.append([{"start": ranges[k][0], "end": ranges[k][1], "score": float(p[k])} for k in hits])
                else:
                    spans.append([])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["id", "score", "offending"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", value: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """Returns id, score and offending (start, end in bytes of UTF-8, score) for each document."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    known = learning_labels(labels, value, id_col).withColumn("rank", F.xxhash64("id"))
    # The sample is cut among the labels before any text is read; two longs a row.
    chosen = cut(known.orderBy("rank", "id").limit(sample).select("id", "rank", F.col("y").cast("double").alias("y")))
    bags = base.join(F.broadcast(chosen), "id").mapInArrow(_bags, "rank long, y double, bag binary")
    got = sorted((r["rank"], r["y"], bytes(r["bag"])) for r in bags.toLocalIterator())
    model = docs.sparkSession.sparkContext.broadcast(fit([x[1:] for x in got]))
    return base.mapInArrow(_scorer(model, SENTENCE), "id long, score double, offending array<struct<start int, end int, score double>>").withColumnRenamed("id", id_col)


def _scorer(model, sentence: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _score(model.value, sentence)(batches)

    return run


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
