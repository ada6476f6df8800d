"""Toxicity: FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between, hashed to `dims` numbers; a word has the
value 1, a pair the smaller value PAIR, so that words are learnt first and pairs correct them. A learning rate per
coordinate and an L1 penalty leave few weights other than zero, and only these travel to the executors. The fit runs in
one task on at most `train_rows` labelled documents (those whose id has the smallest md5; repeated ones count once);
scoring is a pass over all documents without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_crc, mix64
from .linear import Ftrl

DIMS = 1 << 20
TRAIN_ROWS = 16000
#: Value of a pair or skip pair beside a word's 1: of 0.1, 0.2, 0.3, 0.5, 0.7 and 1 that with the least log loss in three
#: folds of rows that may be learnt from.
PAIR = 0.1
EPOCHS = 3
CUT = 0.3
_WORD = re.compile(r"\w+")
_MARKS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class Featurizer:
    """Feature numbers of texts: those of the words, then those of pairs and skip pairs (repeats included)."""

    def __init__(self, dims: int, most_words: int = 500_000):
        self.shift, self.most, self.known = np.uint64(64 - dims.bit_length() + 1), most_words, {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = _WORD.findall(text.lower()) if text else []
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        pairs = np.concatenate([h[:-1] * _MARKS[1] + h[1:], h[:-2] * _MARKS[2] + h[2:]])
        return tuple((mix64(x) >> self.shift).astype(np.int64) for x in (h * _MARKS[0], pairs))


def distinct(words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers and their values; a number that words and pairs share is a word's."""
    index, first = np.unique(np.concatenate([words, pairs]), return_index=True)
    return index, np.where(first < len(words), 1.0, PAIR)


def feature_rows(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(dims)
        for batch in batches:
            found = [distinct(*features(t.as_py())) for t in batch.column("text")]
            # the sign tells a pair
            blobs = [np.where(v == 1.0, i, -i - 1).astype("<i4").tobytes() for i, v in found]
            yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("toxic"), pa.array(blobs, pa.binary())], names=["draw", "toxic", "features"])

    return run


def fit_rows(dims: int, epochs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [
            (draw, features, toxic) for b in batches for draw, toxic, features in zip(*(b.column(c).to_pylist() for c in ("draw", "toxic", "features")), strict=True)
        ]
        if not examples:
            return
        examples.sort()
        model = Ftrl(dims, 2, alpha=0.3, beta=1.0, l1=1.0, l2=0.5)
        for _ in range(epochs):
            for _, features, toxic in examples:
                signed = np.frombuffer(features, "<i4").astype(np.int64)
                model.learn(np.where(signed < 0, -signed - 1, signed), np.where(signed < 0, PAIR, 1.0), int(toxic))
        margin = model.weights()[:, 1] - model.weights()[:, 0]
        index = np.flatnonzero(margin)
        yield pa.RecordBatch.from_arrays([pa.array([index.astype("<u4").tobytes()], pa.binary()), pa.array([margin[index].astype("<f4").tobytes()], pa.binary())], names=["index", "weight"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, dims: int = DIMS, train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the weights that are not zero (number `dims` is the bias); both empty if nothing is labelled.

    labels needs doc_id and toxic; rows with a null in either teach nothing, and of several labels of a document the
    highest counts.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.withColumn("draw", F.md5(F.col("doc_id").cast("string"))).orderBy("draw", "doc_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("draw", "toxic", "text")  # train_rows rows at most
    # rows that repeat a document count once, and texts that share an id are train_rows at most together with all others
    features = sample.mapInArrow(feature_rows(dims), "draw string, toxic int, features binary").distinct().orderBy("draw", "features").limit(train_rows)
    found = features.repartition(1).mapInArrow(fit_rows(dims, epochs), "index binary, weight binary").collect()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.frombuffer(bytes(found[0]["index"]), "<u4").astype(np.int64), np.frombuffer(bytes(found[0]["weight"]), "<f4")


def score_rows(model: tuple[np.ndarray, np.ndarray], dims: int, cut: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = Featurizer(dims), np.zeros(dims + 1, np.float32)
        weights[model[0]] = model[1]
        heavy = weights != 0
        for batch in batches:
            scores = []
            for text in batch.column("text"):
                words, pairs = features(text.as_py())
                index, value = distinct(words[heavy[words]], pairs[heavy[pairs]])
                margin = float(weights[dims]) + float((weights[index] * value).sum(dtype=np.float64))
                scores.append(float(1 / (1 + np.exp(-np.clip(margin, -500, 500)))))
            predicted = [int(s >= cut) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())], names=["doc_id", "held_out", "score", "predicted"]
            )

    return run


def held_out_of(name: str = "doc_id") -> Column:
    return F.coalesce(id_crc(name) % 4 == 2, F.lit(False))


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, dims: int = DIMS, cut: float = CUT) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    docs needs doc_id and text; other columns are ignored. A null text counts as empty; an empty text gets the score of
    the bias alone (0.5 if nothing was learnt). Repeated rows are scored alike, rows without a doc_id like any other
    (held_out false), very long texts whole. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_of().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score_rows(model, dims, cut), "doc_id long, held_out boolean, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out_of())
    return score_toxicity(docs, fit_toxicity(docs, labels))
