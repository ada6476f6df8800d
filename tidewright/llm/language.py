"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies cover all documents that may be learnt from. The classifier is fitted by FTRL-proximal with
elastic-net penalties, in one task, on at most `per_language` distinct texts of each language (those with the smallest
md5, found by a threshold that follows from the language's number of rows, so only few rows are ever ranked); one in
five of them is kept out of the fit and sets the temperature that calibrates the scores. Prediction is a pass over the
documents without a shuffle; only the weights, of a size fixed by `dims` and the number of languages, travel to the
executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, id_crc
from .linear import Ftrl, pack, softmax, temperature, unpack

DIMS = 1 << 15
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1000
EPOCHS = 2
UNKNOWN = "und"


_held: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Which code points are letters; made once in a process."""
    if not len(_held):
        _held["letters"] = np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), dtype=np.uint8).astype(bool)
    return _held["letters"]


def ngram_counts(text: str, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray] | None:
    """Numbers and counts of the hashed n-grams of a text's letters, words set apart by single blanks; None without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    # a blank for each run of other characters, and one before the first and after the last letter
    after = np.concatenate([[False], letter[:-1]])
    codes = np.concatenate([[32], np.where(letter, codes, 32)[letter | after], [32] * int(letter[-1])]).astype(np.uint64)
    shift, found, h = np.uint64(64 - dims.bit_length() + 1), [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + (codes[n - 1 :] + np.uint64(1))
        if n in ORDERS:
            found.append(((h ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> shift)
    counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=dims)
    index = np.flatnonzero(counts)
    return index, counts[index]


def vector(index: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf[index]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def frequency_rows(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(dims + 1, np.int64)  # the last counts documents
        for batch in batches:
            for text in batch.column("text"):
                if found := ngram_counts(text.as_py(), dims):
                    held[found[0]] += 1
                    held[dims] += 1
        index = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int32()), pa.array(held[index], pa.int64())], names=["feature", "n"])

    return run


def feature_rows(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for draw, lang, text in zip(batch.column("draw").to_pylist(), batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if found := ngram_counts(text.as_py(), dims):
                    rows.append((draw, lang, found[0].astype("<u4").tobytes(), found[1].astype("<u4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["draw", "lang", "features", "counts"])

    return run


def fit_rows(idf: np.ndarray, epochs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            for draw, lang, features, counts in zip(*(batch.column(c).to_pylist() for c in ("draw", "lang", "features", "counts")), strict=True):
                index = np.frombuffer(features, "<u4").astype(np.int64)
                examples.append((draw, lang, index, vector(index, np.frombuffer(counts, "<u4").astype(np.float64), idf)))
        if not examples:
            return
        examples.sort(key=lambda e: e[:2])
        languages = sorted({e[1] for e in examples})
        number = {lang: i for i, lang in enumerate(languages)}
        model = Ftrl(len(idf), len(languages), alpha=2.0, beta=1.0, l1=0.02, l2=0.01)
        held_back = examples[::5] if len(examples) >= 10 else examples
        for _ in range(epochs):
            for i, (_, lang, index, x) in enumerate(examples):
                if i % 5 or len(examples) < 10:
                    model.learn(index, x, number[lang])
        weights = model.weights()
        scores = np.array([x @ weights[index] + weights[-1] for _, _, index, x in held_back])
        divisor = temperature(scores, np.array([number[e[1]] for e in held_back]))
        # what nearly all texts kept out of the fit exceed by far, and more than chance
        usual = float(np.quantile(softmax(scores / divisor).max(axis=1), 0.005))
        lowest = max(1.25 / len(languages), min(0.75 * usual, 0.7)) if len(languages) > 1 else 0.0
        packed = pack({"weights": weights, "temperature": np.array(divisor), "min_score": np.array(lowest), "languages": np.array(languages, dtype=object).astype("U")})
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["model"])

    return run


def fit_language_model(docs: DataFrame, *, dims: int = DIMS, per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> dict | None:
    """idf, weights, temperature and languages learnt from the rows of docs (text, lang) with text and lang; None without any."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    n = dict(rows.select("text").mapInArrow(frequency_rows(dims), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect())
    if not n.get(dims):
        return None
    frequency = np.array([n.get(i, 0) for i in range(dims)], dtype=np.float64)
    idf = np.log((1.0 + n[dims]) / (1.0 + frequency)) + 1.0
    # a text's md5 as a number in [0, 1): of n distinct texts some three times per_language lie below the limit
    rows = rows.withColumn("draw", F.md5(F.encode("text", "UTF-8")))
    share = F.conv(F.substring("draw", 1, 12), 16, 10).cast("double") / float(1 << 48)
    counts = rows.groupBy("lang").agg(F.greatest(F.approx_count_distinct("draw"), F.lit(1)).alias("n")).select("lang", ((3.0 * per_language + 50) / F.col("n")).alias("limit"))
    drawn = rows.join(F.broadcast(counts), "lang").where(share < F.col("limit"))  # a row for each language, as in the model
    # rows that repeat a text count once
    sample = drawn.groupBy("lang", "draw").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    features = sample.mapInArrow(feature_rows(dims), "draw string, lang string, features binary, counts binary")
    chosen = features.withColumn("nth", nth).where(F.col("nth") <= per_language).drop("nth")
    found = chosen.repartition(1).mapInArrow(fit_rows(idf, epochs), "model binary").collect()
    if not found:
        return None
    model = unpack(bytes(found[0]["model"]))
    return model | {"idf": idf}


SCHEMA = "lang_pred string, score double"


def predict(model: dict | None, text: str | None) -> tuple[str, float]:
    found = ngram_counts(text, len(model["idf"])) if model and text else None
    if not found:
        return UNKNOWN, 0.0
    index, counts = found
    weights = model["weights"]
    p = softmax((vector(index, counts, model["idf"]) @ weights[index] + weights[-1]) / float(model["temperature"]))
    best = int(np.argmax(p))
    return str(model["languages"][best]), float(p[best])


def predict_rows(model: dict | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every input column but _text, then lang_pred and score, which _text decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(model, t.as_py()) for t in batch.column("_text")]
            kept = [i for i, name in enumerate(batch.schema.names) if name != "_text"]
            arrays = [batch.column(i) for i in kept] + [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[i] for i in kept] + ["lang_pred", "score"])

    return run


def learnable(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.where(~held_out)


def held_out_of(name: str = "doc_id") -> Column:
    return F.coalesce(id_crc(name) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame, model: dict | None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    docs needs doc_id and text; other columns are ignored. A null text, and one without a letter, is `und` with score 0;
    so is every text where there was nothing to learn from. Repeated rows are predicted alike; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_of().alias("held_out"), F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(predict_rows(model), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict | None, min_score: float | None = None) -> DataFrame:
    """The rows of docs, all columns, whose language is known with a calibrated score of min_score at least.

    Without min_score the model's own holds: three quarters of what all but 1 in 200 of the texts kept out of the fit
    reach, 0.7 at most and 1.25 times chance at least. Null texts and those without a letter go; repeated rows stay or
    go alike; rows without a doc_id are judged like any other. Without a model all rows go.
    """
    if min_score is None:
        min_score = float(model["min_score"]) if model else 0.0
    kept = F.col("_score") >= min_score
    named = docs.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(docs.columns)], F.col("text").cast("string").alias("_text"))
    fields = [(f"_in{i}", f.dataType.simpleString()) for i, f in enumerate(docs.schema.fields)]
    out = named.mapInArrow(predict_rows(model), ", ".join(f"{n} {t}" for n, t in [*fields, ("lang_pred", "string"), ("score", "double")]))
    return out.withColumn("_score", F.col("score")).where(kept & (F.col("lang_pred") != UNKNOWN)).select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify_languages(docs, fit_language_model(learnable(docs, held_out_of())))
