"""Stages of the pipeline on tables whose columns have the names that the stages themselves use."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

R = random.Random(8)
NAMES = ("_passes", "_copy", "_row_number", "_in", "_key", "_spread", "_hot", "_cold", "_found", "row", "passes", "taken", "kept", "class_id", "best", "a.b")


def text():
    return " ".join("".join(R.choices("abcdefghijklmnop", k=6)) for _ in range(40))


@pytest.fixture(scope="module")
def docs(spark):
    copy, near = text(), text()
    texts = [text(), copy, copy, near, near + " x", text(), None, ""]
    df = spark.createDataFrame([(i, t, "en", "ab"[i % 2], 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in NAMES})


@pytest.mark.parametrize("stage", ["drop_exact_copies", "drop_near_copies", "mix"])
def test_own_columns_stay(spark, docs, stage):
    plain = docs.drop(*[n for n in NAMES])
    found = getattr(corpus_pipeline, stage)(spark, docs, "")
    assert found.columns == docs.columns
    rows = found.collect()
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in NAMES)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in getattr(corpus_pipeline, stage)(spark, plain, "").collect())


def test_languages_and_windows(spark, docs):
    found = corpus_pipeline.identify(spark, docs, "")
    assert found.columns == docs.columns
    assert {r["doc_id"] for r in corpus_pipeline.pack(spark, docs, "").collect()} == set(range(8))
