"""Stages of the pipeline keep rows without a doc_id, and rows that share one."""

import random

import pytest

import corpus_pipeline

R = random.Random(3)


def text():
    return " ".join("".join(R.choices("abcdefghijklmnop", k=6)) for _ in range(40))


@pytest.fixture(scope="module")
def docs(spark):
    copy, near = text(), text()
    rows = [(None, text()), (None, text()), (1, text()), (1, text() + " longer than the other"), (2, copy), (None, copy), (4, near), (3, near + " x"), (5, text()), (None, None)]
    return spark.createDataFrame([(i, t, "en", "ab"[n % 2], 0) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def test_copies_go_and_all_others_stay(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    exact = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert exact.columns == docs.columns
    want = [x for n, x in enumerate(rows) if n != 5]
    assert sorted(((r["doc_id"], r["text"]) for r in exact.collect()), key=repr) == sorted(want, key=repr)
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert near.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=repr) == sorted([x for x in want if x[0] != 4], key=repr)


def test_mixture_counts_what_it_takes(spark, docs):
    from tidewright.llm.common import numbered
    from tidewright.llm.mixing import mix_sources

    out = corpus_pipeline.mix(spark, docs, "")
    assert out.columns == docs.columns
    passes = {}
    mixed = numbered(docs).join(mix_sources(numbered(docs)).select("_row_number", "passes"), "_row_number")
    for r in mixed.collect():
        passes[r["doc_id"], r["text"]] = passes.get((r["doc_id"], r["text"]), 0) + r["passes"]
    found = {}
    for r in out.collect():
        found[r["doc_id"], r["text"]] = found.get((r["doc_id"], r["text"]), 0) + 1
    assert found == {k: n for k, n in passes.items() if n} and any(k[0] is None for k in found)
