"""A training corpus from raw documents: language, exact copies, near copies, mixture, packed windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again before the next. All stages
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.common import ROW, WHOLE, documents, materialize, unwrapped, wrapped
from tidewright.llm.exact_dedup import keep_exact
from tidewright.llm.language import fit_language_model, held_out_of, keep_identified, learnable
from tidewright.llm.minhash import keep_near
from tidewright.llm.mixing import apply_mix, mix_sources
from tidewright.llm.packing import pack_documents


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay.

    Null and empty texts, texts without a letter and those in a language that was not learnt go. Rows without a doc_id
    are judged like any other, repeated rows alike, very long texts whole. If no row has a language to learn from, all
    go. An empty table stays empty.
    """
    return keep_identified(docs, fit_language_model(learnable(docs, held_out_of())))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest as written stays, of these the smallest doc_id (null last), of repeated rows one.

    Null and empty texts, and texts of white space alone, are equal to one another. Different texts that share a doc_id
    all stay. Very long texts are compared whole. An empty table stays empty.
    """
    return keep_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the smallest doc_id (null last), of repeated rows one.

    Null and empty texts are no copies of one another. Classes are of rows, so rows may share a doc_id or have none.
    Very long texts count with all their shingles. An empty table stays empty.
    """
    return keep_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, twice at most.

    Every row has its own decision, with or without a doc_id. A null source is a source of its own. Texts without a word
    weigh nothing and are taken with their neighbours in the order. Ties in that order are broken by source and md5. An
    empty table stays empty.
    """
    rows = wrapped(docs)
    return unwrapped(apply_mix(rows, mix_sources(rows.select(f"{WHOLE}.doc_id", f"{WHOLE}.text", f"{WHOLE}.source", ROW))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows, with their token ids (little-endian unsigned 32-bit numbers).

    A null or empty text is its end token alone. Rows that repeat, or have no doc_id, are packed each for itself; a very
    long text fills many windows. An empty table gives an empty result.
    """
    return pack_documents(docs)


STAGES = [
    ("identify languages", identify),
    ("drop exact copies", drop_exact_copies),
    ("drop near copies", drop_near_copies),
    ("mix sources", mix),
    ("pack windows", pack),
]

#: SQL cannot express learning, signatures or tokenising; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{number}")
    return docs
