"""Substring deduplication by sliding spans of sentences.

From every sentence of a document a span runs over the following ones until it has `sentences` sentences and `words`
words, and up to every sentence one over those before it; a sentence of `alone` words is a span by itself. Equal spans,
anywhere in the corpus, are repeats of the first one by (doc_id, position); the sentences that a repeat covers are
removed: those of every repeated run of so many whole sentences and words, also between sentences that differ.

What a task reads is compared inside the task first: of each span only its first occurrence there goes on, and the
others are repeats already. So a span shared by a third of all documents sends one row per task to the shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_texts, documents, mix64

SENTENCES = 2
#: A low floor, for abbreviations and decimals are cut into sentences of a word.
WORDS = 6
ALONE = 8
FLUSH_BYTES = 32 << 20
#: Pieces that make up a text: up to a run of closing marks, up to a line's end, line feeds.
_PIECES = re.compile(rb"[^.!?\n]*[.!?]+|[^.!?\n]+|\n+")


def pieces_of(text: bytes) -> tuple[list[bytes], list[int], list[bytes]]:
    """The pieces of a text, the numbers of those that are sentences (have a word), and these without outer white space."""
    pieces = _PIECES.findall(text)
    stripped = [p.strip(b" \t\n\x0b\x0c\r") for p in pieces]
    numbers = [i for i, s in enumerate(stripped) if s]
    return pieces, numbers, [stripped[i] for i in numbers]


def spans_of(found: list[bytes], sentences: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each sentence that starts a span: two independent 64-bit hashes of the span, and its length in sentences."""
    n = len(found)
    upto = _upto(found)
    # the first end with enough words, and with enough sentences
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + words), np.arange(n) + sentences)
    starts = np.flatnonzero(ends <= n)
    lengths = ends[starts] - starts
    return *_hashes(found, starts, lengths), lengths


def runs_of(found: list[bytes], sentences: int, words: int, alone: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, the start and the length of the shortest span from every sentence on, of that up to every sentence,
    and of every sentence of at least `alone` words.

    A sentence of a longer run from which no span fits into the run lies in the span up to the run's end.
    """
    n = len(found)
    upto = _upto(found)
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + words), np.arange(n) + sentences)
    heads = np.minimum(np.searchsorted(upto, upto[1:] - words, side="right") - 1, np.arange(1, n + 1) - sentences)
    onward, back, single = np.flatnonzero(ends <= n), np.flatnonzero(heads >= 0), np.flatnonzero(np.diff(upto) >= alone)
    pairs = np.concatenate([onward * (n + 1) + ends[onward], heads[back] * (n + 1) + back + 1, single * (n + 1) + single + 1])
    starts, ends = np.divmod(np.unique(pairs), n + 1)
    return *_hashes(found, starts, ends - starts), starts, ends - starts


def _upto(found: list[bytes]) -> np.ndarray:
    """The words before each sentence, and all."""
    return np.concatenate([[0], np.cumsum(np.fromiter((len(s.split()) for s in found), np.int64, len(found)))])


def _hashes(found: list[bytes], starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(found)
    hashes = []
    # every sentence is hashed with two seeds: what one confuses the other tells apart
    for power, seed in ((0x9E3779B97F4A7C15, 0), (0xC2B2AE3D27D4EB4F, 0x5EED)):
        marks = mix64(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in found), np.uint64, n))
        # prefix sums of mark * power ** position; a span's sum is shifted to position 0 by the inverse power
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, power, np.uint64)]))
        inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(power, -1, 1 << 64), np.uint64)]))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marks * powers[:n])])
        hashes.append(mix64((prefix[starts + lengths] - prefix[starts]) * inverses[starts] + lengths.astype(np.uint64)))
    return hashes[0], hashes[1]


def span_rows(sentences: int, words: int, alone: int, flush_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, text -> span, check (both null for a repeat that is known already), doc_id, start, length."""

    def flushed(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        span, check, doc, start, length = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((start, doc, check, span))
        span, check, doc, start, length = span[order], check[order], doc[order], start[order], length[order]
        same = (span[1:] == span[:-1]) & (check[1:] == check[:-1])
        head = np.concatenate([[True], ~same])
        leader = np.flatnonzero(head)[np.cumsum(head) - 1]
        first = (doc == doc[leader]) & (start == start[leader])  # rows that repeat a document repeat its positions too
        known = ~first
        keep = head | known
        for at in range(0, len(span), 200_000):
            s = slice(at, at + 200_000)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c[s].astype(np.int64)[keep[s]], mask=known[s][keep[s]]) for c in (span, check)), *(pa.array(c[s][keep[s]]) for c in (doc, start.astype(np.int32), length.astype(np.int32)))],
                names=["span", "check", "doc_id", "start", "length"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch_texts(batch.column("text")), strict=True):
                span, check, starts, lengths = runs_of(pieces_of(text)[2], sentences, words, alone)
                size += len(text)
                if len(span):
                    parts.append((span, check, np.full(len(span), doc_id, np.int64), starts, lengths))
                if size >= flush_bytes and parts:
                    yield from flushed(parts)
                    parts, size = [], 0
        if parts:
            yield from flushed(parts)

    return run


def cleaned_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, repeats (start, length) -> doc_id, kept_text, n_sentences, n_removed, n_bytes_removed."""
    for batch in batches:
        rows, size = [], 0
        repeats = batch.column("repeats").to_pylist()
        for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), batch_texts(batch.column("text")), repeats, strict=True):
            pieces, numbers, _ = pieces_of(text)
            gone = np.zeros(len(numbers) + 1, np.int64)
            for r in found or ():
                gone[r["start"]] += 1
                gone[r["start"] + r["length"]] -= 1
            drop = {numbers[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] > 0)}
            kept = b"".join([p for i, p in enumerate(pieces) if i not in drop]) if drop else text
            rows.append((doc_id, kept, len(numbers), len(drop), len(text) - len(kept)))
            size += len(kept)
            if size >= 8 << 20:
                yield _cleaned(rows)
                rows, size = [], 0
        if rows:
            yield _cleaned(rows)


def _cleaned(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d, e = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.binary()).cast(pa.string()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.int64())],
        names=["doc_id", "kept_text", "n_sentences", "n_removed", "n_bytes_removed"],
    )


def repeated_spans(docs: DataFrame, *, sentences: int = SENTENCES, words: int = WORDS, alone: int = ALONE, flush_bytes: int = FLUSH_BYTES) -> DataFrame:
    """doc_id, start, length (in sentences) of every span that is not the first of its kind."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    spans = texts.mapInArrow(span_rows(sentences, words, alone, flush_bytes), "span long, check long, doc_id long, start int, length int")
    # rows without a span are repeats already; they are dealt out by document, not to one task
    group = F.coalesce(F.col("span"), F.xxhash64("doc_id", "start"))
    nth = F.rank().over(Window.partitionBy(group, "check").orderBy("doc_id", "start"))
    return spans.withColumn("nth", nth).where("span is null or nth > 1").select("doc_id", "start", "length")


def remove_repeated_spans(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, kept_text, n_sentences, n_removed, n_bytes_removed.

    docs needs doc_id and text; other columns are ignored. A null text counts as empty. Spans inside one document count
    as any others. Rows that repeat a doc_id are read as one document when repeats are looked for. A row without a
    doc_id keeps its text and makes no other text a repeat. An empty table gives an empty result.
    """
    repeats = repeated_spans(docs, **options).groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("repeats"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(repeats.hint("merge"), "doc_id", "left").select("doc_id", "text", "repeats")
    return joined.mapInArrow(cleaned_rows, "doc_id long, kept_text string, n_sentences long, n_removed long, n_bytes_removed long")


def sha256_hex(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_spans(documents(spark, sf_dir))
    return out.select("doc_id", "n_sentences", "n_removed", "n_bytes_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH pieces AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?]+|[^.!?\n]+|\n+')) AS piece,
         generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?]+|[^.!?\n]+|\n+'), 1) AS number
  FROM documents
), stripped AS (
  SELECT *, regexp_replace(piece, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body FROM pieces
), sentences AS (
  SELECT doc_id, number, body, row_number() OVER (PARTITION BY doc_id ORDER BY number) - 1 AS s,
         sum(len(regexp_extract_all(body, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY number) AS upto,
         len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS words
  FROM stripped WHERE body <> ''
), onward AS (  -- up to the first sentence with which 6 words and 2 sentences are reached
  SELECT a.doc_id, a.s, greatest(b.s + 1, a.s + 2) AS e
  FROM sentences a ASOF JOIN sentences b ON a.doc_id = b.doc_id AND b.upto >= a.upto - a.words + 6
), back AS (  -- from the last sentence from which they are reached
  SELECT a.doc_id, least(b.s, a.s - 1) AS s, a.s + 1 AS e
  FROM sentences a ASOF JOIN sentences b ON a.doc_id = b.doc_id AND b.upto - b.words <= a.upto - 6
  WHERE a.s >= 1
), ends AS (
  SELECT * FROM onward UNION SELECT * FROM back UNION SELECT doc_id, s, s + 1 FROM sentences WHERE words >= 8
), spans AS (
  SELECT e.doc_id, e.s, e.e, string_agg(x.body, chr(1) ORDER BY x.s) AS body
  FROM ends e JOIN sentences x ON x.doc_id = e.doc_id AND x.s >= e.s AND x.s < e.e
  GROUP BY e.doc_id, e.s, e.e HAVING count(*) = e.e - e.s
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS nth FROM spans
), gone AS (
  SELECT DISTINCT x.doc_id, x.number FROM ranked r JOIN sentences x ON x.doc_id = r.doc_id AND x.s >= r.s AND x.s < r.e WHERE nth > 1
), kept AS (
  SELECT p.doc_id, sum(CASE WHEN p.body <> '' THEN 1 ELSE 0 END) AS n_sentences, count(g.number) AS n_removed,
         coalesce(sum(CASE WHEN g.number IS NOT NULL THEN octet_length(encode(p.piece)) END), 0) AS n_bytes_removed,
         coalesce(string_agg(CASE WHEN g.number IS NULL THEN p.piece END, '' ORDER BY p.number), '') AS kept_text
  FROM stripped p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.number = p.number GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_sentences, 0) AS BIGINT) AS n_sentences, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_bytes_removed, 0) AS BIGINT) AS n_bytes_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
