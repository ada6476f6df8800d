"""Quality rules on repetition: how much of a text lies inside n-grams and lines that it repeats.

Words get exact numbers per batch of texts; n-gram hashes roll over these numbers, for all texts of a batch at once, and
equal hashes are found by one sort per n-gram length. Neighbours in that order are compared word by word, so a hash
collision changes nothing. Texts never meet other texts: the operator is a single pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_texts, documents, mix64, runs_of_texts

SYMBOLS = b"#*$%&|<>"
#: Published limits on repetition: share of a text's word characters in its commonest 2-, 3- and 4-gram, in repeated
#: 5- to 10-grams, and in repeated lines.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
REPEATED_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.30
LINE_CHARS_LIMIT = 0.20
MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20

#: Continuation bytes do not start a code point.
_CONTINUATION = bytes(range(0x80, 0xC0))
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def points(text: bytes) -> int:
    return len(text.translate(None, _CONTINUATION))


@dataclass
class Words:
    """The words of some texts, one after the other."""

    ids: np.ndarray  # a number per distinct word
    chars: np.ndarray  # code points
    start: np.ndarray  # of each text, in words; one more at the end
    text: np.ndarray  # number of the text


def split_words(texts: list[bytes]) -> Words:
    known: dict[bytes, int] = {}
    found, start = [], [0]
    for text in texts:
        found += text.split()  # bytes.split() knows the six ASCII white-space characters only
        start.append(len(found))
    ids = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found))
    lengths = np.fromiter(map(points, known), np.int64, len(known))
    start = np.array(start)
    return Words(ids, lengths[ids] if len(ids) else np.zeros(0, np.int64), start, np.repeat(np.arange(len(texts)), np.diff(start)))


def ngram_groups(words: Words, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start words of all n-grams inside a text, ordered so that equal n-grams of a text adjoin; number of the group of each."""
    where = np.flatnonzero(np.arange(len(words.ids)) + n <= words.start[words.text + 1])
    if not len(where):
        return where, where
    keys = mix64(hashes[where] + mix64(words.text[where].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    where, keys = where[order], keys[order]
    same = keys[1:] == keys[:-1]
    at = np.flatnonzero(same)
    ok = words.text[where[at]] == words.text[where[at + 1]]
    for i in range(n):
        ok &= words.ids[where[at] + i] == words.ids[where[at + 1] + i]
    if not ok.all():  # unequal n-grams share a hash: order these exactly
        columns = [words.ids[where + i] for i in range(n - 1, -1, -1)] + [words.text[where]]
        where = where[np.lexsort(columns)]
        same = words.text[where[1:]] == words.text[where[:-1]]
        for i in range(n):
            same &= words.ids[where[1:] + i] == words.ids[where[:-1] + i]
    return where, np.concatenate([[0], np.cumsum(~same)])


def covered_by(words: Words, starts: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in the n-grams that begin at starts."""
    size = len(words.ids) + 1
    return np.cumsum(np.bincount(starts, minlength=size) - np.bincount(starts + n, minlength=size))[:-1] > 0


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The figures of each text; shares are of the text's word characters (of its lines with a word, for lines)."""
    count = len(texts)
    words = split_words(texts)
    total = np.bincount(words.text, words.chars, count).astype(np.int64)
    n_words = np.diff(words.start)
    out = {"n_words": n_words, "word_chars": total, "n_symbols": np.array([len(t.translate(None, _NOT_SYMBOL)) for t in texts], np.int64)}

    lines, line_chars, repeated_lines, repeated_chars = (np.zeros(count, np.int64) for _ in range(4))
    for i, text in enumerate(texts):
        seen = set()
        for line in text.split(b"\n"):
            if not line or line.isspace():
                continue
            size = points(line)
            lines[i] += 1
            line_chars[i] += size
            if line in seen:
                repeated_lines[i] += 1
                repeated_chars[i] += size
            seen.add(line)
    out |= {"n_dup_lines": repeated_lines, "line_share": repeated_lines / np.maximum(lines, 1), "line_char_share": repeated_chars / np.maximum(line_chars, 1)}

    marks = mix64(words.ids.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    hashes = marks.copy()
    divisor = np.maximum(total, 1)
    sums = np.concatenate([[0], np.cumsum(words.chars)])
    for n in range(2, max(REPEATED_LIMITS) + 1):
        # hash of the n words from i: the hash of the first n - 1, shifted, plus the mark of the last
        rolled = hashes.copy()
        if len(rolled) >= n:
            rolled[: len(rolled) - n + 1] = hashes[: len(rolled) - n + 1] * _BASE + marks[n - 1 :]
        hashes = rolled
        where, group = ngram_groups(words, n, hashes)
        times = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        if n in TOP_LIMITS:
            top = np.zeros(count)
            if len(where):
                first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                begin = where[first]
                weight = np.where(times > 1, times * (sums[begin + n] - sums[begin]), 0)
                np.maximum.at(top, words.text[begin], weight)
            out[f"top_{n}"] = top / divisor
        else:
            again = covered_by(words, where[times[group] > 1], n) if len(where) else np.zeros(len(words.ids), bool)
            out[f"repeated_{n}"] = np.bincount(words.text[again], words.chars[again], count) / divisor
            if n == REPEAT_WINDOW:
                out["n_repeat_words"] = np.bincount(words.text[again], minlength=count).astype(np.int64)
    return out


def verdicts(figures: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    base_failed = (figures["n_words"] < MIN_WORDS) | (100 * figures["n_repeat_words"] > MAX_REPEAT_PERCENT * figures["n_words"])
    good = (figures["line_share"] <= LINE_LIMIT) & (figures["line_char_share"] <= LINE_CHARS_LIMIT)
    for n, limit in TOP_LIMITS.items():
        good &= figures[f"top_{n}"] <= limit
    for n, limit in REPEATED_LIMITS.items():
        good &= figures[f"repeated_{n}"] <= limit
    return {"base_failed": base_failed, "kept": good & ~base_failed}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("line_share", "line_char_share", *(f"top_{n}" for n in TOP_LIMITS), *(f"repeated_{n}" for n in REPEATED_LIMITS))
SCHEMA = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean", "kept boolean", *(f"{c} double" for c in SHARES)])


def quality_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch_texts(batch.column("text"))
        for a, b in runs_of_texts(texts):
            figures = measure(texts[a:b])
            figures |= verdicts(figures)
            names = [*COUNTS, "base_failed", "kept", *SHARES]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(figures[c]) for c in names)], names=["doc_id", *names])


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept, and the shares that the verdict rests on.

    docs needs doc_id and text; other columns are ignored. A null or empty text has no words and fails the base rules.
    Repeated rows, and rows without a doc_id, are judged each for itself; very long texts whole. An empty table gives an
    empty result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(quality_rows, SCHEMA)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the rules keep. Columns may have any name; see quality_rules for all else."""
    names = [f"_in{i}" for i in range(len(docs.columns))]
    held = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch_texts(batch.column("_text"))
            for a, b in runs_of_texts(texts):
                yield batch.slice(a, b - a).select(names).filter(pa.array(verdicts(measure(texts[a:b]))["kept"]))

    out = held.mapInArrow(run, ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True)))
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


_TOP_SQL = ", ".join(f"coalesce(max(CASE WHEN n = {n} AND times > 1 THEN times * chars END), 0) AS most_{n}" for n in TOP_LIMITS)
_REPEATED_SQL = ", ".join(f"coalesce(sum(CASE WHEN n = {n} THEN length(w) END), 0) AS inside_{n}" for n in REPEATED_LIMITS)
_SHARES_SQL = ", ".join([f"coalesce(most_{n}, 0) / greatest(word_chars, 1) AS top_{n}" for n in TOP_LIMITS] + [f"coalesce(inside_{n}, 0) / greatest(word_chars, 1) AS repeated_{n}" for n in REPEATED_LIMITS])
_LIMITS_SQL = " AND ".join([f"line_share <= {LINE_LIMIT}::DOUBLE AND line_char_share <= {LINE_CHARS_LIMIT}::DOUBLE"] + [f"top_{n} <= {x}::DOUBLE" for n, x in TOP_LIMITS.items()] + [f"repeated_{n} <= {x}::DOUBLE" for n, x in REPEATED_LIMITS.items()])
_LEADS_SQL = ", ".join(f"' ' || lead(w, {k}) OVER o AS w{k}" for k in range(1, 10))
_LONG_SQL = "CASE r.n " + " ".join(f"WHEN {n} THEN w || {' || '.join(f'w{k}' for k in range(1, n))}" for n in REPEATED_LIMITS) + " END"
OP4_SQL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), counted AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols
  FROM texts
), lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS nth FROM (
    SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), by_lines AS (
  SELECT doc_id, CAST(count(*) FILTER (nth > 1) AS BIGINT) AS n_dup_lines, count(*) FILTER (nth > 1) / count(*) AS line_share,
         coalesce(sum(length(line)) FILTER (nth > 1), 0) / sum(length(line)) AS line_char_share
  FROM lines GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM texts
), runs AS (
  SELECT doc_id, i, w, {_LEADS_SQL} FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), short AS (
  SELECT doc_id, n, i, length(replace(gram, ' ', '')) AS chars, count(*) OVER (PARTITION BY doc_id, n, gram) AS times
  FROM (SELECT doc_id, n, i, CASE n WHEN 2 THEN w || w1 WHEN 3 THEN w || w1 || w2 ELSE w || w1 || w2 || w3 END AS gram FROM runs, range(2, 5) r(n)) WHERE gram IS NOT NULL
), long AS (  -- a longer run of words occurs twice only where its first four do
  SELECT doc_id, n, i, 0 AS chars, count(*) OVER (PARTITION BY doc_id, n, gram) AS times
  FROM (SELECT s.doc_id, r.n, s.i, {_LONG_SQL} AS gram FROM short s JOIN runs w ON w.doc_id = s.doc_id AND w.i = s.i, range(5, 11) r(n) WHERE s.n = 4 AND times > 1) WHERE gram IS NOT NULL
), grams AS (
  SELECT * FROM short UNION ALL SELECT * FROM long
), tops AS (
  SELECT doc_id, {_TOP_SQL} FROM grams GROUP BY doc_id
), inside AS (
  SELECT DISTINCT doc_id, n, i + k AS i FROM grams, range(0, 10) r(k) WHERE times > 1 AND n >= 5 AND k < n
), covered AS (
  SELECT doc_id, {_REPEATED_SQL}, CAST(count(*) FILTER (n = {REPEAT_WINDOW}) AS BIGINT) AS n_repeat_words FROM inside JOIN words USING (doc_id, i) GROUP BY doc_id
), shares AS (
  SELECT c.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(line_share, 0)::DOUBLE AS line_share, coalesce(line_char_share, 0)::DOUBLE AS line_char_share, {_SHARES_SQL}
  FROM counted c LEFT JOIN by_lines USING (doc_id) LEFT JOIN tops USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND {_LIMITS_SQL} AS kept
FROM shares
"""
