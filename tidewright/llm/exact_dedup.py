"""Exact deduplication by composable polynomial fingerprints.

A normalised text is hashed in chunks, and the hashes combine by length-shifted arithmetic,
hash(a + b) = hash(a) * base ** len(b) + hash(b), under two prime moduli. The chunks of huge texts are dealt out and
hashed in parallel, each shifted by the length of what follows it, so that a sum makes the fingerprint. Texts with
equal fingerprints and lengths are then compared byte for byte, chunk by chunk: of each chunk of each fingerprint only
the smallest and the largest value are kept, in every task and again after the shuffle, so a group of any size is
compared without ever being brought together, and nothing longer than a chunk is held. Where the two values differ,
unequal texts share a fingerprint and the group is split by the SHA-256 of the texts.

Only texts whose fingerprint occurs twice need comparing. A Bloom filter of these fingerprints, of a fixed size, keeps
most others from being sent; where it is too full to do so, more is sent and nothing else changes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, SPACE_BYTES, WHOLE, batch_texts, documents, join_groups, materialize, mix64, unwrapped, wrapped

#: Primes under 2 ** 31, and a base for each: the products of a chunk can be summed in 64 bits.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CHUNK = 1 << 16
#: Texts of more bytes than this are hashed in parallel.
HUGE = 1 << 20
BLOOM_BITS = 1 << 23


def power_table(base: int, prime: int, length: int) -> np.ndarray:
    """base ** (length - 1) .. base ** 0, modulo prime."""
    table = np.ones(1, dtype=np.uint64)
    while len(table) < length:
        table = np.concatenate([table * np.uint64(pow(base, len(table), prime)) % np.uint64(prime), table])
    return table[len(table) - length :].copy()


class Fingerprinter:
    """Fingerprints of byte strings; parts may be hashed in parallel and combined."""

    def __init__(self, chunk: int = CHUNK, primes: tuple[int, int] = PRIMES):
        self.chunk, self.primes = chunk, primes
        self.tables = [power_table(b, p, chunk) for b, p in zip(BASES, primes, strict=True)]

    def of_chunk(self, data: bytes) -> tuple[int, int]:
        values = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        return tuple(int(np.dot(values, table[self.chunk - len(values) :]) % np.uint64(p)) for table, p in zip(self.tables, self.primes, strict=True))

    def shifted(self, hashes: tuple[int, int], length: int) -> tuple[int, int]:
        """Hashes of a part that `length` bytes follow, as terms of the whole's."""
        return tuple(a * pow(base, length, p) % p for a, base, p in zip(hashes, BASES, self.primes, strict=True))

    def combine(self, left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
        return tuple((a + b) % p for a, b, p in zip(self.shifted(left, right_length), right, self.primes, strict=True))

    def of(self, data: bytes) -> int:
        held = (0, 0)
        for at in range(0, len(data), self.chunk):
            part = data[at : at + self.chunk]
            held = self.combine(held, self.of_chunk(part), len(part))
        return held[0] << 31 | held[1]


def normalized(text: bytes) -> bytes:
    """Without the six ASCII white-space characters; they never occur inside another character's UTF-8 bytes."""
    return text.translate(None, SPACE_BYTES)


ROWS = "doc_id long, row long, n_points long, length long, text_sha256 string, fingerprint long, following long, chunk binary"
_ROWS_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_points", pa.int64()), ("length", pa.int64()), ("text_sha256", pa.string()), ("fingerprint", pa.int64()), ("following", pa.int64()), ("chunk", pa.binary())])


def fingerprint_rows(primes: tuple[int, int], huge: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, text, row if there -> a row of ROWS each; of huge texts without fingerprint, and a row for each chunk too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hasher, number = Fingerprinter(primes=primes), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            rows, size = [], 0
            texts, docs = batch_texts(batch.column("text")), batch.column("doc_id").to_pylist()
            numbers = batch.column("row").to_pylist() if "row" in batch.schema.names else range(number, number + len(texts))
            number += len(texts)
            for doc, row, text in zip(docs, numbers, texts, strict=True):
                clean = normalized(text)
                whole = len(clean) <= huge
                rows.append((doc, row, len(text.decode("utf-8", "replace")), len(clean), hashlib.sha256(clean).hexdigest(), hasher.of(clean) if whole else None, None, None))
                for at in () if whole else range(0, len(clean), CHUNK):
                    part = clean[at : at + CHUNK]
                    rows.append((None, row, None, None, None, None, len(clean) - at - len(part), part))
                    size += len(part)
                    if size >= 4 << 20:
                        yield _batch(rows, _ROWS_ARROW)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, _ROWS_ARROW)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def term_rows(primes: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """row, following, chunk -> row, a, b: the chunk's terms of its text's two hashes."""
    schema = pa.schema([("row", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Fingerprinter(primes=primes)
        for batch in batches:
            rows = [(r, *hasher.shifted(hasher.of_chunk(c), n)) for r, n, c in zip(*(batch.column(x).to_pylist() for x in ("row", "following", "chunk")), strict=True)]
            if rows:
                yield _batch(rows, schema)

    return run


def fingerprints(docs: DataFrame, row: str | None, primes: tuple[int, int], huge: int) -> DataFrame:
    """doc_id, row, n_points, length, text_sha256, fingerprint of every row; a written table, so rows are numbered once."""
    number = [F.col(row).alias("row")] if row else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *number)
    found = materialize(texts.mapInArrow(fingerprint_rows(primes, huge), ROWS), "fingerprints")
    whole = found.where("chunk is null").drop("following", "chunk")
    chunks = found.where("chunk is not null").select("row", "following", "chunk")
    terms = chunks.repartition("row", "following").mapInArrow(term_rows(primes), "row long, a long, b long")
    sums = terms.groupBy("row").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    huge_ones = sums.select("row", (F.shiftleft(F.col("a") % primes[0], 31).bitwiseOR(F.col("b") % primes[1])).alias("summed"))
    joined = whole.where("fingerprint is null").drop("fingerprint").join(huge_ones, "row").withColumnRenamed("summed", "fingerprint")
    return whole.where("fingerprint is not null").unionByName(joined.select(whole.columns))


def bloom_slots(fingerprint: np.ndarray, length: np.ndarray, bits: int) -> list[np.ndarray]:
    """Numbers of the bits of each pair."""
    h = mix64(fingerprint.astype(np.uint64) ^ mix64(length.astype(np.uint64)))
    return [(mix64(h + np.uint64(i)) % np.uint64(bits)).astype(np.int64) for i in range(1, 5)]


def bloom_filter(pairs: DataFrame, bits: int) -> np.ndarray:
    """The filter of pairs (fingerprint, length), a byte for 8 bits: of a fixed size, however many pairs there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits, bool)
        for batch in batches:
            for slots in bloom_slots(*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fingerprint", "length")), bits):
                held[slots] = True
        words = np.packbits(held).view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at])], names=["at", "word"])

    out = np.zeros(bits // 64, "<i8")
    for at, word in pairs.mapInArrow(run, "at int, word long").groupBy("at").agg(F.bit_or("word")).collect():  # bits / 64 rows at most
        out[at] = word
    return out.view(np.uint8)


def chunk_rows(primes: tuple[int, int], bloom: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """text -> fingerprint, length, chunk_no, chunk of texts that the filter does not rule out, in batches of a few MB."""
    schema = pa.schema([("fingerprint", pa.int64()), ("length", pa.int64()), ("chunk_no", pa.int32()), ("chunk", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = Fingerprinter(primes=primes), np.unpackbits(bloom).astype(bool)
        for batch in batches:
            rows, size = [], 0
            clean = [normalized(t) for t in batch_texts(batch.column("text"))]
            marks, lengths = np.array([hasher.of(t) for t in clean], np.int64), np.array([len(t) for t in clean], np.int64)
            wanted = np.logical_and.reduce([bits[slots] for slots in bloom_slots(marks, lengths, len(bits))])
            for i in np.flatnonzero(wanted).tolist():
                for at in range(0, len(clean[i]), CHUNK):
                    rows.append((int(marks[i]), int(lengths[i]), at // CHUNK, clean[i][at : at + CHUNK]))
                    size += len(rows[-1][3])
                    if size >= 4 << 20:
                        yield _batch(rows, schema)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, schema)

    return run


def exact_classes(docs: DataFrame, row: str | None = None, *, primes: tuple[int, int] = PRIMES, huge: int = HUGE, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """Per row: doc_id, row, n_points, text_sha256, keep_id, group_size, kept.

    docs needs doc_id and text; other columns are ignored. A null text counts as empty, and all texts without a
    character that is not white space are equal. Of equal texts the row with the most code points stays, of these that
    with the smallest doc_id (a null doc_id last), of rows that repeat both the first read; so a row without a doc_id is
    kept, or has the keep_id of another, like any row. An empty table gives an empty result. row names a column of
    numbers that tell apart the rows; without it they are made, once, and written down. Texts of more than `huge` bytes
    are hashed chunk by chunk in parallel. primes: the moduli of the fingerprints.
    """
    keyed = fingerprints(docs, row, primes, huge)
    pairs = keyed.groupBy("fingerprint", "length").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint", "length")
    bloom = bloom_filter(pairs, bloom_bits)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    chunks = texts.mapInArrow(chunk_rows(primes, bloom), "fingerprint long, length long, chunk_no int, chunk binary")
    unequal = (
        chunks.groupBy("fingerprint", "length", "chunk_no")
        .agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
        .where("least <> most")
        .select("fingerprint", "length", F.lit("x").alias("unequal"))
        .distinct()
    )
    order = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    # by text: all rows of a text in one group, whatever their number, before anything is joined
    by_text = keyed.groupBy("fingerprint", "length", "text_sha256").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"))
    split = materialize(by_text.join(unequal, ["fingerprint", "length"], "left").withColumn("split", F.when(F.col("unequal").isNotNull(), F.col("text_sha256")).otherwise(F.lit(""))), "texts")
    classes = split.groupBy("fingerprint", "length", "split").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    groups = split.select("fingerprint", "length", "split", "text_sha256").join(classes, ["fingerprint", "length", "split"])
    groups = materialize(groups.select("fingerprint", "length", "text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"), "exact-groups")
    out = join_groups(keyed, groups, ["fingerprint", "length", "text_sha256"], "group_size", ["row"])
    return out.select("doc_id", "row", "n_points", "text_sha256", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def keep_exact(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that exact_classes keeps, one of each class.

    docs is read more than once, and has to give its rows in the same order each time, as a written table does.
    """
    rows = wrapped(docs)
    kept = exact_classes(rows.select(f"{WHOLE}.doc_id", f"{WHOLE}.text", ROW), ROW).where("kept").select(F.col("row").alias(ROW))
    return unwrapped(rows.join(kept.hint("merge"), ROW, "left_semi"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH clean AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents
), hashed AS (
  SELECT doc_id, n_points, sha256(body) AS text_sha256 FROM clean
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM hashed
WINDOW best AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST)
"""
