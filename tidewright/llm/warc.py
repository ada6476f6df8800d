"""WARC archives: a writer of gzip members with revisit records, and a splittable reader.

Every record is a gzip member of its own. A reader task gets a byte range of a file, looks for gzip's magic bytes in it,
takes a candidate for a member only if it inflates to a WARC header, and owns the records that start inside its range;
the last of them may end beyond it. So one large archive is read by many tasks, and a task needs no index and no state
from another.

Archives are opened through pyarrow's file systems by URI, so executors need a scheme that these know (file, s3, gs,
hdfs). The writer names its files in a manifest that is itself a table in the shared folder: a file left by a task that
was lost is in no manifest and is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, materialize, partitions, scratch_path

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
MIN_REVISIT_BYTES = 0
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = WARC_DATE) -> bytes:
    """One record. A revisit has the headers of the response it stands for, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.splitlines()).strip())
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def open_uri(uri: str, mode: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path, compression=None) if mode == "w" else system.open_input_file(path)


def writer_of(folder: str, file_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, size, records, done = None, "", 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    uri, size, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_uri(uri, "w")
                member = gzip_member(record_bytes(row["record_type"], row["page_id"], row["url"], row["html"].encode("utf-8", "surrogatepass"), row["refers_to"]))
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= file_bytes:
                    out.close()
                    done.append((uri, size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((uri, size, records))
        if done:
            a, b, c = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["file", "bytes", "records"])

    return write


def with_record_types(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) with record_type and refers_to; other columns are ignored, html null becomes empty.

    Of the pages with equal payloads of at least min_revisit_bytes the one with the largest page_id (null counts as the
    smallest) is the response, the others revisit it; a row that repeats the largest page_id is a revisit too. A page
    whose payload occurs once is a response. An empty table gives an empty result. pages is read twice, and has to give
    its rows in the same order each time, as a table does.

    Only digests that occur twice are looked up, and the pages of a payload that very many share are spread (see
    common.join_groups), so that no writer gets all of them.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("row", F.monotonically_increasing_id())
    keyed = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("long"))
    best = F.max(F.struct(F.col("page_id").isNotNull(), F.col("page_id"), F.col("row")))
    groups = keyed.groupBy("digest", "size").agg(best.alias("best"), F.count(F.lit(1)).alias("copies"))
    groups = groups.where(f"copies > 1 and size >= {int(min_revisit_bytes)}")
    groups = materialize(groups.select("digest", "size", "copies", F.col("best.page_id").alias("first_id"), F.col("best.row").alias("first_row")), "repeated-payloads")
    revisits = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    return join_groups(keyed, groups, ["digest", "size"], "copies", ["row"]).select(
        "page_id", "url", "html",
        F.when(revisits, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisits, F.col("first_id")).alias("refers_to"),
    )


def write_warc(typed: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the rows of with_record_types() as archives in folder; returns their manifest (file, bytes, records)."""
    if folder.startswith("file:"):
        from pyarrow import fs

        fs.LocalFileSystem().create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    return materialize(typed.mapInArrow(writer_of(folder, file_bytes), "file string, bytes long, records long"), "warc-manifest")


def parse_record(data: bytes) -> dict:
    """The fields of an inflated record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n") if "application/http" in fields.get("content-type", "") else (b"", b"", block)
    length = len(payload)
    kind = fields.get("warc-type")
    if kind == "revisit":
        for line in http.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                length = int(value)
    digest = fields.get("warc-payload-digest", "").partition(":")[2]
    if kind == "response" and digest and digest != base32_sha1(payload):
        raise ValueError(f"payload digest of {fields.get('warc-record-id')} is wrong")
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": kind, "url": fields.get("warc-target-uri"),
        "payload_digest": digest, "payload_bytes": length, "refers_to_id": fields.get("warc-refers-to", "").strip("<>") or None, "payload": payload,
    }


def records_in_range(source, start: int, end: int, read_bytes: int = READ_BYTES) -> Iterator[tuple[int, bytes]]:
    """Offset and inflated bytes of every record whose member starts in [start, end) of a seekable binary file."""
    at, held, held_at = start, b"", start
    source.seek(start)

    def more() -> bool:
        nonlocal held
        got = source.read(read_bytes)
        held += got
        return bool(got)

    while at < end:
        held, held_at = held[at - held_at :], at
        found = held.find(MAGIC)
        while found < 0:
            keep = max(0, len(held) - 2)
            held, held_at = held[keep:], held_at + keep
            if held_at >= end or not more():
                return
            found = held.find(MAGIC)
        at = held_at + found
        if at >= end:
            return
        unpack, out, fed, real = zlib.decompressobj(31), [], found, True
        while not unpack.eof:
            if fed >= len(held) and not more():
                real = False  # it is cut off
                break
            piece, fed = held[fed:], len(held)
            try:
                out.append(unpack.decompress(piece))
            except zlib.error:
                real = False
                break
            seen = b"".join(out[:2]) if len(out) < 3 else b""
            if seen and not seen[:5] == b"WARC/"[: len(seen)]:
                real = False
                break
        data = b"".join(out) if real else b""
        if real and data.startswith(b"WARC/") and b"\r\n\r\n" in data:
            yield at, data
            at = held_at + len(held) - len(unpack.unused_data)
        else:
            at += 1


READ_SCHEMA = "file string, offset long, record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to_id string, payload binary"
_READ_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in READ_SCHEMA.split(", "))])


def reader_of(with_payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                rows, size = [], 0
                with open_uri(part["file"], "r") as source:
                    for offset, data in records_in_range(source, part["start"], part["end"]):
                        row = {"file": part["file"], "offset": offset} | parse_record(data)
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or b"") + 200
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _READ_ARROW)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ_ARROW)

    return read


def read_warc(manifest: DataFrame, *, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of the archives in a manifest (file, bytes), read by byte ranges of range_bytes each.

    A file of no bytes, or without a record, gives no rows; an empty manifest gives an empty result.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = manifest.where("bytes > 0").select("file", "bytes", starts.alias("start")).select("file", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("end"))
    return ranges.repartition(partitions(manifest.sparkSession), "file", "start").mapInArrow(reader_of(with_payload), READ_SCHEMA)


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_warc(with_record_types(pages), scratch_path(spark, "warc"))
    number = lambda c: F.substring_index(F.col(c), ":", -1).try_cast("long")
    return read_warc(manifest, with_payload=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to")
    )


#: DuckDB has SHA-1 in hexadecimal only; base 32 is made from it five bits at a time.
OP8_SQL = r"""
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: right(to_binary(CAST(instr('123456789abcdef', substr(hex, i, 1)) AS INTEGER) + 16), 4)), 'string_agg', '') AS b
  FROM hashed
), coded AS (
  SELECT page_id, payload_bytes, hex,
         list_aggregate(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           16 * CAST(substr(b, 5 * g + 1, 1) AS INTEGER) + 8 * CAST(substr(b, 5 * g + 2, 1) AS INTEGER) + 4 * CAST(substr(b, 5 * g + 3, 1) AS INTEGER)
           + 2 * CAST(substr(b, 5 * g + 4, 1) AS INTEGER) + CAST(substr(b, 5 * g + 5, 1) AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM bits
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS first_id FROM coded
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM grouped
"""
