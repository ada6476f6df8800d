"""What the corpus operators share: the scratch folder, column selection, word splitting, stable hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_path, written

#: Words and white space of the contracts: runs of characters other than the six ASCII white-space ones.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share."""
    return shared_path(spark, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    return written(df, name)


#: A group is hot if it holds more than one in so many rows; so there are at most as many hot groups.
HOT_GROUPS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: list[str]) -> DataFrame:
    """rows with the columns of groups (a row for each value of keys; size: its number of rows), null where there is none.

    The rows of a hot group would all be dealt to one task. Hot groups are HOT_GROUPS at most whatever the input, so they
    are broadcast; their rows are dealt out by the columns `spread`, and only the others by their keys. groups is read
    several times: it should be a written table.
    """
    values = [c for c in groups.columns if c not in keys]
    total = groups.agg(F.sum(size)).first()[0] or 0
    held = groups.where(F.col(size) * HOT_GROUPS > total).select(*keys, F.struct(*values).alias("_hot"))
    marked = rows.join(F.broadcast(held), keys, "left").withColumn("_spread", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), F.lit(1 << 20)) + 1))
    cold = groups.where(F.col(size) * HOT_GROUPS <= total).select(*keys, F.struct(*values).alias("_cold"), F.lit(0).cast("long").alias("_spread"))
    joined = marked.withColumn("_spread", F.col("_spread").cast("long")).join(cold.hint("merge"), [*keys, "_spread"], "left")
    return joined.withColumn("_found", F.coalesce("_hot", "_cold")).select(*rows.columns, "_found.*")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_crc(name: str = "doc_id") -> Column:
    return F.crc32(F.col(name).cast("string"))


def batch_texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def runs_of_texts(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges holding about `limit` bytes each; a longer text stands alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the finaliser known as splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Tells apart the rows of a table while a decision on them is joined back.
ROW = "_row_number"


def numbered(docs: DataFrame) -> DataFrame:
    """docs with numbers of its rows in the column ROW, the same each time as long as docs is read in the same order."""
    return docs.withColumn(ROW, F.monotonically_increasing_id())


#: Holds a row's own columns, whatever their names, while a decision on it is joined back.
WHOLE = "_in"


def wrapped(docs: DataFrame) -> DataFrame:
    """The columns of docs in one, WHOLE, beside the row's number, ROW; so no name of theirs clashes. As numbered()."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(WHOLE), F.monotonically_increasing_id().alias(ROW))


def unwrapped(rows: DataFrame) -> DataFrame:
    return rows.select(f"{WHOLE}.*")
