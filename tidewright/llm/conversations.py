"""What the operators on conversations share: turns in a fixed order, and SQL of both contracts' checksum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def turn_digest(role: str = "role", text: str = "text") -> Column:
    """128 bits of SHA-256 of a turn's role and text: rows of a conversation that share a turn are ordered by it."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)), 256), 1, 32))


#: The same in DuckDB, as hexadecimal text.
DIGEST_SQL = "substr(sha256(length(role) || ':' || role || text), 1, 32)"


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a text of ASCII characters."""
    shifted = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {shifted}), 4294967295)"
