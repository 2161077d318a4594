"""Digests of tables that depend neither on the order nor on the placing of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hexadecimal digits of a part of a row's hash, and parts: four numbers below 2**60.
DIGITS, PARTS = 15, 4


def _text(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        c = F.to_json(c, {"ignoreNullFields": "false"})
    elif isinstance(kind, T.BinaryType):
        c = F.hex(c)
    return c.cast("string")


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of a row's values by column name, each with its length; null differs from any text. Columns may stand in any order."""
    texts = [_text(f.name, f.dataType) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return F.sha2(F.concat(F.lit(""), *[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def table_digest(df: DataFrame, *by: str) -> DataFrame:
    """(by, n, s1..s4): rows, and the sums of four parts of their hashes, in decimals.

    Equal for equal multisets of rows; a changed, missing or doubled row changes it (but for a chance of about 2**-240). Sums are made where
    rows are, and digests of shards add up (see merged), so a table is compared without a sort or an exchange of its rows.
    """
    rest = df.drop(*by) if by else df
    hashed = df.select(*by, row_hash(rest).alias("_h"))
    parts = [F.conv(F.substring("_h", 1 + DIGITS * k, DIGITS), 16, 10).cast("decimal(20,0)") for k in range(PARTS)]
    sums = [F.coalesce(F.sum(p), F.lit(0)).cast("decimal(38,0)").alias(f"s{k}") for k, p in enumerate(parts, 1)]
    return hashed.groupBy(*by).agg(F.count("*").alias("n"), *sums)


def merged(digests: DataFrame, *by: str) -> DataFrame:
    """The digest of a whole from those of its shards."""
    sums = [F.coalesce(F.sum(f"s{k}"), F.lit(0)).cast("decimal(38,0)").alias(f"s{k}") for k in range(1, PARTS + 1)]
    return digests.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *sums)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of the same column names hold the same rows, as often: one job of two digests."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    return table_digest(a).unionByName(table_digest(b)).distinct().count() == 1
