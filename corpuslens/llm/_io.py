"""Reading the tables, and expressions that several operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import discard
from ..operators.storage import kept as stored

__all__ = ["SPACE", "SPACES", "discard", "lower_ascii", "remainder", "row_tag", "smallest", "stored", "table", "words"]

#: Regex class of the characters between words, and the same as plain text.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The maximal runs without space, tab, line or page breaks; an empty array for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key's text modulo modulus: the documented split into training and held-out documents."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(modulus))


def row_tag(text: Column) -> Column:
    """60 bits of the text's digest: with an id, the name of a row where ids repeat. Null for null."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def smallest(ids: DataFrame, id_col: str, n: int) -> DataFrame:
    """The n rows of ids with the smallest hashes. A threshold from their number leaves about 2 n of them, which alone are put in order."""
    key = F.xxhash64(id_col)
    share = min(1.0, 2 * n / max(1, ids.count()))
    few = ids if share == 1 else ids.where(key < F.lit(int(-(2**63) + share * 2**64)))
    return few.orderBy(key, id_col).limit(n)
