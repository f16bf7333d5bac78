"""What the operators of this package share: tables, the shared folder, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import forget_all, new_path, shared_dir, stash

__all__ = ["SPACE", "UPPER", "LOWER", "ascii_lower", "forget_all", "new_path", "row_key", "shared_dir", "stash", "table", "word_count"]

#: Fixed value: the word separators of the contracts that count plain words.
SPACE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below sf_dir, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; lower() is the same on pure ASCII and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of plain words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("long")


def row_key() -> Column:
    """A string that rows have in common only if their texts (null as '') and ids, as strings, are equal;
    the id behind the text's MD5 spreads copies."""
    return F.concat(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
