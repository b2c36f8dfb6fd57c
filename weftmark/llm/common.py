"""Shared helpers of the corpus operators: stage tables, word patterns, digests."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.session import fresh_path, staged

__all__ = ["fresh_path", "staged"]

#: ASCII white space, as a Spark trim set and as a Java character class.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most ``rows`` rows in an Arrow batch of the jobs run within; the session's own setting comes back after."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def free_prefix(df: DataFrame) -> str:
    """Underscores that no column of ``df`` begins with, for helper columns beside the input's."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay. ``lower`` does the same on ASCII text and is much faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id as text modulo ``k`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % k


def bucket_count(rows: int, per_bucket: int) -> int:
    return max(1, -(-rows // per_bucket))
