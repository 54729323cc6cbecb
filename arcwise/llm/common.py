"""Helpers shared by the operators: shared storage, joins that survive hot keys, small SQL expressions."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path, shared_dir, stored

__all__ = ["blocks_join", "bound_batches", "hash60", "new_path", "partitions", "shared_dir", "small_batches", "stored", "text_of"]


def text_of(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, text never null: other columns can't clash with ours."""
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c == "text" else F.col(f"`{c}`") for c in columns])


def blocks_join(left: DataFrame, right: DataFrame, key: str, spread: Column, blocks: int = 256) -> DataFrame:
    """left join right (one row a key) where a key of left may hold a third of its rows.

    Left rows get a block from `spread`. The distinct (key, block) pairs, at most `blocks` a key, meet the right side;
    then left meets the pairs by (key, block). No task gets a whole hot key, and right isn't replicated.
    """
    salted = left.withColumn("_aw_block", F.pmod(F.xxhash64(spread), F.lit(blocks)).cast("int"))
    pairs = salted.select(key, "_aw_block").distinct().join(right, key, "left")
    return salted.join(pairs, [key, "_aw_block"], "left").drop("_aw_block")


def hash60(column: Column) -> Column:
    """The first 60 bits of the MD5 as a bigint, the same in Spark and in SQL engines without Spark's hashes."""
    return F.conv(F.substring(F.md5(column.cast("string")), 1, 15), 16, 10).cast("bigint")


def bound_batches(spark: SparkSession, rows: int = 500) -> None:
    """Lowers the session's limit on rows of an Arrow batch to `rows`, for good: a DataFrame that is returned reads the
    limit when it is run, so it can't be put back before. Operators that carry whole texts through Python call this."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Has the Arrow batches of what runs within hold `rows` rows at most: with long texts the default of 10,000 fills
    Python and the JVM's buffers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    bound_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
