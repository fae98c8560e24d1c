"""Set operations and removal of duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .windows import ranked


def union_tagged(parts: dict[str, DataFrame], into: str) -> DataFrame:
    """UNION ALL of frames, each with its name in a column."""
    return reduce(DataFrame.unionByName, [df.withColumn(into, F.lit(name)) for name, df in parts.items()])


def first_found(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of several tables; of one key that of the first table that has it."""
    every = reduce(DataFrame.unionByName, [df.withColumn("_p", F.lit(i)) for i, df in enumerate(parts)])
    return every.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy("_p"))).filter("_k = 1").drop("_k", "_p")


def interleave(df: DataFrame, lists: str, key: str, text: str, prefix: int = 200) -> DataFrame:
    """(lists, key, place): lists, each in order of a key, merged position by position; of rows with the same first ``prefix`` characters the first stays.

    A digest of those characters stands for them, so no text is ranked or moved.
    """
    start = df.select(lists, key, F.md5(F.substring(text, 1, prefix)).alias("_p"))
    rows = ranked(start, lists, key).select(lists, key, F.col("_rank").alias("place")).join(start, [lists, key])
    first = rows.groupBy("_p").agg(F.min(F.struct("place", lists, key)).alias("f"))
    return first.select(f"f.{lists}", f"f.{key}", "f.place")


def by_content(df: DataFrame, text: str, key: str) -> DataFrame:
    """The first row, by key, of each content hash; null texts count as equal."""
    h = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return df.groupBy(h.alias("content_hash")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def idempotency_key(*parts: Column) -> Column:
    """A hash of all parts, null ones as empty."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
