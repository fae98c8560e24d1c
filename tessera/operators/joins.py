"""Joins that are more than one call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest_of(left: DataFrame, right: DataFrame, on: str, order: list[Column], how: str = "left") -> DataFrame:
    """Each left row with the first row of its key on the right: a lateral join of one row."""
    top = right.withColumn("_k", F.row_number().over(W.partitionBy(on).orderBy(*order))).filter("_k = 1").drop("_k")
    return left.join(top, on, how)


def reconcile(stored: DataFrame, vectors: DataFrame, key: str, stored_n: str, vector_n: str) -> DataFrame:
    """A full outer join of two stores: (key, issue), issue null where they agree."""
    both = stored.join(vectors, key, "full_outer")
    issue = (
        F.when(F.col(vector_n).isNull(), "ghost_doc").when(F.col(stored_n).isNull(), "orphan_vectors").when(F.col(stored_n) != F.col(vector_n), "chunk_count_mismatch")
    )
    return both.select(key, issue.alias("issue"))


def duplicates(df: DataFrame, known: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(duplicates, unique): the rows whose key is known, and the others."""
    keys = known.select(*on).distinct()
    return df.join(keys, on, "left_semi"), df.join(keys, on, "left_anti")


def override(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several registries; of one key that of the first registry that has it."""
    every = reduce(DataFrame.unionByName, [s.withColumn("_p", F.lit(i)) for i, s in enumerate(sources)])
    return every.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy("_p"))).filter("_k = 1").drop("_k", "_p")


def keyword_lookup(queries: DataFrame, keywords: DataFrame, query_id: str, entry_id: str) -> DataFrame:
    """(query_id, entry_id) where all of an entry's tokens are among the query's: found by one token, then verified.

    Both have a column ``tokens`` of distinct tokens. The token that the fewest entries have stands for an entry.
    """
    rare = keywords.select(entry_id, F.explode("tokens").alias("t"))
    often = rare.groupBy("t").agg(F.count("*").alias("n"))
    chosen = rare.join(often, "t").groupBy(entry_id).agg(F.min_by("t", F.struct("n", "t")).alias("t"))
    entries = keywords.join(chosen, entry_id).select(entry_id, "t", F.col("tokens").alias("needed"))
    asked = queries.select(query_id, F.explode("tokens").alias("t"))  # token by token, without the whole list beside each
    found = asked.join(entries, "t").select(query_id, entry_id, "needed").join(queries.select(query_id, "tokens"), query_id)
    return found.filter(F.size(F.array_except("needed", "tokens")) == 0).select(query_id, entry_id)
