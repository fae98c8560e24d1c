"""Ranked and windowed operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark cuts the groups before it shuffles them."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")


def numbered(df: DataFrame, group: list[str], order: list[Column], into: str) -> DataFrame:
    return df.withColumn(into, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long"))


def within_budget(df: DataFrame, group: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows in order until the first that overflows the budget; costs aren't negative."""
    spent = F.sum(cost).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("_spent", spent).filter(F.col("_spent") <= budget).drop("_spent")


def fit_and_skip(df: DataFrame, group: str, order: Column, key: str, cost: str, budget: int, most: int) -> DataFrame:
    """(group, key) of the rows that are taken in order while they fit; one that doesn't is skipped, smaller ones may follow.

    What is taken depends on all taken before, so the candidates of a group are folded, after a cut to the ``most`` first.
    """
    top = first_per_group(df, [group], [order, F.col(key)], most)
    held = top.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(key).alias("k"), F.col(cost).cast("long").alias("c")))).alias("l"))
    taken = F.aggregate(
        "l",
        F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("keys")),
        lambda s, x: F.when(s["used"] + x["c"] <= budget, F.struct((s["used"] + x["c"]).alias("used"), F.concat(s["keys"], F.array(x["k"].cast("long"))).alias("keys"))).otherwise(s),
        lambda s: s["keys"],
    )
    return held.select(group, F.explode(taken).alias(key))


def ranked(df: DataFrame, group: str, key: str, buckets: int = 256) -> DataFrame:
    """(group, key, _rank, _size): the rank from 1 of each row in its group by ``key``, a number that is no row's twice, and the group's size.

    A few groups may hold all rows: each is cut into ranges of the key, ranked inside them, and moved by the
    counts of the ranges before. Only those counts, ``buckets`` for each group, are summed by group.
    """
    rows = df.select(group, key)
    ends = rows.agg(F.min(key).alias("_low"), F.max(key).alias("_high"))  # one row
    place = F.least(F.floor((F.col(key) - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * buckets), F.lit(buckets - 1))
    rows = rows.crossJoin(F.broadcast(ends)).withColumn("_b", F.coalesce(place, F.lit(-1))).drop("_low", "_high")
    counts = rows.groupBy(group, "_b").agg(F.count("*").alias("_c"))
    before = W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col(group).alias("_g"), F.col("_b").alias("_at"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(W.partitionBy(group)).alias("_size"))
    inside = rows.withColumn("_k", F.row_number().over(W.partitionBy(group, "_b").orderBy(key)))
    found = inside.join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_at")))
    return found.select(group, key, (F.col("_before") + F.col("_k")).alias("_rank"), "_size")


def spread_sample(df: DataFrame, group: str, key: str, each: int = 3) -> DataFrame:
    """Of each group the first, the middle and the last ``each`` rows by ``key``; small groups whole. Keys are ranked, the other columns come to those that are left."""
    k, n = F.col("_rank"), F.col("_size")
    middle = F.floor(n / 2) - F.floor(F.lit(each) / 2)
    keep = (n <= 3 * each) | (k <= each) | (k > n - each) | ((k > middle) & (k <= middle + each))
    chosen = ranked(df, group, key).filter(keep).select(F.col(group).alias("_g"), F.col(key).alias("_key"))
    return df.join(chosen, F.col(group).eqNullSafe(F.col("_g")) & F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def versions(df: DataFrame, key: str, begin: str) -> DataFrame:
    """Adds valid_to: where the key's next version begins, null for the current one."""
    return df.withColumn("valid_to", F.lead(begin).over(W.partitionBy(key).orderBy(begin)))


def greedy_distinct(df: DataFrame, group: str, order: list[str], key: str, items: str, threshold: float, more: Sequence[str] = ()) -> DataFrame:
    """(group, key, *more) of the rows kept when each is dropped whose Jaccard similarity with a kept one is above the threshold.

    A row depends on all kept before it, so a group is folded in one row: for groups that something else bounds,
    such as a query's candidates or a conversation.
    """
    from ..functions.text import jaccard

    held = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(key).alias("k"), F.col(items).alias("i"), *[F.col(m).alias(f"m{j}") for j, m in enumerate(more)]))).alias("l"))
    kept = F.aggregate(
        "l",
        F.filter("l", lambda x: F.lit(False)),
        lambda s, x: F.when(F.exists(s, lambda y: jaccard(y["i"], x["i"]) > threshold), s).otherwise(F.concat(s, F.array(x))),
    )
    return held.select(group, F.explode(kept).alias("e")).select(group, F.col("e.k").alias(key), *[F.col(f"e.m{j}").alias(m) for j, m in enumerate(more)])
