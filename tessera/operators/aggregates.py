"""Aggregates that are more than one function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def weighted(score: Column, weight: Column) -> Column:
    """The weighted mean, 0 without weight."""
    return F.coalesce(F.sum(score * weight) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.0))


def index_percentiles(df: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """Values at the places int(p n) of the sorted values (n - 1 at most), counted from 0, for each group.

    Equal values are counted first, so what is ranked are distinct values, however many rows a group has.
    """
    counted = df.groupBy(group, value).agg(F.count("*").alias("_n"))
    whole = W.partitionBy(group)
    upto = whole.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    placed = counted.withColumn("_end", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(whole))
    place = lambda p: F.least(F.floor(F.col("_all") * F.lit(p)), F.col("_all") - 1)
    holds = lambda p: (F.col("_end") > place(p)) & (F.col("_end") - F.col("_n") <= place(p))
    return placed.groupBy(group).agg(*[F.max(F.when(holds(p), F.col(value))).alias(name) for name, p in points.items()])


def numeric_totals(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(name, total) of each column: cells that read as numbers once , and $ are gone; all-text and all-year columns are left out."""
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in [key, *columns]]).unpivot([key], columns, "name", "cell")
    number = cells.select("name", F.regexp_replace("cell", "[,$]", "").try_cast("double").alias("v"))
    out = number.filter("v is not null").groupBy("name").agg(F.sum("v").alias("total"), F.bool_and(F.col("v").between(1900, 2100)).alias("years"))
    return out.filter("not years").select("name", F.round("total", 2).alias("total"))


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, place, mean): the mean of each element over a group's vectors; sums move, not vectors."""
    return df.select(group, F.posexplode(vector).alias("place", "v")).groupBy(group, "place").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def first_seen(df: DataFrame, group: str, value: str, order: list[str], n: int) -> DataFrame:
    """(group, firsts): the first n distinct values of each group in order of first sight, joined by ', '; none: N/A."""
    seen = df.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(group, value).agg(F.min(F.struct(*order)).alias("_o"))
    top = seen.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy("_o", value))).filter(F.col("_k") <= n)
    listed = top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", value))), lambda x: x[value]), ", ").alias("firsts"))
    return df.select(group).distinct().join(listed, group, "left").withColumn("firsts", F.coalesce("firsts", F.lit("N/A")))


def mode(df: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """(group, value): the commonest value of each group; ties: the one first seen."""
    counted = df.groupBy(group, value).agg(F.count("*").alias("_n"), F.min(position).alias("_p"))
    best = counted.groupBy(group).agg(F.max_by(value, F.struct("_n", -F.col("_p"))).alias(value))
    return best
