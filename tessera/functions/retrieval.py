"""Retrieval: dense and lexical search, fusion and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .lexical import bm25 as bm25
from .vectors import cosine


def top_k(df: DataFrame, group: str, score: str, key: str, k: int) -> DataFrame:
    """Adds ``rank``; the k best of each query. Each partition keeps k before the shuffle."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), F.asc(key)))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Queries up to this many are broadcast to the vectors: at 1,024 dimensions 80 MB.
BROADCAST_PROBES = 10_000


def dense(probes: DataFrame, vectors: DataFrame, k: int, least: float | None = None, allowed: Column | None = None, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, score, rank): cosine of (query_id, probe) and (vec_id, embedding, ...), filtered before it is ranked.

    Each query is compared with every vector. Up to BROADCAST_PROBES of them are counted and broadcast; Spark
    compares more block by block.
    """
    rows = vectors if allowed is None else vectors.filter(allowed)
    probes = F.broadcast(probes) if probes.limit(BROADCAST_PROBES + 1).count() <= BROADCAST_PROBES else probes
    scored = rows.crossJoin(probes).select("query_id", "vec_id", F.round(cosine("embedding", "probe"), digits).alias("score"))
    scored = scored if least is None else scored.filter(F.col("score") >= least)
    return top_k(scored, "query_id", "score", "vec_id", k)


def fuse(a: DataFrame, b: DataFrame, key: str, k: int = 60, ranks: bool = False) -> DataFrame:
    """(query_id, key, score): sums of 1 / (k + rank) over both lists; with ``ranks`` also those, as ra and rb."""
    left, right = a.select("query_id", key, F.col("rank").alias("ra")), b.select("query_id", key, F.col("rank").alias("rb"))
    part = lambda r: F.coalesce(1 / (F.lit(k) + F.col(r)), F.lit(0.0))
    return left.join(right, ["query_id", key], "full_outer").select("query_id", key, F.round(part("ra") + part("rb"), 8).alias("score"), *(("ra", "rb") if ranks else ()))


def min_max(score: str, *group: str) -> Column:
    """Scores from 0 to 1 within a group; all equal: 1."""
    w = W.partitionBy(*group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low))


def recency(score: Column, year: Column, latest: Column, weight: float = 0.15) -> Column:
    """Blends in how recent a year is: 0.2 less for each year, 0.5 without a year; unchanged if no row has one."""
    fresh = F.when(year.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - 0.2 * (latest - year)))
    return F.when(latest.isNull(), score).otherwise((1 - weight) * score + weight * fresh)


def intent_boost(score: Column, tags: Column, preferred: Column, weight: float = 0.35) -> Column:
    """Blends in the share of preferred tags that a row has; unchanged without any."""
    n = F.size(preferred)
    return F.when(n == 0, score).otherwise((1 - weight) * score + weight * F.size(F.array_intersect(tags, preferred)) / n)
