"""What the operators of this subpackage share: tables, the shared folder, distributed ranks."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, and all runs on one machine, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: tables between steps need a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _own_folder[0], True)
    return f"file://{_own_folder[0]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: the lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: str, order: list, into: str, rows_per_bucket: int = 4_000, broadcast_rows: int = 400_000) -> DataFrame:
    """Adds ``into``: the rank from 0 of each row in its ``group``, by ``order`` (columns that make rows distinct).

    A group may hold any share of the rows: the rows of each group are cut into buckets of equal ranges of a
    digest of ``order``, ranked inside the bucket, and moved by the counts of the buckets before. Only those
    counts, one row for each group and bucket, are summed by window; they are broadcast if they are
    ``broadcast_rows`` at most. Ranks follow the digest, so they also shuffle the group. ``df`` is read twice and
    must give the same rows each time; its columns may have any names but _h, _b, _g, _c, _before and _r.
    """
    n, groups = df.select(F.count("*"), F.approx_count_distinct(group)).first()
    buckets = 1 << min(16, max(4, math.ceil(math.log2(max(1, n / rows_per_bucket)))))
    keyed = df.withColumn("_h", F.md5(F.concat_ws(" ", *[F.col(c).cast("string") for c in order]))).withColumn("_b", F.shiftright(F.conv(F.substr("_h", F.lit(1), F.lit(4)), 16, 10).cast("int"), 16 - int(math.log2(buckets))))
    counts = keyed.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    moved = counts.select(F.col(group).alias("_g"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    moved = F.broadcast(moved) if 2 * (groups + 1) * buckets <= broadcast_rows else moved
    inside = W.partitionBy(group, "_b").orderBy("_h", *order)
    out = keyed.withColumn("_r", F.row_number().over(inside) - 1)
    out = out.join(moved, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c")))
    return out.withColumn(into, F.col("_before") + F.col("_r")).drop("_h", "_b", "_g", "_c", "_before", "_r")


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns named; one that is missing is null."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).alias(n) for n in names])
