"""Changes of tables, as functions from the old rows to the new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def all_text(df: DataFrame) -> DataFrame:
    """Every column as text; nulls become 'nan', as a frame writer has them."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in df.columns])


def replace_table(df: DataFrame, name: str) -> DataFrame:
    """Drop and create the table; what is read back."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of the table, and the last change of each key in place of its row."""
    last = changes.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")
    return table.join(last, keys, "left_anti").unionByName(last)


def replace_where(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``new`` go, then ``new`` comes."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_json(table: DataFrame, column: str, path: str, value: str) -> DataFrame:
    return table.filter(~F.coalesce(F.get_json_object(column, path) == value, F.lit(False)))


def purge(table: DataFrame, at: str, before: Column) -> DataFrame:
    """Rows older than the cutoff go; rows without a time stay."""
    return table.filter(F.col(at).isNull() | (F.col(at) >= before))


def soft_delete(table: DataFrame, which: Column, at: Column) -> DataFrame:
    return table.withColumn("deleted_at", F.when(which & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at")))


def null_out(table: DataFrame, columns: list[str], which: Column) -> DataFrame:
    """The columns become null where the row is due; the rows stay."""
    return table.withColumns({c: F.when(which, None).otherwise(F.col(c)) for c in columns})
