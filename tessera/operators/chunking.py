"""Chunks of texts, sections of rows, names of tables and form fields."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import words

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that serves; neighbours share up to ``overlap``."""
    if len(text) <= size:
        return [text] if text.strip() else []
    mark = next((s for s in separators if s in text), "")
    finer = separators[separators.index(mark) + 1 :] if mark else ()
    parts = text.split(mark) if mark else [text[i : i + size] for i in range(0, len(text), max(1, size - overlap))]
    if not mark:
        return parts
    out: list[str] = []
    held: list[str] = []
    length = 0

    def flush() -> None:
        if joined := mark.join(held).strip():
            out.append(joined)

    for part in parts:
        if len(part) > size:
            flush()
            held, length = [], 0
            out += split_text(part, size, overlap, finer or ("",))
            continue
        if held and length + len(mark) + len(part) > size:
            flush()
            while held and (length > overlap or length + len(mark) + len(part) > size):
                length -= len(held.pop(0)) + (len(mark) if held else 0)
        length += len(part) + (len(mark) if held else 0)
        held.append(part)
    flush()
    return out


def recursive(df: DataFrame, key: str, text: str, size: int = 512, overlap: int = 80) -> DataFrame:
    """(key, chunk_index, chunk) of each text."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, c) for k, x in zip(frame[key], frame[text].fillna(""), strict=True) for i, c in enumerate(split_text(x, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk"])

    return df.select(key, text).mapInPandas(split, f"{key} long, chunk_index int, chunk string")


def sliding(df: DataFrame, key: str, text: str, size: int, overlap: int | None = None) -> DataFrame:
    """(key, chunk_index, start, n_words) of windows of words that overlap by a quarter."""
    step = size - (size // 4 if overlap is None else overlap)
    n = F.size(words(text))
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
    rows = df.select(key, n.alias("n"), last.alias("last")).filter("n > 0").select(key, "n", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return rows.select(key, "chunk_index", start.alias("start"), F.least(F.lit(size), F.col("n") - start).alias("n_words"))


def line_pack(text: Column, most: int) -> Column:
    """Whole lines packed into chunks of at most so many characters; a longer line is a chunk of its own."""
    packed = F.aggregate(
        F.split(text, "\n"),
        F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open")),
        lambda s, x: F.when(s["open"].isNull(), F.struct(s["done"].alias("done"), x.alias("open")))
        .when(F.length(s["open"]) + 1 + F.length(x) <= most, F.struct(s["done"].alias("done"), F.concat(s["open"], F.lit("\n"), x).alias("open")))
        .otherwise(F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), x.alias("open"))),
    )
    return F.when(packed["open"].isNull(), packed["done"]).otherwise(F.concat(packed["done"], F.array(packed["open"])))


def sections(lines: DataFrame, key: str, place: str, header: Column, least: int = 2) -> DataFrame:
    """(key, section, begin, n) of runs of lines that start at header lines; shorter ones are dropped."""
    upto = W.partitionBy(key).orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.sum(header.cast("long")).over(upto)).filter("section > 0")
    return rows.groupBy(key, "section").agg(F.min(place).alias("begin"), F.count("*").alias("n")).filter(F.col("n") >= least)


def humanized(field: Column) -> Column:
    """A form field's label: what follows the first underscore, with blanks between words."""
    bare = F.regexp_replace(field, "^[^_]*_", "")
    return F.replace(F.regexp_replace(bare, "([a-z])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" "))


def first_match(text: Column, patterns: list[tuple[str, str]], other: str) -> Column:
    """The name of the first pattern that matches."""
    out = F.lit(other)
    for name, pattern in reversed(patterns):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def shortened(df: DataFrame, name: str, order: str, most: int = 63) -> DataFrame:
    """Adds ``short``: names cut to ``most`` characters; later ones of equal ones get _n."""
    cut = F.substring(name, 1, most)
    n = F.row_number().over(W.partitionBy("_cut").orderBy(order))
    rows = df.withColumn("_cut", cut).withColumn("_n", n)
    tail = F.concat(F.lit("_"), (F.col("_n") - 1).cast("string"))
    return rows.withColumn("short", F.when(F.col("_n") == 1, F.col("_cut")).otherwise(F.concat(F.substring("_cut", F.lit(1), F.lit(most) - F.length(tail)), tail))).drop("_cut", "_n")


def value_samples(df: DataFrame, key: str, columns: list[str], most: int = 200, n: int = 50) -> DataFrame:
    """(name, value) of each column with at most ``most`` distinct values: the first ``n`` values in order of their first row."""
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in columns], F.col(key).alias("_k")).unpivot(["_k"], columns, "name", "value").filter("value is not null")
    seen = cells.groupBy("name", F.lower(F.trim("value")).alias("value")).agg(F.min("_k").alias("_k"))
    few = seen.groupBy("name").agg(F.count("*").alias("d")).filter(F.col("d") <= most).select("name")
    top = F.row_number().over(W.partitionBy("name").orderBy("_k", "value"))
    return seen.join(few, "name").withColumn("_r", top).filter(F.col("_r") <= n).select("name", "value")
