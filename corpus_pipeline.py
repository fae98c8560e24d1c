"""The corpus pipeline: stages that each call one operator of tessera.llm.

language: documents that are in no language go (no letter, or a score below LANGUAGE_SCORE).
near_duplicates: of each class of near-duplicates the document with the least doc_id stays.
repeats: words in windows that start in a document with a smaller doc_id go; so do documents without any word left.
mixing: rows are put in the order of the mix, in which no source is a block or more off its target weight. Written, each
file is a run of the mix, and files are numbered along it.
packing: the pieces of all documents, each with its sequence and its place there. Each file of the mix is packed on its
own, and sequences are numbered along the mix, so whoever reads them in order reads sources at their target weights.

Nulls, empty texts, repeated rows, empty tables and columns of other names than documents has: a document with a null or
letterless text is rejected by the first stage. Of rows that are the same one stays, in the second. A null doc_id, lang,
source or n_chars is a value like any other. An empty table stays empty in each stage. Other columns are dropped. Texts of
any length are read whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, language, mixing, neardup, packing, repeats

LANGUAGE_SCORE = 0.05
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(*COLUMNS)
    found = language.identify(rows, rows.select("doc_id", "text", "lang"), keep=COLUMNS)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs.select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(docs, keep=("lang", "source"), verbatim=True)
    left = found.filter((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0)).withColumnRenamed("kept", "text")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS)).orderBy("slot", "place").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    try:
        rows = docs.select("doc_id", "text", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long").alias("run"))
    except AnalysisException:  # not read from files: one run
        rows = docs.select("doc_id", "text", F.lit(0).alias("run"))
    return packing.pack(rows, window="run")


STAGES = [("language", by_language), ("near_duplicates", without_near_duplicates), ("repeats", without_repeats), ("mixing", mixed), ("packing", packed)]
#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
