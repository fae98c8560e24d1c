"""Decision rules as Columns: routing, conflicts, guardrails, names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .text import any_of, phonetic


def trigger_confidence(matched: Column, phrases: Column) -> Column:
    """0.7 for one trigger phrase, up to 1.0 for all; 0 for none."""
    more = F.least((matched - 1) / F.greatest(phrases - 1, F.lit(1)) * 0.3, F.lit(0.3))
    return F.when(matched > 0, 0.7 + more).otherwise(0.0)


def column_confidence(quantitative: Column, column: Column, table: Column) -> Column:
    """0.5 for a quantitative word, 0.25 more for a column's name, 0.1 more for the table's with a column's; nothing without the first."""
    return F.when(quantitative, 0.5 + F.when(column, 0.25 + F.when(table, 0.10).otherwise(0.0)).otherwise(0.0)).otherwise(0.0)


def route(confidence: Column, floor: float = 0.4, enough: float = 0.6) -> Column:
    return F.when(confidence >= enough, "SQL").when((F.lit(floor) > 0) & (confidence >= floor), "REVIEW").otherwise("RAG")


def action(overall: Column, cited: Column, threshold: int = 40, with_results: Column | None = None) -> Column:
    """(confidence, action): an answer without citations is capped at 50, one without results at 30."""
    capped = F.when(cited, overall).when(F.lit(True) if with_results is None else with_results, F.least(overall, F.lit(50))).otherwise(F.least(overall, F.lit(30)))
    return F.struct(capped.alias("confidence"), F.when(capped >= threshold, "CITE").otherwise("ROUTE").alias("action"))


def confidence(retrieval: Column, coverage: Column, llm: Column, results: Column) -> Column:
    """Three tenths of retrieval, four of coverage (both 0 to 1), three of the model's own (0 to 100), whole, within 0 and 100."""
    raw = (30 * retrieval + 40 * coverage + 30 * llm / 100).cast("int")
    return F.when(results == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), raw)))


#: The namespaces where the path decides, and where the model or a keyword may.
PATH_NAMESPACES, MODEL_NAMESPACES, KEYWORD_NAMESPACES = ("client", "year", "stage"), ("doctype", "topic", "entity"), ("doctype", "topic", "entity", "stage")


def winner(namespace: Column, by_path: Column, by_model: Column, sure: Column, threshold: float = 0.7) -> Column:
    """Which of two tags of one namespace stays: path or llm."""
    model = namespace.isin(*MODEL_NAMESPACES) & (sure >= threshold)
    return F.when(by_path.isNull(), "llm").when(by_model.isNull() | (by_path == by_model), "path").when(model, "llm").otherwise("path")


def keyword_winner(namespace: Column) -> Column:
    return F.when(namespace.isin(*KEYWORD_NAMESPACES), "keyword").otherwise("path")


def max_tags(df: DataFrame, doc: str, budget: int, manual: str, rank: str, sure: str, place: str) -> DataFrame:
    """Adds ``kept``: manual tags use up the budget first, then path tags in order, then model tags by confidence."""
    order = F.row_number().over(W.partitionBy(doc).orderBy(F.col(rank), F.when(F.col(rank) > 0, -F.col(sure)), F.col(place)))
    return df.withColumn("kept", order <= F.greatest(F.lit(0), F.lit(budget) - F.col(manual)))


def decision(sure: Column, suggest_at: float, approval: Column) -> Column:
    return F.when(sure < suggest_at, "discard").when(approval, "suggest").otherwise("apply")


def cardinality(n: Column, most: Column) -> Column:
    return F.when(n >= most, "reject").when(n >= most * 0.8, "warn").otherwise("ok")


def matched(text: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns the text matches."""
    return reduce(Column.__add__, [text.rlike(p).cast("int") for p in patterns], F.lit(0))


def intents(text: Column, patterns: dict[str, str]) -> Column:
    """The labels whose pattern the text matches, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), label) for label, p in patterns.items()]))


#: Words of company names that don't tell companies apart.
SUFFIXES = (
    r"\bhoa\b", r"\bhomeowners association\b", r"\bhomeowner'?s association\b", r"\bcommunity association\b", r"\bcondo association\b",
    r"\bcondominium association\b", r"\bproperty owners association\b", r"\bpoa\b", r"\binc\.?\b", r"\bllc\.?\b", r"\bltd\.?\b", r"\bcorp\.?\b",
    r"\bassociation\b", r"\bassoc\.?\b", r"\bproperties\b", r"\bproperty\b", r"\bestate[s]?\b", r"\bvillage[s]?\b", r"\bcommons\b", r"\bcommon\b",
    r"\bmanagement\b", r"\bmgmt\.?\b",
)


def normal_name(name: Column) -> Column:
    """Lower case, blanks don't repeat. (Accents stay; take them off before.)"""
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")


def without_suffix(name: Column) -> Column:
    bare = reduce(lambda c, p: F.regexp_replace(c, p, ""), SUFFIXES, normal_name(name))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), ",+$", ""))


def sound_likeness(a: Column, b: Column) -> Column:
    """The share of places where the sound codes agree."""
    x, y = phonetic(a), phonetic(b)
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.lit(0.0), lambda s, i: s + F.when(F.substring(x, i, F.lit(1)) == F.substring(y, i, F.lit(1)), 1.0).otherwise(0.0)) / 4


def complex_question(text: Column, signals: Sequence[str]) -> Column:
    return F.when(any_of(F.lower(text), signals), "complex").otherwise("simple")


def sanitize_score(x: Column) -> Column:
    """Null for null, NaN, infinite and far outside [0, 1]; slightly outside is clipped."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < -0.05) | (x > 1.05)
    return F.when(bad, None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def year_range(text: Column) -> Column:
    """Two digits as 20YY-20YY+1; else null."""
    n = F.when(text.rlike("^[0-9]{1,2}$"), text.cast("int"))
    return F.when(n.isNotNull(), F.format_string("%d-%d", 2000 + n, 2001 + n))
