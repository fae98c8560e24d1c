"""Predicates and projections as Columns, and filters that compose them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compose(df: DataFrame, *tests: Column | None) -> DataFrame:
    """All tests that are given; None is no test."""
    return reduce(DataFrame.filter, [t for t in tests if t is not None], df)


def equals(column: str, value: object) -> Column | None:
    return None if value is None else F.col(column) == F.lit(value)


def contains_any_ci(text: str, *columns: str) -> Column:
    """LIKE %text% on any of the columns, without case; % and _ in the text stay wildcards."""
    return reduce(Column.__or__, [F.lower(c).like(f"%{text.lower()}%") for c in columns])


def tags_array(*columns: str) -> Column:
    return F.array_compact(F.array(*columns))


def public_or_any(tags: Column, user_tags: Sequence[str] | None) -> Column:
    """A row is seen if it is public or shares a tag with the user. None: no check; none: public rows only."""
    if user_tags is None:
        return F.lit(True)
    own = F.array(*[F.lit(t) for t in user_tags]) if user_tags else F.array().cast("array<string>")
    return F.coalesce(F.array_contains(tags, "public"), F.lit(False)) | F.coalesce(F.arrays_overlap(tags, own), F.lit(False))


def all_required(required: Column, user_tags: Column | None) -> Column:
    """Each required tag is the user's; nothing required: all may; no user tags given (None): no check."""
    if user_tags is None:
        return F.lit(True)
    return F.size(F.array_except(required, user_tags)) == 0


def any_overlap(required: Column, user_tags: Column) -> Column:
    return (F.size(required) == 0) | F.coalesce(F.arrays_overlap(required, user_tags), F.lit(False))


def bucket(value: Column, edges: Sequence[tuple[float, str]], other: str | None) -> Column:
    """The name of the first edge that the value does not exceed."""
    ladder = None
    for edge, name in edges:
        ladder = F.when(value <= edge, name) if ladder is None else ladder.when(value <= edge, name)
    return ladder.otherwise(F.lit(other))


def visible(df: DataFrame, is_admin: bool, status: str, approved: str, fields: str) -> DataFrame:
    """Admins see all; others only approved rows, with an empty field list."""
    if is_admin:
        return df
    return df.filter(F.col(status) == approved).withColumn(fields, F.array().cast(df.schema[fields].dataType))
