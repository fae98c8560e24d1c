"""SQL templates: checks before they run, and named parameters."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import NAMES, Tables

# fixed values: words that generated SQL may not have
FORBIDDEN = "INSERT UPDATE DELETE DROP TRUNCATE ALTER CREATE REPLACE MERGE EXEC EXECUTE GRANT REVOKE".split()


class Refused(ValueError):
    """A statement that may not run; ``kind``: syntax, statement, relation, function, limit or formatting."""

    def __init__(self, kind: str, why: str) -> None:
        super().__init__(why)
        self.kind = kind


#: What a query's parsed plan may consist of. Commands, scripts, table functions and whatever else there is are not in it.
QUERY = {
    "Project", "Filter", "Join", "LateralJoin", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except", "Intersect", "SubqueryAlias", "OneRowRelation", "LocalRelation",
    "UnresolvedRelation", "UnresolvedHaving", "UnresolvedWith", "UnresolvedInlineTable", "UnresolvedSubqueryColumnAliases", "WithWindowDefinition", "Pivot", "Unpivot", "Generate", "Sample",
}
#: Functions that reach out of the query.
OUTSIDE = {"reflect", "java_method", "try_reflect"}


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def parsed(spark: SparkSession, sql: str):
    """The plan that Spark's parser makes of one statement; nothing is looked up or run."""
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise Refused("syntax", f"no single statement: {str(e).strip().splitlines()[0]}") from e


def relations(plan, known: frozenset[str] = frozenset()) -> set[str]:
    """The names of the relations that a query reads, without its own WITH names; a Refused for what is no query."""
    kind, found = _kind(plan), set()
    if kind not in QUERY:
        raise Refused("statement", f"only SELECT is allowed, not {kind}")
    if kind == "UnresolvedRelation":
        name = ".".join(_list(plan.multipartIdentifier())).lower()
        return set() if name in known else {name}
    if kind == "UnresolvedWith":
        for relation in _list(plan.cteRelations()):  # a later one may use those before it
            found |= relations(relation._2(), known)
            known |= {relation._1().lower()}
    for expression in _list(plan.expressions()):
        found |= _in_expression(expression, known)
    for child in _list(plan.children()):
        found |= relations(child, known)
    return found


def _in_expression(expression, known: frozenset[str]) -> set[str]:
    found, kind = set(), _kind(expression)
    if kind == "UnresolvedFunction" and (name := _list(expression.nameParts())[-1].lower()) in OUTSIDE:
        raise Refused("function", f"{name} is not allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "InSubquery"):
        found |= relations(expression.query().plan() if kind == "InSubquery" else expression.plan(), known)
    for child in _list(expression.children()):
        found |= _in_expression(child, known)
    return found


def inspect(spark: SparkSession, sql: str, allowed: Iterable[str] | None = None, limited: bool = False) -> set[str]:
    """The relations that ``sql`` reads; a Refused unless it is one query over relations on the list (None: any), with a LIMIT on top if ``limited``."""
    plan = parsed(spark, sql)
    names = relations(plan)
    if allowed is not None and (foreign := sorted(names - {x.lower() for x in allowed})):
        raise Refused("relation", f"{foreign[0]} is not allowed")
    top = plan.child() if _kind(plan) == "UnresolvedWith" else plan
    if limited and _kind(top) not in ("GlobalLimit", "LocalLimit"):
        raise Refused("limit", "a template needs a LIMIT")
    return names


def guard(sql: str, allowed: Iterable[str] | None = None) -> None:
    """Generated SQL: one SELECT, none of the forbidden words, and no relation but those on the list."""
    if not re.match(r"\s*select\b", sql, re.IGNORECASE):
        raise Refused("statement", "only SELECT is allowed")
    if found := re.search(r"\b(" + "|".join(FORBIDDEN) + r")\b", sql, re.IGNORECASE):
        raise Refused("statement", f"{found[1].upper()} is not allowed")
    inspect(SparkSession.active(), sql, allowed)


def refusal(sql: Column, template: bool = False) -> Column:
    """Why a statement in a column is refused, null if it is not: the rules of guard(), and for templates those of validate()."""
    words = "|".join(FORBIDDEN)
    why = F.when(~sql.rlike(r"(?i)^\s*select\b"), "only SELECT is allowed").when(sql.rlike(rf"(?i)\b({words})\b"), F.concat(F.upper(F.regexp_extract(sql, rf"(?i)\b({words})\b", 1)), F.lit(" is not allowed")))
    if template:
        why = why.when(~sql.rlike(r"(?i)\blimit\b"), "a template needs a LIMIT").when(sql.rlike(r"\{\w*\}|%s|%\("), "values belong in named parameters")
    return why


def validate(sql: str, allowed: Iterable[str] | None = None) -> None:
    """A template: guarded, with a LIMIT on top, and without text put in by formatting."""
    if re.search(r"\{\w*\}|%s|%\(", sql):
        raise Refused("formatting", "values belong in named parameters")
    guard(sql, allowed)
    inspect(SparkSession.active(), sql, allowed, limited=True)


def run_generated(tables: Tables, sql: str, allowed: Iterable[str], cap: int = 200) -> DataFrame:
    """SQL that a model wrote, over tables of the catalog that are on the list: guarded, and at most ``cap`` rows whatever it asks for."""
    guard(sql, allowed)
    names = inspect(tables.spark, sql, allowed)
    return tables.spark.sql(_named(sql, names), **{n: getattr(tables, n) for n in names}).limit(cap)


def _named(sql: str, names: Iterable[str]) -> str:
    """The relations as names of DataFrames to be filled in."""
    return re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(sorted(names)) + r")\b", lambda m: f"{m[1]} {{{m[2].lower()}}}", sql, flags=re.IGNORECASE) if names else sql


def run_template(tables: Tables, sql: str, values: dict) -> DataFrame:
    """The template over the tables that it names."""
    validate(sql, NAMES)
    names = inspect(tables.spark, sql)
    return tables.spark.sql(_named(sql, names), args=values, **{n: getattr(tables, n) for n in names})
