"""Settings, strategies and prompts: small maps on the driver."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lookup(key: str, stored: Mapping[str, str], environment: Mapping[str, str], default: str | None = None) -> str | None:
    """A setting: what is stored, else the environment's (upper case), else the default."""
    return stored.get(key, environment.get(key.upper(), default))


@dataclass(frozen=True)
class Tenant:
    tenant_id: str = "default"
    row_cap: int = 100
    daily_cap: float = 10.0
    models: tuple[str, ...] = field(default_factory=tuple)


def tenant(text: str, known_models: Sequence[str]) -> Tenant:
    """Defaults with a tenant's JSON over them; keys that aren't known are passed over, models must be."""
    given = json.loads(text)
    names = {f.name for f in fields(Tenant)}
    out = replace(Tenant(), **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in names})
    if unknown := [m for m in out.models if m not in known_models]:
        raise ValueError(f"models that aren't known: {unknown}")
    return out


def first_prompt(name: str, *layers: Mapping[str, str]) -> str:
    """From the tenant, the module or the core, in this order."""
    for layer in layers:
        if name in layer:
            return layer[name]
    raise KeyError(name)


@dataclass(frozen=True)
class PathRule:
    namespace: str
    level: int
    pattern: str | None = None
    group: int = 1
    mapping: Mapping[str, str] = field(default_factory=dict)
    transform: str | None = None
    parent: str | None = None


@dataclass(frozen=True)
class KeywordRule:
    namespace: str
    value: str
    any_of: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    priority: int = 1
    case_sensitive: bool = False


@dataclass(frozen=True)
class MailPattern:
    pattern: str
    tags: tuple[tuple[str, str], ...]


#: Keywords may set these namespaces, others are the path's alone.
OVERRIDEABLE = ("doctype", "topic", "entity", "stage")
_ID = re.compile("[a-z][a-z0-9_]*")


@dataclass(frozen=True)
class Strategy:
    """Rules that tag documents, as Columns over a path and a text."""

    namespaces: tuple[str, ...]
    path_rules: tuple[PathRule, ...] = ()
    keyword_rules: tuple[KeywordRule, ...] = ()
    email_patterns: tuple[MailPattern, ...] = ()
    document_types: tuple[str, ...] = ("unknown",)
    path_offset: int = 0

    @staticmethod
    def load(text: str) -> Strategy:
        """A strategy in JSON; what would make a rule useless or ambiguous is a ValueError."""
        raw = json.loads(text)
        out = Strategy(
            tuple(raw["namespaces"]),
            tuple(PathRule(**r) for r in raw.get("path_rules", [])),
            tuple(KeywordRule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}) for r in raw.get("keyword_rules", [])),
            tuple(MailPattern(r["pattern"], tuple((x["namespace"], x["value"]) for x in r["tags"])) for r in raw.get("email_patterns", [])),
            tuple(raw.get("document_types", ("unknown",))),
            raw.get("path_offset", 0),
        )
        out.check()
        return out

    def check(self) -> None:
        for kind, ids, most in (("namespace", self.namespaces, 20), ("document type", self.document_types, 30)):
            if wrong := [x for x in ids if len(x) > most or not _ID.fullmatch(x)]:
                raise ValueError(f"{kind} ids of more than {most} characters or with other signs than a-z, 0-9 and _: {wrong}")
        if "unknown" not in self.document_types:
            raise ValueError("document types need an entry for what is unknown")
        used = [r.namespace for r in (*self.path_rules, *self.keyword_rules)] + [n for m in self.email_patterns for n, _ in m.tags]
        if missing := [n for n in used if n not in self.namespaces]:
            raise ValueError(f"{missing[0]} is no namespace of the strategy")
        for r in self.path_rules:
            if not isinstance(r.level, int) or r.level < 0:
                raise ValueError(f"a path rule of level {r.level}")
        for r in self.keyword_rules:
            if r.priority < 1 or not (r.any_of or r.all_of) or r.namespace not in OVERRIDEABLE:
                raise ValueError(f"a keyword rule needs keywords, a priority from 1 up and one of {OVERRIDEABLE}: {r}")

    def rules(self, spark: SparkSession) -> DataFrame:
        """The rules as a table for operators.tagging, in the strategy's order."""
        from ..operators.tagging import RULES

        rows: list[tuple] = []

        def add(source: str, namespace: str, value: str | None = None, level: int | None = None, folder: str | None = None, pattern: str | None = None, capture: int | None = None, transform: str | None = None, parent: str | None = None, any_of: tuple = (), all_of: tuple = (), case: bool | None = None, priority: int | None = None) -> None:
            rows.append((len(rows), source, namespace, value, level, folder, pattern, capture, transform, parent, list(any_of), list(all_of), case, priority))

        for r in self.path_rules:
            if r.mapping:
                for folder, value in r.mapping.items():
                    add("path", r.namespace, value, r.level, folder, parent=r.parent)
            else:
                add("path", r.namespace, None, r.level, None, r.pattern, r.group, r.transform, r.parent)
        for k in self.keyword_rules:
            add("keyword", k.namespace, k.value, any_of=k.any_of, all_of=k.all_of, case=k.case_sensitive, priority=k.priority)
        for m in self.email_patterns:
            for namespace, value in m.tags:
                add("email", namespace, value, pattern=m.pattern)
        return spark.createDataFrame(rows, RULES)

    def path_tags(self, path: Column) -> Column:
        parts = F.split(path, "/")
        tags = []
        for r in self.path_rules:
            found = F.regexp_extract(F.coalesce(F.get(parts, F.lit(r.level)), F.lit("")), r.pattern or "(.+)", r.group)
            value = F.coalesce(F.create_map(*[F.lit(x) for kv in r.mapping.items() for x in kv])[found], found) if r.mapping else found
            tags.append(F.when(found != "", F.concat(F.lit(f"{r.namespace}:"), value)))
        return F.array_distinct(F.array_compact(F.array(*tags))) if tags else F.array().cast("array<string>")

    def keyword_tags(self, text: Column) -> Column:
        """Of each namespace the tag of the first rule by priority."""
        low, tags = F.lower(text), []
        for namespace in dict.fromkeys(r.namespace for r in self.keyword_rules):
            best = F.lit(None).cast("string")
            for r in sorted((r for r in self.keyword_rules if r.namespace == namespace), key=lambda r: r.priority):
                fits = F.lit(True)
                if r.any_of:
                    fits = F.exists(F.array(*[F.lit(x.lower()) for x in r.any_of]), lambda w: low.contains(w))
                for x in r.all_of:
                    fits = fits & low.contains(x.lower())
                best = F.when(fits, f"{namespace}:{r.value}").otherwise(best)
            tags.append(best)
        return F.array_compact(F.array(*tags)) if tags else F.array().cast("array<string>")


def claim(status: Column, lease: Column, now: Column) -> Column:
    """The state after a worker asks for an item: pending ones, and running ones whose lease is over, are claimed."""
    return F.when((status == "pending") | ((status == "running") & (lease < now)), "running").otherwise(status)


def budgeted(samples: Mapping[str, Sequence[str]], question: str, columns: int = 20, values: int = 20, least: int = 5, tokens: int = 500) -> dict[str, list[str]]:
    """Samples of columns that fit a prompt: columns that the question names first; fewer values as long as they don't fit."""
    asked = question.lower()
    order = sorted(samples, key=lambda c: (c.lower().replace("_", " ") not in asked, list(samples).index(c)))[:columns]
    n = values
    while True:
        out = {c: list(samples[c])[:n] for c in order}
        if n <= least or sum(len(c) + sum(map(len, v)) for c, v in out.items()) <= tokens * 4:
            return out
        n -= 1


def column_signals(table: str, types: Mapping[str, str]) -> dict[str, list[str]]:
    """Words that stand for each column, for the table, and the columns that hold quantities."""
    out = {c: [c.lower().replace("_", " ")] for c in types}
    out["__table__"] = [w for w in table.lower().split("_") if w]
    out["__quantitative__"] = [c for c, kind in types.items() if kind in ("int", "bigint", "double", "float") or kind.startswith("decimal")]
    return out
