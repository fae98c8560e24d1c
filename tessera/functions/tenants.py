"""Settings and prompts of many tenants at once: a table of JSON texts over typed defaults, and prompts by layer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Setting:
    """Where a setting stands in a tenant's JSON, its type in SQL, and what holds without one. ``model``: its value must be one of the models that are known."""

    path: str
    kind: str
    default: object
    model: bool = False

    @property
    def name(self) -> str:
        return self.path.removeprefix("$.").replace(".", "_")


SETTINGS = (
    Setting("$.display_name", "string", ""), Setting("$.active_modules", "array<string>", ["core"]), Setting("$.feature_flags.structured_query", "boolean", False), Setting("$.feature_flags.enrichment", "boolean", False),
    Setting("$.ai_models.query_model", "string", "small-1", True), Setting("$.ai_models.enrichment_model", "string", "large-1", True), Setting("$.ai_models.monthly_query_cap_usd", "double", 150.0),
    Setting("$.ai_models.daily_enrichment_cap_usd", "double", 10.0), Setting("$.branding.primary_color", "string", "#1a73e8"),
)


def resolved(df: DataFrame, key: str, text: str, models: Sequence[str], settings: Sequence[Setting] = SETTINGS) -> DataFrame:
    """(key, a column for each setting, error) of each tenant's JSON.

    Keys that aren't known are passed over, settings that aren't given have their defaults. A text that is no JSON object, a
    value of another type (null too) and a model that isn't in ``models`` are told in ``error``, the first of them by the order of
    ``settings``; such a tenant has all defaults. A null text is a tenant without settings, not an error. Texts are parsed once.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.try_parse_json(F.col(text)).alias("_v"))
    given = lambda s: F.try_variant_get("_v", s.path, "variant")
    error = F.when(F.col("_text").isNull(), F.lit(None).cast("string")).when(F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT"), "no JSON object")
    for s in settings:
        own = F.try_variant_get("_v", s.path, s.kind)
        error = error.when(given(s).isNotNull() & own.isNull(), f"{s.name} is no {s.kind}")
        if s.model:
            error = error.when(~own.isin(list(models)), F.concat(F.lit(f"{s.name}: no model named "), own))
    rows = rows.withColumn("_error", error)

    def value(s: Setting) -> Column:
        default = F.array(*[F.lit(x) for x in s.default]) if isinstance(s.default, list) else F.lit(s.default)
        return F.coalesce(F.when(F.col("_error").isNull(), F.try_variant_get("_v", s.path, s.kind)), default.cast(s.kind)).alias(s.name)

    return rows.select(F.col("_key").alias(key), *[value(s) for s in settings], F.col("_error").alias("error"))


LAYERS = ("tenant", "module", "core")


def prompts(asked: DataFrame, stored: DataFrame, layers: Mapping[str, str | None]) -> DataFrame:
    """The rows of ``asked`` with ``prompt`` and ``layer``: the first layer that has a prompt of its ``name``.

    ``stored``: (layer, owner, name, prompt). ``layers``: for each layer, in order, the column of ``asked`` that names the owner, or None
    for one that belongs to all. Of a prompt stored twice the least text counts; a name that no layer has gets nulls.
    """
    out, names = asked, asked.columns
    found: list[tuple[str, Column]] = []
    for i, (layer, owner) in enumerate(layers.items()):
        mine = stored.filter(F.col("layer") == layer).groupBy(F.col("owner").cast("string").alias(f"_o{i}"), F.col("name").alias(f"_n{i}")).agg(F.min("prompt").alias(f"_p{i}"))
        same = F.col("name") == F.col(f"_n{i}")
        if owner is None:
            mine = mine.groupBy(f"_n{i}").agg(F.min(f"_p{i}").alias(f"_p{i}"))
        else:
            same &= F.col(owner).cast("string") == F.col(f"_o{i}")
        out = out.join(mine, same, "left")
        found.append((layer, F.col(f"_p{i}")))
    prompt = F.coalesce(*[p for _, p in found])
    layer = F.coalesce(*[F.when(p.isNotNull(), name) for name, p in found])
    return out.select(*[F.col(f"`{n}`") for n in names], prompt.alias("prompt"), layer.alias("layer"))
