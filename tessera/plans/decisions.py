"""Routing, rules and conflicts."""

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import tokens
from ..operators import joins as jn
from .registry import query
from .text import ASKED_SQL, asked

#: (template, trigger phrases, column words, table words)
TEMPLATES = (("limits", ("policy limit", "current policy"), ("limit",), ("policy",)), ("expiring", ("expiring", "renewals", "next"), ("expir",), ("certificates",)), ("losses", ("loss run", "claims history"), ("claims",), ("loss",)))
QUANTITATIVE = ("how many", "total", "next", "number", "trend")
_HITS = {name: " + ".join(f"contains(lower(q), '{p}')::INT" for p in phrases) for name, phrases, _, _ in TEMPLATES}
_TRIGGER = " UNION ALL ".join(
    f"SELECT conv_id, turn, {i} AS pos, '{name}' AS name, {_HITS[name]} AS m, {len(phrases)} AS n FROM {ASKED_SQL}" for i, (name, phrases, _, _) in enumerate(TEMPLATES)
)
_CONF = f"SELECT conv_id, turn, pos, name, CASE WHEN m > 0 THEN 0.7 + least((m - 1) / greatest(n - 1, 1) * 0.3, 0.3) ELSE 0 END AS confidence FROM ({_TRIGGER})"


def _best(scored):
    """The surest template of each question (struct array), ties to the first."""
    order = F.array_sort(F.transform(scored, lambda x: F.struct((-F.round(x["confidence"], 6)).alias("n"), x["pos"].alias("pos"), x["name"].alias("name"))))
    return order[0]


def _triggers(q):
    low = F.lower(q)
    hits = lambda phrases: sum((low.contains(p).cast("int") for p in phrases), F.lit(0))
    return F.array(*[F.struct(rules.trigger_confidence(hits(p), F.lit(len(p))).alias("confidence"), F.lit(i).alias("pos"), F.lit(n).alias("name")) for i, (n, p, _, _) in enumerate(TEMPLATES)])


@query("route_trigger_score", f"SELECT conv_id, turn, name, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(confidence, 6) DESC, pos) AS k FROM ({_CONF}) WHERE confidence > 0) WHERE k = 1")
def route_trigger_score(t):
    best = _best(_triggers(F.col("q")))
    rows = asked(t).select("conv_id", "turn", best.alias("b"))
    return rows.filter("b.n < 0").select("conv_id", "turn", F.col("b.name").alias("name"), (-F.col("b.n")).alias("confidence"))


_QUANT = " OR ".join(f"contains(lower(q), '{x}')" for x in QUANTITATIVE)


@query("route_column_signal_score", f"SELECT conv_id, turn, CASE WHEN {_QUANT} THEN 0.5 + CASE WHEN contains(lower(q), 'limit') OR contains(lower(q), 'expir') THEN 0.25 + CASE WHEN contains(lower(q), 'polic') THEN 0.1 ELSE 0 END ELSE 0 END ELSE 0 END AS confidence FROM {ASKED_SQL}")
def route_column_signal_score(t):
    low = F.lower("q")
    score = rules.column_confidence(rules.any_of(low, QUANTITATIVE), rules.any_of(low, ("limit", "expir")), rules.any_of(low, ("polic",)))
    return asked(t).select("conv_id", "turn", score.alias("confidence"))


@query("route_threshold", f"SELECT conv_id, turn, CASE WHEN c >= 0.6 THEN 'SQL' WHEN c >= 0.4 THEN 'REVIEW' ELSE 'RAG' END AS route FROM (SELECT conv_id, turn, max(confidence) AS c FROM ({_CONF}) GROUP BY ALL)")
def route_threshold(t):
    best = F.array_max(F.transform(_triggers(F.col("q")), lambda x: x["confidence"]))
    return asked(t).select("conv_id", "turn", rules.route(best).alias("route"))


@query(
    "route_curated_qa",
    """WITH c AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]{2,}'))) AS toks FROM documents),
            k AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]{2,}'))) AS need FROM benchmark)
       SELECT doc_id, min(item_id) AS item_id FROM c, k WHERE len(need) > 0 AND list_has_all(toks, need) GROUP BY ALL""",
)
def route_curated_qa(t):
    """The first curated item (priority: its id) all of whose keywords a document has."""
    texts = t.documents.select("doc_id", tokens("text").alias("tokens"))
    items = t.benchmark.select("item_id", tokens("text").alias("tokens")).filter(F.size("tokens") > 0)
    return jn.keyword_lookup(texts, items, "doc_id", "item_id").groupBy("doc_id").agg(F.min("item_id").alias("item_id"))


@query("route_action", "SELECT doc_id, c AS confidence, CASE WHEN c >= 40 THEN 'CITE' ELSE 'ROUTE' END AS action FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN o WHEN doc_id % 3 = 1 THEN least(o, 50) ELSE least(o, 30) END AS c FROM (SELECT doc_id, CAST(doc_id * 7 % 101 AS INTEGER) AS o FROM documents))")
def route_action(t):
    k = F.col("doc_id") % 3
    return t.documents.select("doc_id", rules.action((F.col("doc_id") * 7 % 101).cast("int"), k == 0, 40, k < 2).alias("r")).select("doc_id", "r.confidence", "r.action")


_NS = "['client', 'doctype', 'stage', 'topic'][1 + p_partkey % 4]"


def _ns():
    return F.element_at(F.array(F.lit("client"), F.lit("doctype"), F.lit("stage"), F.lit("topic")), (1 + F.col("p_partkey") % 4).cast("int"))


@query("rule_conflict_path_llm", f"SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'path' WHEN p_type = p_brand THEN 'path' WHEN {_NS} IN ('doctype', 'topic') AND p_size / 50 >= 0.7 THEN 'llm' ELSE 'path' END AS winner FROM part")
def rule_conflict_path_llm(t):
    """A tag by path (the type) against one by model (the brand, none for every fifth size)."""
    model = F.when(F.col("p_size") % 5 != 0, F.col("p_brand"))
    return t.part.select("p_partkey", rules.winner(_ns(), F.col("p_type"), model, F.col("p_size") / 50).alias("winner"))


@query("rule_conflict_keyword", f"SELECT p_partkey, CASE WHEN {_NS} = 'client' THEN 'path' ELSE 'keyword' END AS winner FROM part")
def rule_conflict_keyword(t):
    return t.part.select("p_partkey", rules.keyword_winner(_ns()).alias("winner"))


@query(
    "rule_guardrail_max_tags",
    "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2, CASE WHEN l_linenumber % 2 > 0 THEN -l_discount END, l_linenumber) <= greatest(0, 4 - l_orderkey % 3) AS kept FROM (SELECT l_orderkey, l_linenumber, max(l_discount) AS l_discount FROM lineitem GROUP BY ALL)",
)
def rule_guardrail_max_tags(t):
    """Lines of an order as tags: even ones by path, odd ones by model with the discount as confidence; up to two tags set by hand."""
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("sure")).withColumns({"manual": F.col("l_orderkey") % 3, "rank": F.col("l_linenumber") % 2})
    return rules.max_tags(rows, "l_orderkey", 4, "manual", "rank", "sure", "l_linenumber").select("l_orderkey", "l_linenumber", "kept")


@query("rule_decision_table", "SELECT doc_id, CASE WHEN doc_id % 10 / 10 < 0.4 THEN 'discard' WHEN toxic = 1 THEN 'suggest' ELSE 'apply' END AS decision FROM labels")
def rule_decision_table(t):
    return t.labels.select("doc_id", rules.decision(F.col("doc_id") % 10 / 10, 0.4, F.col("toxic") == 1).alias("decision"))


@query("rule_cardinality_cap", "SELECT source, CASE WHEN n >= 40 THEN 'reject' WHEN n >= 32 THEN 'warn' ELSE 'ok' END AS state FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def rule_cardinality_cap(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).select("source", rules.cardinality(F.col("n"), F.lit(40)).alias("state"))


@query("rule_cost_cap", "SELECT user_id, CASE WHEN d + 10 > 900 THEN 'daily' WHEN m + 10 > 1500 THEN 'monthly' ELSE 'allowed' END AS verdict FROM (SELECT user_id, coalesce(sum(value) FILTER (CAST(ts AS DATE) = DATE '2024-01-16'), 0) AS d, sum(value) AS m FROM events GROUP BY 1)")
def rule_cost_cap(t):
    today = F.when(F.col("ts").cast("date") == F.lit("2024-01-16").cast("date"), F.col("value"))
    spent = t.events.groupBy("user_id").agg(F.coalesce(F.sum(today), F.lit(0.0)).alias("d"), F.sum("value").alias("m"))
    return spent.select("user_id", F.when(F.col("d") + 10 > 900, "daily").when(F.col("m") + 10 > 1500, "monthly").otherwise("allowed").alias("verdict"))
