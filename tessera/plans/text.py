"""Text functions and rules. The corpus has no question of the trade, so messages get one in front, picked by their key."""

import json
import os
import secrets

from pyspark.sql import functions as F

from ..functions import config, lists, rules
from ..functions import text as tx
from ..operators import joins as jn
from ..operators import tagging
from .registry import query

#: Questions that are put before the messages, by turn of their key.
QUESTIONS = (
    "What is the current policy limit?", "Compare the quote versus the binder", "next 5 expiring policies", "Show the loss run and claims history", "umbrella or excess endorsement",
    "Who signed the application?", "12 expiring certificates", "Is earthquake property coverage active?", "next 90 renewals", "Summarize the trend across all buildings",
    "Tell me a story", "dec page and EPLI", "policy number for the building", "crime and fidelity",
    "GL limits and commercial general", "workers comp audit, WC payroll", "D&O for directors and officers",
)
_Q = "['" + "', '".join(QUESTIONS) + "']"
ASKED_SQL = f"(SELECT conv_id, turn, {_Q}[1 + (conv_id * 3 + turn) % {len(QUESTIONS)}] || ' ' || text AS q FROM conversations)"


def asked(t):
    pick = F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), (1 + (F.col("conv_id") * 3 + F.col("turn")) % len(QUESTIONS)).cast("int"))
    return t.conversations.select("conv_id", "turn", F.concat_ws(" ", pick, "text").alias("q"))


_SPLIT = "string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+')"


def _toks(least, text="text"):
    return f"list_distinct(list_filter({_SPLIT.replace('text', text)}, lambda x: regexp_full_match(x, '[a-z0-9]{{{least},}}')))"


_STOP = "['" + "', '".join(lists.STOP_WORDS) + "']"


@query("txt_tokenize", f"SELECT doc_id, array_to_string(list_sort({_toks(2)}), ' ') AS tokens FROM documents")
def txt_tokenize(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(tx.tokens("text")), " ").alias("tokens"))


@query("txt_keyword_subset", f"SELECT doc_id, list_has_all({_toks(2)}, ['the', 'of', 'and']) AS matched FROM documents")
def txt_keyword_subset(t):
    return t.documents.select("doc_id", (F.size(F.array_except(F.array(F.lit("the"), F.lit("of"), F.lit("and")), tx.tokens("text"))) == 0).alias("matched"))


@query("txt_key_terms", f"SELECT doc_id, array_to_string(list_sort(list_filter({_toks(3)}, lambda x: NOT list_contains({_STOP}, x))), ' ') AS terms FROM documents")
def txt_key_terms(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(tx.key_terms("text", lists.STOP_WORDS)), " ").alias("terms"))


_TERMS = f"list_filter({_toks(3)}, lambda x: NOT list_contains({_STOP}, x))"
_COVER = f"""SELECT conv_id, turn, CASE WHEN len(terms) = 0 THEN 0.0 ELSE len(list_intersect(terms, before)) / len(terms) END AS coverage
  FROM (SELECT conv_id, turn, terms, lag(terms) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT conv_id, turn, {_TERMS} AS terms FROM conversations)) WHERE before IS NOT NULL"""


def _covered(t):
    from pyspark.sql import Window as W

    rows = t.conversations.select("conv_id", "turn", tx.key_terms("text", lists.STOP_WORDS).alias("terms"))
    rows = rows.withColumn("before", F.lag("terms").over(W.partitionBy("conv_id").orderBy("turn"))).filter("before is not null")
    return rows.select("conv_id", "turn", tx.coverage(F.col("terms"), F.col("before")).alias("coverage"))


@query("txt_coverage", f"SELECT conv_id, turn, round(coverage, 6) AS coverage FROM ({_COVER})")
def txt_coverage(t):
    return _covered(t).withColumn("coverage", F.round("coverage", 6))


@query("txt_confidence", f"SELECT conv_id, turn, CASE WHEN turn = 7 THEN 0 ELSE greatest(0, least(100, CAST(trunc(30 * (conv_id % 11) / 10 + 40 * round(coverage, 6) + 30 * (turn * 13 % 101) / 100) AS INTEGER))) END AS overall FROM ({_COVER})")
def txt_confidence(t):
    found = rules.confidence((F.col("conv_id") % 11) / 10, F.round("coverage", 6), F.col("turn") * 13 % 101, F.when(F.col("turn") == 7, 0).otherwise(1))
    return _covered(t).select("conv_id", "turn", found.alias("overall"))



def _edges(pattern):
    """A pattern in the form of an engine without look-around: a word's edges instead."""
    return pattern.replace(r"(?<!\w)", r"\b").replace(r"(?!\w)", r"\b")


_INTENTS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(q, '{_edges(p)}') THEN '{k}' END" for k, p in lists.INTENTS.items()) + "], lambda x: x IS NOT NULL)"


@query("txt_intent_detect", f"SELECT conv_id, turn, array_to_string({_INTENTS}, ',') AS labels, {_INTENTS}[1] AS first, least(1.0, 0.5 * len({_INTENTS})) AS confidence FROM {ASKED_SQL}")
def txt_intent_detect(t):
    rows = asked(t).withColumn("l", rules.intents(F.col("q"), lists.INTENTS))
    return rows.select("conv_id", "turn", F.array_join("l", ",").alias("labels"), F.try_element_at("l", F.lit(1)).alias("first"), F.least(F.lit(1.0), 0.5 * F.size("l")).alias("confidence"))


@query("txt_comparison_detect", f"SELECT conv_id, turn FROM {ASKED_SQL} WHERE regexp_matches(q, '{lists.COMPARISON}')")
def txt_comparison_detect(t):
    return asked(t).filter(F.col("q").rlike(lists.COMPARISON)).select("conv_id", "turn")


@query(
    "txt_extract_limit",
    f"SELECT conv_id, turn, least(50, coalesce(try_cast(nullif(regexp_extract(q, '(?i)\\bnext\\s+(\\d+)\\b', 1), '') AS INTEGER), try_cast(nullif(regexp_extract(q, '(?i)\\b(\\d+)\\s+expir', 1), '') AS INTEGER), 10)) AS n FROM {ASKED_SQL}",
)
def txt_extract_limit(t):
    number = lambda p: F.regexp_extract("q", p, 1).try_cast("int")
    return asked(t).select("conv_id", "turn", F.least(F.lit(50), F.coalesce(number(r"(?i)\bnext\s+(\d+)\b"), number(r"(?i)\b(\d+)\s+expir"), F.lit(10))).alias("n"))


@query("txt_model_router", f"SELECT conv_id, turn, CASE WHEN {' OR '.join(f'contains(lower(q), {s!r})' for s in lists.COMPLEX_SIGNALS)} THEN 'complex' ELSE 'simple' END AS model FROM {ASKED_SQL}")
def txt_model_router(t):
    return asked(t).select("conv_id", "turn", rules.complex_question(F.col("q"), lists.COMPLEX_SIGNALS).alias("model"))


@query(
    "txt_tag_match",
    f"SELECT conv_id, turn, n_name AS tag FROM {ASKED_SQL} a, (SELECT n_name, ['policy', 'binder', 'expiring', 'loss', 'umbrella', 'application', 'building'][1 + n_nationkey % 7] AS term FROM nation) WHERE regexp_matches(q, '(?i)\\b' || term || '\\b')",
)
def txt_tag_match(t):
    """Tags (one for each nation) whose term stands in a question as a word: found by equality of words, not by testing all pairs."""
    terms = F.array(*[F.lit(x) for x in ("policy", "binder", "expiring", "loss", "umbrella", "application", "building")])
    tags = t.nation.select(F.col("n_name").alias("tag"), F.element_at(terms, 1 + F.col("n_nationkey") % 7).alias("word"))
    words = asked(t).select("conv_id", "turn", F.explode(F.array_distinct(F.split(F.lower("q"), "[^a-z0-9_]+"))).alias("word"))
    return words.join(F.broadcast(tags), "word").select("conv_id", "turn", "tag")


@query(
    "txt_entity_detect",
    f"SELECT conv_id, turn, min(tag) AS entity FROM (SELECT conv_id, turn, ['client:binder', 'client:umbrella', 'client:building'][i] AS tag FROM {ASKED_SQL}, (SELECT unnest([1, 2, 3]) AS i) WHERE regexp_matches(q, '(?i)\\b' || ['binder', 'umbrella', 'building'][i] || '\\b')) GROUP BY ALL HAVING count(*) = 1",
)
def txt_entity_detect(t):
    """The client tag, where exactly one is in the question."""
    words = F.split(F.lower("q"), "[^a-z0-9_]+")
    found = F.filter(F.array(F.lit("binder"), F.lit("umbrella"), F.lit("building")), lambda x: F.array_contains(words, x))
    return asked(t).select("conv_id", "turn", found.alias("f")).filter(F.size("f") == 1).select("conv_id", "turn", F.concat(F.lit("client:"), F.col("f")[0]).alias("entity"))


#: Terms of the trade and what else they are called.
SYNONYMS = (("policy", ("contract", "coverage form")), ("general liability", ("GL", "commercial general")), ("quote", ("proposal", "binder")), ("building", ("structure", "premises location")), ("workers comp", ("WC", "workers compensation")))


def _expand_sql():
    """Each group's terms with their tokens; the first that fits decides what the group adds."""
    text = lambda x: "'" + x + "'"
    groups = ", ".join(f"({g}, [{', '.join(map(text, (term, *others)))}])" for g, (term, others) in enumerate(SYNONYMS))
    topics = ", ".join(f"({g}, [{', '.join(map(text, words))}], {text(x)})" for g, (words, x) in enumerate(lists.EXPANSIONS))
    return f"""WITH a AS (SELECT conv_id, turn, q, lower(q) AS low, {_toks(2, 'q')} AS own FROM {ASKED_SQL}),
            g AS (SELECT g, terms, i, {_toks(2, 'term')} AS need FROM (SELECT g, terms, unnest(range(1, len(terms) + 1)) AS i, unnest(terms) AS term FROM (VALUES {groups}) v(g, terms))),
            f AS (SELECT conv_id, turn, g, min(i) AS i FROM a JOIN g ON list_has_all(own, need) GROUP BY ALL),
            s AS (SELECT conv_id, turn, g, unnest(list_filter(terms, lambda x: x <> terms[i])) AS variant, generate_subscripts(list_filter(terms, lambda x: x <> terms[i]), 1) AS k FROM f JOIN (SELECT DISTINCT g, terms FROM g) USING (g)),
            v AS (SELECT conv_id, turn, -1 AS g, 0 AS k, q AS variant FROM a UNION ALL SELECT conv_id, turn, g, k, variant FROM s
                  UNION ALL SELECT conv_id, turn, 100 + g, 0, topic FROM a JOIN (VALUES {topics}) w(g, words, topic) ON len(list_filter(words, lambda x: contains(low, x))) > 0)
       SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY g, k) - 1 AS INT) AS place, variant FROM v"""


@query("txt_query_expand", _expand_sql())
def txt_query_expand(t):
    """What each question is searched as: itself, what synonyms add, what its topics add."""
    return asked(t).select("conv_id", "turn", F.posexplode(tx.variants(F.col("q"), SYNONYMS, lists.EXPANSIONS)).alias("place", "variant"))


@query(
    "txt_citation_extract",
    "SELECT conv_id, turn, i AS place, ids[i] AS source_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet FROM (SELECT conv_id, turn, text, [conv_id || ':' || turn, (conv_id + 1) || ':0'] AS ids, unnest([1, 2]) AS i FROM conversations WHERE role = 'assistant')",
)
def txt_citation_extract(t):
    """Sources cited in an answer (here put at its end), in order, with a snippet."""
    cite = lambda *c: F.concat(F.lit(" [SourceId: "), F.concat_ws(":", *c), F.lit("]"))
    rows = t.conversations.filter("role = 'assistant'").withColumn("answer", F.concat("text", cite("conv_id", "turn"), cite(F.col("conv_id") + 1, F.lit(0))))
    found = F.posexplode(F.regexp_extract_all("answer", F.lit(r"\[SourceId: ([0-9]+:[0-9]+)\]"), F.lit(1))).alias("place", "source_id")
    snippet = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", found, snippet.alias("snippet")).withColumn("place", F.col("place") + 1)


@query("txt_context_format", "SELECT conv_id, string_agg('[' || role || '] page: ' || CASE WHEN turn % 2 = 0 THEN CAST(turn AS VARCHAR) ELSE 'N/A' END || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY 1")
def txt_context_format(t):
    page = F.coalesce(F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")), F.lit("N/A"))
    block = F.format_string("[%s] page: %s\n%s", "role", page, "text")
    listed = F.array_sort(F.collect_list(F.struct("turn", block.alias("b"))))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n").alias("context"))


_PLANT = "text || ' ' || CASE doc_id % 5 WHEN 0 THEN '123-45-6789' WHEN 1 THEN '987654321' WHEN 2 THEN '04/17/1990' WHEN 3 THEN 'a.b@example.org' ELSE '4111 1111 1111 1111' END"


def _planted(t):
    extra = F.element_at(F.array(*[F.lit(x) for x in ("123-45-6789", "987654321", "04/17/1990", "a.b@example.org", "4111 1111 1111 1111")]), (1 + F.col("doc_id") % 5).cast("int"))
    return t.documents.select("doc_id", F.concat_ws(" ", "text", extra).alias("text"))


def _replaced(column):
    for name, pattern in lists.PII[:-1]:  # the last looks ahead, and finds only numbers that the second has replaced
        column = f"regexp_replace({column}, '{pattern}', '[{name}]', 'g')"
    return column


@query("txt_pii_redact", f"SELECT doc_id, x AS redacted, (length(x) - length(replace(x, '-REDACTED]', ''))) // 10 AS n FROM (SELECT doc_id, {_replaced(_PLANT)} AS x FROM documents)")
def txt_pii_redact(t):
    out = tx.redact("text", lists.PII)
    return _planted(t).select("doc_id", out.alias("redacted")).withColumn("n", F.regexp_count("redacted", F.lit(r"-REDACTED\]")).cast("long"))


@query("txt_pii_high_risk", f"SELECT doc_id, regexp_replace(regexp_replace({_PLANT}, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b', '***', 'g'), '\\b\\d{{9,18}}\\b', '***', 'g') = {_PLANT} AS clean FROM documents")
def txt_pii_high_risk(t):
    out = F.regexp_replace(F.regexp_replace("text", r"\b\d{3}-\d{2}-\d{4}\b", "***"), r"\b\d{9,18}\b", "***")
    return _planted(t).select("doc_id", (out == F.col("text")).alias("clean"))


@query("txt_encrypt_column", "SELECT c_custkey, c_name, CAST(4 * ceil((12 + strlen(c_name) + 16) / 3) AS INTEGER) AS token_chars, true AS hidden FROM customer")
def txt_encrypt_column(t):
    """A column encrypted (12 bytes of nonce, the text, 16 of tag, in base 64) and decrypted again. The key is a row of a table, so no plan prints it; without one in TESSERA_KEY each run makes its own."""
    keys = t.spark.createDataFrame([(os.environ.get("TESSERA_KEY") or secrets.token_hex(16),)], "key string")
    rows = t.customer.join(F.broadcast(keys)).select("c_custkey", "c_name", "key", F.base64(F.aes_encrypt("c_name", "key")).alias("token"))
    again = F.aes_decrypt(F.unbase64("token"), "key").cast("string")
    return rows.select("c_custkey", again.alias("c_name"), F.length("token").alias("token_chars"), (~F.contains("token", F.col("c_name"))).alias("hidden"))


@query("txt_canonicalize_signal", "SELECT p_partkey, CASE WHEN s IN ('a','an','the','of','in','is','at','for','to','and','or') OR length(s) < 3 OR length(s) > 80 THEN '' ELSE s END AS signal FROM (SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(p_name || '_' || p_type, '[-_]', ' ', 'g'), '\\s+', ' ', 'g'))) AS s FROM part)")
def txt_canonicalize_signal(t):
    return t.part.select("p_partkey", tx.canonical(F.concat_ws("_", "p_name", "p_type"), lists.SIGNAL_STOP_WORDS).alias("signal"))


@query("txt_normalize_keyword", "SELECT doc_id, upper(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), 'ß', 'ss')) AS keyword FROM documents")
def txt_normalize_keyword(t):
    return t.documents.select("doc_id", F.upper(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("keyword"))


@query("txt_keyword_rule", "SELECT doc_id FROM documents WHERE (contains(substr(text, 1, 1500), 'ing') OR contains(substr(text, 1, 1500), 'ung')) AND contains(substr(text, 1, 1500), 'er') AND contains(substr(text, 1, 1500), 'st')")
def txt_keyword_rule(t):
    head = F.substring("text", 1, 1500)  # the rule looks at so many characters
    return t.documents.filter(tx.any_of(head, ["ing", "ung"]) & tx.all_of(head, ["er", "st"])).select("doc_id")


@query("txt_path_rules", "SELECT page_id, 'lang:' || CASE split_part(url, '/', 4) WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE split_part(url, '/', 4) END AS tag, regexp_extract(split_part(url, '/', 3), '^(?:www\\.|m\\.|blog\\.)?([^.]+)', 1) AS site FROM pages")
def txt_path_rules(t):
    part = F.split_part("url", F.lit("/"), F.lit(4))
    named = F.coalesce(F.create_map(F.lit("de"), F.lit("german"), F.lit("fr"), F.lit("french"))[part], part)
    return t.pages.select("page_id", F.concat(F.lit("lang:"), named).alias("tag"), F.regexp_extract(F.split_part("url", F.lit("/"), F.lit(3)), r"^(?:www\.|m\.|blog\.)?([^.]+)", 1).alias("site"))


@query("txt_email_subject_rules", f"SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(q, '(?i)renew|expir') THEN 'topic:renewal' END, CASE WHEN regexp_matches(q, '(?i)claim|loss') THEN 'topic:claim' END], lambda x: x IS NOT NULL), ',') AS tags FROM {ASKED_SQL}")
def txt_email_subject_rules(t):
    return asked(t).select("conv_id", "turn", F.array_join(rules.intents(F.col("q"), {"topic:renewal": "(?i)renew|expir", "topic:claim": "(?i)claim|loss"}), ",").alias("tags"))


@query("txt_slugify", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_brand || '  ' || p_name || '_x'), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def txt_slugify(t):
    return t.part.select("p_partkey", tx.slug(F.concat("p_brand", F.lit("  "), "p_name", F.lit("_x"))).alias("slug"))


@query("txt_year_range", "SELECT p_partkey, (2000 + p_size) || '-' || (2001 + p_size) AS years FROM part")
def txt_year_range(t):
    return t.part.select("p_partkey", rules.year_range(F.col("p_size").cast("string")).alias("years"))


@query(
    "txt_alias_resolve",
    """WITH a AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE lower(n_name) END AS alias, 'N' || n_nationkey AS canon FROM nation WHERE n_nationkey % 3 < 2), c AS (SELECT c_custkey, 'NATION_' || c_nationkey AS raw FROM customer)
       SELECT c_custkey, CASE WHEN e.canon IS NOT NULL THEN 'exact' WHEN f.canon IS NOT NULL THEN 'case' ELSE 'slug' END AS how, coalesce(e.canon, f.canon, regexp_replace(regexp_replace(lower(raw), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g')) AS name
       FROM c LEFT JOIN a e ON e.alias = raw LEFT JOIN a f ON lower(f.alias) = lower(raw)""",
)
def txt_alias_resolve(t):
    """A name by its alias, by the alias without case, or as a slug; two thirds of the nations have an alias."""
    alias = t.nation.filter("n_nationkey % 3 < 2").select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("alias"), F.concat(F.lit("N"), "n_nationkey").alias("canon"))
    rows = t.customer.select("c_custkey", F.concat(F.lit("NATION_"), "c_nationkey").alias("raw"))
    exact = alias.select(F.col("alias").alias("raw"), F.col("canon").alias("a"))
    folded = alias.select(F.lower("alias").alias("low"), F.col("canon").alias("b"))
    rows = rows.join(F.broadcast(exact), "raw", "left").withColumn("low", F.lower("raw")).join(F.broadcast(folded), "low", "left")
    how = F.when(F.col("a").isNotNull(), "exact").when(F.col("b").isNotNull(), "case").otherwise("slug")
    return rows.select("c_custkey", how.alias("how"), F.coalesce("a", "b", tx.slug("raw")).alias("name"))


@query(
    "txt_carrier_resolve",
    """WITH a AS (SELECT 'supplier#00000000' || n_nationkey AS alias, 'R' || n_nationkey AS canon, n_nationkey AS place FROM nation), k AS (SELECT s_suppkey, s_name, lower(trim(s_name)) AS k FROM supplier)
       SELECT s_suppkey, coalesce(arg_min(canon, CASE WHEN k = alias THEN -1 ELSE place END), any_value(s_name)) AS carrier FROM k LEFT JOIN a ON k = alias OR starts_with(k, alias) OR starts_with(alias, k) GROUP BY s_suppkey""",
)
def txt_carrier_resolve(t):
    """The canonical name of an alias that equals the name, else of the first alias where one starts the other, else the name."""
    alias = t.nation.select(F.concat(F.lit("supplier#00000000"), "n_nationkey").alias("alias"), F.concat(F.lit("R"), "n_nationkey").alias("canon"), F.col("n_nationkey").alias("place"))
    rows = t.supplier.select("s_suppkey", "s_name", F.lower(F.trim("s_name")).alias("k"))
    near = (F.col("k") == F.col("alias")) | F.col("k").startswith(F.col("alias")) | F.col("alias").startswith(F.col("k"))
    found = rows.join(F.broadcast(alias), near).groupBy("s_suppkey").agg(F.min_by("canon", F.struct(F.col("k") != F.col("alias"), "place")).alias("canon"))
    return rows.join(found, "s_suppkey", "left").select("s_suppkey", F.coalesce("canon", "s_name").alias("carrier"))


@query("txt_coverage_line_canon", "SELECT p_partkey, CASE lower(p_type) WHEN 'promo' THEN 'promotion' WHEN 'economy' THEN 'eco' ELSE replace(replace(lower(p_type || ' ' || p_name), ' ', '_'), '-', '_') END AS line FROM part")
def txt_coverage_line_canon(t):
    known = F.create_map(F.lit("promo"), F.lit("promotion"), F.lit("economy"), F.lit("eco"))
    return t.part.select("p_partkey", F.coalesce(known[F.lower("p_type")], F.translate(F.lower(F.concat_ws(" ", "p_type", "p_name")), " -", "__")).alias("line"))


def _bare(x):
    """A name without the words that don't tell companies apart."""
    x = f"regexp_replace(lower(trim({x})), '\\s+', ' ', 'g')"
    for pattern in rules.SUFFIXES:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return f"trim(regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ',+$', ''))"


def _code(name):
    """The sound code of a name."""
    x = f"regexp_replace(upper({name}), '[^A-Z]', '', 'g')"
    d = f"translate({x}, 'AEIOUHWBFPVCGJKQSXZYDTLMNR', '00000001111222222222334556')"
    return f"CASE WHEN {x} = '' THEN '0000' ELSE rpad({x}[1:1] || array_to_string(list_transform(list_filter(range(2, length({d}) + 1), lambda i: {d}[i:i] <> '0' AND {d}[i:i] <> {d}[i-1:i-1]), lambda i: {d}[i:i]), ''), 4, '0')[1:4] END"


@query(
    "txt_name_match_tiers",
    f"""WITH n AS (SELECT s_suppkey, lower(s_name) AS b, lower(s_name) || ['', ' LLC', ' Ltd'][1 + s_suppkey % 3] AS a FROM supplier),
            m AS (SELECT *, {_bare('a')} = {_bare('b')} AS bare, list_sum(list_transform(range(1, 5), lambda j: (({_code('a')})[j:j] = ({_code('b')})[j:j])::INT)) / 4 AS sound FROM n)
       SELECT s_suppkey, score FROM (SELECT s_suppkey, CASE WHEN regexp_replace(lower(trim(a)), '\\s+', ' ', 'g') = regexp_replace(lower(trim(b)), '\\s+', ' ', 'g') THEN 1.0 WHEN bare THEN 0.85 ELSE sound END::DOUBLE AS score FROM m) WHERE score >= 0.6""",
)
def txt_name_match_tiers(t):
    """Suppliers against names made from them: equal, equal but for the ending, or alike in sound (0.6 at least)."""
    suffix = F.element_at(F.array(F.lit(""), F.lit(" LLC"), F.lit(" Ltd")), (1 + F.col("s_suppkey") % 3).cast("int"))
    rows = t.supplier.select("s_suppkey", F.lower("s_name").alias("b"), F.concat(F.lower("s_name"), suffix).alias("a"))
    score = F.when(rules.normal_name(F.col("a")) == rules.normal_name(F.col("b")), 1.0).when(rules.without_suffix(F.col("a")) == rules.without_suffix(F.col("b")), 0.85).otherwise(rules.sound_likeness(F.col("a"), F.col("b")))
    return rows.select("s_suppkey", score.alias("score")).filter("score >= 0.6")


@query(
    "txt_soundex_variant",
    """WITH l AS (SELECT p_partkey, regexp_replace(upper(split_part(p_name, ' ', 1)), '[^A-Z]', '', 'g') AS x FROM part), c AS (SELECT p_partkey, x, translate(x, 'AEIOUHWBFPVCGJKQSXZYDTLMNR', '00000001111222222222334556') AS d FROM l)
       SELECT p_partkey, CASE WHEN x = '' THEN '0000' ELSE rpad(x[1:1] || array_to_string(list_transform(list_filter(range(2, length(d) + 1), lambda i: d[i:i] <> '0' AND d[i:i] <> d[i-1:i-1]), lambda i: d[i:i]), ''), 4, '0')[1:4] END AS code FROM c""",
)
def txt_soundex_variant(t):
    return t.part.select("p_partkey", tx.phonetic(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("code"))


@query(
    "txt_doc_classify",
    """WITH s AS (SELECT doc_id, unnest(['prose', 'code', 'legal']) AS class, unnest([0.7 * (contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT) / 2, 0.7 * (contains(lower(text), 'token')::INT + contains(lower(text), 'key')::INT) / 2, 0.7 * (contains(lower(text), 'license')::INT + contains(lower(text), 'licensed')::INT) / 2 - 0.2 * contains(lower(text), 'token')::INT]) AS score FROM documents),
            r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class) AS k, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, class) AS next FROM (SELECT doc_id, class, round(greatest(0, least(1, score)), 4) AS score FROM s))
       SELECT doc_id, class, score, score - next < 0.1 AS ambiguous FROM r WHERE k = 1 AND score >= 0.3""",
)
def txt_doc_classify(t):
    """The class whose keywords a document has most of, and whether another is nearly as likely."""
    low = F.lower("text")
    classes = {"prose": (["the", "and"], []), "code": (["token", "key"], []), "legal": (["license", "licensed"], ["token"])}
    hits = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    scored = [F.struct(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * hits(has) / len(has) - 0.2 * hits(hasnt))), 4).alias("score"), F.lit(name).alias("class")) for name, (has, hasnt) in classes.items()]
    ranked = F.array_sort(F.transform(F.array(*scored), lambda x: F.struct((-x["score"]).alias("n"), x["class"].alias("class"))))
    rows = t.documents.select("doc_id", ranked.alias("r"))
    return rows.select("doc_id", F.col("r")[0]["class"].alias("class"), (-F.col("r")[0]["n"]).alias("score"), (F.col("r")[1]["n"] - F.col("r")[0]["n"] < 0.1).alias("ambiguous")).filter("score >= 0.3")


@query("txt_compliance_check", "SELECT n_nationkey, n_lines < 3 OR total < 1000000 AS gap FROM (SELECT n_nationkey, count(DISTINCT c_mktsegment) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')) AS n_lines, sum(o_totalprice) AS total FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1)")
def txt_compliance_check(t):
    """Nations that lack one of three required segments, or whose finished orders fall below the least total."""
    rows = t.nation.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey")).join(t.orders.filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"))
    needed = F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("AUTOMOBILE"))
    found = rows.groupBy("n_nationkey").agg(F.collect_set("c_mktsegment").alias("has"), F.sum("o_totalprice").alias("total"))
    return found.select("n_nationkey", ((F.size(F.array_except(needed, "has")) > 0) | (F.col("total") < 1000000)).alias("gap"))


@query("txt_compliance_gap_simple", "SELECT c_nationkey, CAST(floor(c_acctbal / 500) AS BIGINT) AS level, array_to_string(list_sort(list_filter(['BUILDING', 'FURNITURE', 'HOUSEHOLD'], lambda x: NOT list_contains(list(c_mktsegment), x))), ',') AS missing FROM customer GROUP BY 1, 2")
def txt_compliance_gap_simple(t):
    needed = F.array(F.lit("BUILDING"), F.lit("FURNITURE"), F.lit("HOUSEHOLD"))
    found = t.customer.groupBy("c_nationkey", F.floor(F.col("c_acctbal") / 500).alias("level")).agg(F.collect_set("c_mktsegment").alias("has"))
    return found.select("c_nationkey", "level", F.array_join(F.array_sort(F.array_except(needed, "has")), ",").alias("missing"))


@query(
    "txt_date_parse_multi",
    """WITH f AS (SELECT o_orderkey, [strftime(o_orderdate, '%m/%d/%Y'), strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%-m/%-d/%Y'), strftime(o_orderdate, '%d %b %Y')][1 + o_orderkey % 4] AS x FROM orders)
       SELECT o_orderkey, CASE WHEN regexp_full_match(x, '\\d{1,2}/\\d{1,2}/\\d{4}') THEN CAST(try_strptime(x, '%m/%d/%Y') AS DATE) WHEN regexp_full_match(x, '\\d{4}-\\d{1,2}-\\d{1,2}') THEN CAST(try_strptime(x, '%Y-%m-%d') AS DATE) END AS day FROM f""",
)
def txt_date_parse_multi(t):
    forms = F.array(F.date_format("o_orderdate", "MM/dd/yyyy"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "M/d/yyyy"), F.date_format("o_orderdate", "dd MMM yyyy"))
    text = F.element_at(forms, (1 + F.col("o_orderkey") % 4).cast("int"))
    return t.orders.select("o_orderkey", tx.parse_date(text).alias("day"))


@query(
    "txt_tag_validate",
    """WITH m AS (SELECT p_partkey, lower(trim([' Public ', p_brand, 'a--' || p_size, lower(p_type), 't-' || p_partkey][1 + p_partkey % 5])) AS tag FROM part)
       SELECT p_partkey, CASE WHEN tag IN ('public', 'system') THEN 'reserved' WHEN length(tag) NOT BETWEEN 1 AND 64 THEN 'length' WHEN contains(tag, '--') THEN 'hyphens' WHEN NOT regexp_full_match(tag, '[a-z0-9]([a-z0-9-]*[a-z0-9])?') THEN 'characters' ELSE 'ok' END AS reason FROM m""",
)
def txt_tag_validate(t):
    made = F.element_at(F.array(F.lit(" Public "), F.col("p_brand"), F.concat(F.lit("a--"), "p_size"), F.lower("p_type"), F.concat(F.lit("t-"), "p_partkey")), (1 + F.col("p_partkey") % 5).cast("int"))
    tag = F.lower(F.trim(made))
    reason = F.when(tag.isin("public", "system"), "reserved").when(~F.length(tag).between(1, 64), "length").when(tag.contains("--"), "hyphens").when(~tag.rlike("^[a-z0-9]([a-z0-9-]*[a-z0-9])?$"), "characters").otherwise("ok")
    return t.part.select("p_partkey", reason.alias("reason"))


@query("txt_score_sanitize", "SELECT event_id, CASE WHEN s < -0.05 OR s > 1.05 THEN NULL ELSE greatest(0, least(1, s)) END AS score FROM (SELECT event_id, value / 30 - 0.04 AS s FROM events)")
def txt_score_sanitize(t):
    return t.events.select("event_id", rules.sanitize_score(F.col("value") / 30 - 0.04).alias("score"))


@query("txt_answer_check", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) OR contains(lower(b.text), lower(d.text))")
def txt_answer_check(t):
    """Documents that hold a benchmark item or lie in one: whoever holds the other has all of its words, so pairs are found by a word and then compared."""
    item, text = t.benchmark.select("item_id", F.lower("text").alias("b")), t.documents.select("doc_id", F.lower("text").alias("a"))
    # a word at an end of the one that lies inside may be a part of a longer one
    inner = lambda c: F.array_distinct(F.slice(tx.words(c), F.lit(2), F.greatest(F.size(tx.words(c)) - 2, F.lit(0))))
    items, texts = (df.withColumn("tokens", F.array_distinct(tx.words(c))).withColumn("needed", inner(c)) for df, c in ((item, "b"), (text, "a")))
    held = jn.keyword_lookup(texts, items.select("item_id", F.col("needed").alias("tokens")), "doc_id", "item_id")
    lies = jn.keyword_lookup(items, texts.select("doc_id", F.col("needed").alias("tokens")), "item_id", "doc_id")
    short_texts, short_items = texts.filter(F.size("needed") == 0), items.filter(F.size("needed") == 0)  # of two words or fewer
    few = short_texts.join(item, F.col("b").contains(F.col("a"))).select("doc_id", "item_id").unionByName(text.join(short_items, F.col("a").contains(F.col("b"))).select("doc_id", "item_id"))
    pairs = held.unionByName(lies.select("doc_id", "item_id")).unionByName(few).distinct()
    rows = pairs.join(text, "doc_id").join(item, "item_id").filter(F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a")))
    return rows.select("doc_id", "item_id")


@query("txt_answer_variants", "SELECT p_partkey, lower(p_name) = 'red widget' OR contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt') AS passed FROM part")
def txt_answer_variants(t):
    low = F.lower("p_name")
    variants = F.array(F.lit("ring"), F.lit("bolt"))
    return t.part.select("p_partkey", ((low == "red widget") | F.exists(variants, lambda v: low.contains(v) | v.contains(low))).alias("passed"))


@query("txt_markdown_fence_strip", "SELECT event_id, regexp_replace(regexp_replace(CASE WHEN event_id % 3 = 0 THEN props ELSE '```json' || chr(10) || props || chr(10) || '```' END, '^\\s*```[a-z]*\\s*\\n?', ''), '\\n?\\s*```\\s*$', '') AS props FROM events")
def txt_markdown_fence_strip(t):
    fenced = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    return t.events.select("event_id", F.regexp_replace(F.regexp_replace(fenced, r"^\s*```[a-z]*\s*\n?", ""), r"\n?\s*```\s*$", "").alias("props"))


@query("txt_strip_think", "SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 2 = 0 THEN '<think>a' || chr(10) || 'b</think>' || text || '<think>c</think>' ELSE text || '<think>' || text || '</think> so' END, '<think>.*?</think>', '', 'gs') AS answer FROM conversations")
def txt_strip_think(t):
    full = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>a\nb</think>"), "text", F.lit("<think>c</think>"))).otherwise(F.concat("text", F.lit("<think>"), "text", F.lit("</think> so")))
    return t.conversations.select("conv_id", "turn", F.regexp_replace(full, r"(?s)<think>.*?</think>", "").alias("answer"))


@query("txt_synopsis_render", "SELECT event_id, 'Key: ' || json_extract_string(props, '$.k') || chr(10) || 'Type: ' || event_type AS synopsis FROM events")
def txt_synopsis_render(t):
    parsed = F.from_json("props", "k int")
    return t.events.select("event_id", F.concat_ws("\n", F.concat(F.lit("Key: "), parsed["k"]), F.concat(F.lit("Type: "), "event_type")).alias("synopsis"))


@query("txt_llm_json_repair", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events")
def txt_llm_json_repair(t):
    """An object in an answer: as it is, in fences or inside prose; null where there is none."""
    forms = F.array(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), F.concat(F.lit("Sure: "), "props", F.lit(" done")), F.lit("no object"))
    raw = F.element_at(forms, (1 + F.col("event_id") % 3).cast("int"))
    return t.events.select("event_id", F.get_json_object(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), "$.k").cast("int").alias("k"))


@query("txt_entity_sql_map", "SELECT o_orderpriority, name, round(satisfied, 6) AS satisfied FROM (SELECT DISTINCT o_orderpriority FROM orders), (SELECT 'by_account' AS name, 1.0 AS satisfied UNION ALL SELECT 'by_line', 0.5 UNION ALL SELECT 'by_carrier', 0.0)")
def txt_entity_sql_map(t):
    """How many of a template's parameters the entities at hand (account, limit) satisfy."""
    templates = {"by_account": "SELECT :account", "by_line": "SELECT :account, :line", "by_carrier": "SELECT :carrier"}
    has = F.array(F.lit("account"), F.lit("limit"))
    needed = lambda sql: F.array_distinct(F.regexp_extract_all(F.lit(sql), F.lit(r":(\w+)"), F.lit(1)))
    rows = [F.struct(F.lit(n).alias("name"), (F.size(F.array_intersect(needed(sql), has)) / F.size(needed(sql))).alias("s")) for n, sql in templates.items()]
    return t.orders.select("o_orderpriority").distinct().select("o_orderpriority", F.explode(F.array(*rows)).alias("r")).select("o_orderpriority", "r.name", F.round("r.s", 6).alias("satisfied"))


_STRATEGY = {
    "namespaces": ["site", "lang", "number", "topic", "entity", "mood"],
    "path_rules": [
        {"namespace": "lang", "level": 1, "pattern": "([a-z]+)$", "transform": "lowercase"},
        {"namespace": "number", "level": 2, "pattern": "([0-9])[0-9]*$", "parent": "(?:en|de)$"},
        {"namespace": "topic", "level": 1, "mapping": {"de": "german", "fr": "french"}},
    ],
    "email_patterns": [
        {"pattern": "(?i)ment[ ,.]", "tags": [{"namespace": "mood", "value": "calm"}, {"namespace": "topic", "value": "ment"}]},
        {"pattern": "^The|ing[.]$", "tags": [{"namespace": "mood", "value": "calm"}]},
    ],
}


@query(
    "plug_strategy_yaml",
    r"""WITH w AS (SELECT item_id, string_split(text, ' ') AS s FROM benchmark), i AS (SELECT item_id, s, unnest(range(1, len(s) - 2)) AS i FROM w),
            k AS (SELECT item_id * 1000 + i AS rule_id, CASE i % 2 WHEN 0 THEN 'topic' ELSE 'entity' END AS namespace, CAST(item_id AS VARCHAR) AS value, s[i] || ' ' || s[i + 1] AS phrase, s[i + 3] AS other, i % 3 = 0 AS exact, 1 + i % 7 AS priority FROM i),
            n AS (SELECT *, trim(regexp_replace(nfc_normalize(phrase), '\s+', ' ', 'g')) AS a, trim(regexp_replace(nfc_normalize(other), '\s+', ' ', 'g')) AS b FROM k),
            d AS (SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS text FROM documents), u AS (SELECT doc_id, text, upper(text) AS caps FROM d),
            h AS (SELECT doc_id, namespace, value, priority, rule_id FROM u JOIN n ON CASE WHEN exact THEN contains(text, a) AND contains(text, b) ELSE contains(caps, upper(a)) AND contains(caps, upper(b)) END),
            p AS (SELECT page_id, string_split(regexp_replace(url, '^[^:]*://', ''), '/') AS f FROM pages), q AS (SELECT page_id, CASE WHEN contains(f[-1], '.') THEN f[:-2] ELSE f END AS f FROM p)
       SELECT 'document' AS kind, doc_id AS id, namespace || ':' || value AS tag FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, namespace ORDER BY priority DESC, rule_id) = 1
       UNION ALL SELECT 'page', page_id, 'site:' || upper(f[1]) FROM q WHERE len(f) > 0
       UNION ALL SELECT 'page', page_id, 'lang:' || lower(regexp_extract(f[2], '^([a-z]+)$', 1)) FROM q WHERE regexp_matches(f[2], '^[a-z]+$')
       UNION ALL SELECT 'page', page_id, 'number:' || f[3][1] FROM q WHERE regexp_matches(f[3], '^[0-9]+$') AND f[2] IN ('en', 'de')
       UNION ALL SELECT 'page', page_id, 'topic:' || CASE f[2] WHEN 'de' THEN 'german' ELSE 'french' END FROM q WHERE f[2] IN ('de', 'fr')
       UNION ALL SELECT 'message', conv_id * 1000 + turn, unnest(CASE WHEN regexp_matches(text, '(?i)ment[ ,.]') THEN ['mood:calm', 'topic:ment'] ELSE ['mood:calm'] END) FROM conversations WHERE regexp_matches(text, '(?i)ment[ ,.]') OR regexp_matches(text, '^The|ing[.]$')""",
)
def plug_strategy_yaml(t):
    """A strategy with a keyword rule for each place in a benchmark text and a path rule for each host, over documents, pages and messages."""
    strategy = config.Strategy.load(json.dumps(_STRATEGY))
    path = F.regexp_replace("url", "^[^:]*://", "")
    words = t.benchmark.select("item_id", F.split("text", " ").alias("s")).select("item_id", "s", F.explode(F.sequence(F.lit(1), F.size("s") - 3)).alias("i"))
    at = lambda k: F.get(F.col("s"), F.col("i") + (k - 1))
    keywords = words.select(
        (F.col("item_id") * 1000 + F.col("i")).cast("int").alias("rule_id"), F.lit("keyword").alias("source"), F.when(F.col("i") % 2 == 0, "topic").otherwise("entity").alias("namespace"), F.col("item_id").cast("string").alias("value"),
        F.array(F.concat_ws(" ", at(0), at(1))).alias("any_of"), F.array(at(3)).alias("all_of"), (F.col("i") % 3 == 0).alias("case_sensitive"), (1 + F.col("i") % 7).alias("priority"),
    )
    hosts = t.pages.select(F.split(path, "/")[0].alias("folder")).distinct().select(F.hash("folder").alias("rule_id"), F.lit("path").alias("source"), F.lit("site").alias("namespace"), F.upper("folder").alias("value"), F.lit(0).alias("level"), "folder")
    rules = strategy.rules(t.spark).unionByName(keywords, allowMissingColumns=True).unionByName(hosts, allowMissingColumns=True)
    told = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.concat_ws(":", "namespace", "value").alias("tag"))
    messages = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    out = told(tagging.keyword_tags(t.documents, "doc_id", "text", rules), "document", "doc_id")
    out = out.unionByName(told(tagging.path_tags(t.pages.select("page_id", path.alias("path")), "page_id", "path", rules), "page", "page_id"))
    return out.unionByName(told(tagging.email_tags(messages, "id", "text", rules), "message", "id"))
