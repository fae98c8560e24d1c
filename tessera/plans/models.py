"""Model backends, with their stand-ins."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import backends, enrichment, lists, rules
from ..functions import text as tx
from ..sources import sql
from .registry import query
from .text import _TERMS, ASKED_SQL, asked


@query(
    "udf_embed",
    """WITH w AS (SELECT doc_id, md5(unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''))) AS h FROM documents),
            p AS (SELECT doc_id, ('0x' || h[1:8])::BIGINT % 64 AS place, sum(CASE WHEN h[9:9] >= '8' THEN 1 ELSE -1 END) AS v FROM w GROUP BY ALL), m AS (SELECT doc_id, list(place) AS places, list(v) AS vs, sqrt(sum(v * v)) AS size FROM p GROUP BY 1)
       SELECT doc_id, list_transform(range(64), lambda i: round(coalesce(vs[list_position(places, i)], 0) / CASE WHEN size = 0 THEN 1 ELSE size END, 6)) AS embedding FROM m""",
)
def udf_embed(t):
    """Vectors of all documents from the hashing stand-in."""
    rows = backends.embedded(t.documents.filter("text rlike '\\\\S'"), "doc_id", "text", backends.hashed_vectors(64))
    return rows.select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'))"
#: What first_sentence() answers: the first of the sentences that share most words with the question.
_ANSWERS = f"""c AS (SELECT conv_id || ':' || turn AS id, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations),
  s AS (SELECT id, text, context, list_filter(string_split(regexp_replace(context, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM c WHERE context IS NOT NULL),
  n AS (SELECT *, list_transform(parts, lambda p: len(list_intersect({_WORDS.format("p")}, {_WORDS.format("text")}))) AS shares FROM s), a AS (SELECT id, text, context, coalesce(parts[list_position(shares, list_max(shares))], '') AS answer FROM n)"""


def _key_terms(column):
    return _TERMS.replace("lower(text)", f"lower({column})")


_COVERED = f"CASE WHEN len({_key_terms('answer')}) = 0 THEN 0.0 ELSE len(list_intersect({_key_terms('answer')}, {_key_terms('context')})) / len({_key_terms('answer')}) END"
_UNION = f"len(list_distinct(list_concat({_key_terms('answer')}, {_key_terms('text')})))"


def _answers(t):
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.withColumn("context", before).filter("context is not null").withColumn("id", F.struct("conv_id", "turn"))
    rows = rows.select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text", "context")

    def down(questions, contexts):
        raise ConnectionError("no model here")

    return rows.join(backends.generated(rows, "id", "text", "context", [down, backends.first_sentence()]), "id")


@query("udf_generate", f"WITH {_ANSWERS} SELECT id, answer, 1 AS backend FROM a")
def udf_generate(t):
    """Answers by a chain of backends whose first always fails."""
    return _answers(t).select("id", "answer", "backend")


@query("udf_hallucination_score", f"WITH {_ANSWERS} SELECT id, CAST(trunc({_COVERED} * 100) AS INTEGER) AS score FROM a")
def udf_hallucination_score(t):
    """The stand-in for a model's own score: how much of an answer's key terms the context has, of 100."""
    covered = tx.coverage(tx.key_terms("answer", lists.STOP_WORDS), tx.key_terms("context", lists.STOP_WORDS))
    return _answers(t).select("id", (covered * 100).cast("int").alias("score"))


@query("udf_ragas_metrics", f"WITH {_ANSWERS} SELECT id, {_COVERED} AS faithfulness, CASE WHEN {_UNION} = 0 THEN 0.0 ELSE len(list_intersect({_key_terms('answer')}, {_key_terms('text')})) / {_UNION} END AS relevancy FROM a")
def udf_ragas_metrics(t):
    """Faithfulness and relevancy by coverage, cleaned as a model's scores would be."""
    terms = lambda c: tx.key_terms(c, lists.STOP_WORDS)
    rows = _answers(t)
    return rows.select("id", rules.sanitize_score(tx.coverage(terms("answer"), terms("context"))).alias("faithfulness"), rules.sanitize_score(tx.jaccard(terms("answer"), terms("text"))).alias("relevancy"))


@query("udf_nl2sql", f"SELECT conv_id, turn, n FROM (SELECT conv_id, turn, CASE WHEN contains(lower(q), 'current') THEN 'F' WHEN contains(lower(q), 'next') THEN 'O' END AS s FROM {ASKED_SQL}) JOIN (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1) USING (s)")
def udf_nl2sql(t):
    """Questions that a template answers, as guarded SQL over orders: the number of rows each would count."""
    template = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus LIMIT 10"
    counted = sql.run_template(t, template, {})
    routed = asked(t).select("conv_id", "turn", F.when(F.lower("q").contains("current"), "F").when(F.lower("q").contains("next"), "O").alias("o_orderstatus")).filter("o_orderstatus is not null")
    return routed.join(F.broadcast(counted), "o_orderstatus").select("conv_id", "turn", "n")


@query(
    "udf_classify_llm",
    """SELECT doc_id, CASE WHEN length(text) % 4 = 3 THEN 'partial' ELSE 'completed' END AS status, CASE WHEN length(text) % 4 < 3 THEN 'lang:' || lang END AS tag,
       CASE WHEN length(text) % 4 = 3 THEN NULL WHEN length(text) % 100 / 100 < 0.4 THEN 'discard' ELSE 'apply' END AS decision FROM documents""",
)
def udf_classify_llm(t):
    """Tags from a model's answers (here a stand-in's): batches, parsing with repair, the decision table; an answer without an object leaves a document partly done."""
    head = F.concat(F.lit("Source: "), "source", F.lit("\nLanguage: "), "lang", F.lit("\nLength: "), F.length("text").cast("string"), F.lit("\n\n"), "text")
    answers = enrichment.prompted(t.documents.select("doc_id", head.alias("prompt")), ["doc_id"], "prompt", enrichment.tagging_stand_in)
    rows = answers.select("doc_id", enrichment.parsed(F.col("answer"), "tags array<struct<tag:string,confidence:double>>").alias("p"))
    tags = rows.select("doc_id", F.when(F.col("p").isNull(), "partial").otherwise("completed").alias("status"), F.explode_outer("p.tags").alias("g"))
    return tags.select("doc_id", "status", "g.tag", F.when(F.col("g").isNotNull(), rules.decision(F.col("g.confidence"), 0.4, F.lit(False))).alias("decision"))


_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"


@query(
    "udf_enrich_synopsis_entities",
    f"""WITH c AS (SELECT doc_id, i, substr(text, 1 + 500 * i, 500) AS t FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 500) AS BIGINT)))) AS i FROM documents))
        SELECT doc_id, i // 8 AS batch, count(*) AS n_chunks, CAST(sum(length(t)) AS BIGINT) AS n_chars, array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(t, '{_MAIL}'))))), ',') AS entities FROM c GROUP BY ALL""",
)
def udf_enrich_synopsis_entities(t):
    """Entities from a model's answers (here a stand-in's) to batches of eight chunks of 500 characters, joined back to their batches."""
    batches = enrichment.chunk_batches(t.documents, "doc_id", "text")
    answers = enrichment.prompted(batches, ["doc_id", "batch", "n_chunks", "n_chars"], "prompt", enrichment.mail_stand_in)
    found = enrichment.parsed(F.col("answer"), "array<struct<entity_type:string,value:string,confidence:double,chunk_index:int>>")
    values = F.array_sort(F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<struct<entity_type:string,value:string,confidence:double,chunk_index:int>>")), lambda x: x["value"])))
    return answers.select("doc_id", "batch", "n_chunks", "n_chars", F.array_join(values, ",").alias("entities"))


@query(
    "udf_summary_chunk",
    """WITH c AS (SELECT conv_id, count(*) AS n, CAST(sum(len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''))) AS BIGINT) AS w FROM conversations GROUP BY 1),
            a AS (SELECT conv_id, n, w, [w || ' words' || chr(10) || 'in ' || n || ' chunks.', CAST(w AS VARCHAR), 'CARRIER: none' || chr(10) || 'Nothing to say of ' || w || ' words.'][1 + w % 4] AS said FROM c WHERE w % 4 < 3)
       SELECT conv_id, -1 AS chunk_index, 'Document Summary' AS section, 'DOCUMENT SUMMARY: ' || said AS text, CAST(length('DOCUMENT SUMMARY: ' || said) // 4 AS INT) AS token_count, CASE w % 4 WHEN 0 THEN 'policy' ELSE 'other' END AS document_type,
              CASE w % 4 WHEN 0 THEN 'Carrier ' || n WHEN 1 THEN 'unknown' ELSE 'none' END AS carrier, CASE w % 4 WHEN 0 THEN '01/01/2024-01/01/2025' ELSE 'unknown' END AS policy_period, n AS n_chunks, w AS n_words FROM a""",
)
def udf_summary_chunk(t):
    """Each conversation's summary as a chunk of its own, its fields read from a model's answer (here a stand-in's)."""
    return enrichment.summaries(t.conversations, "conv_id", "turn", "text", enrichment.summary_stand_in)


@query("udf_token_count", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def udf_token_count(t):
    return t.documents.select("doc_id", F.expr("length(text) div 4").alias("tokens"))
