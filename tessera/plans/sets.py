"""Set operations and removal of duplicates."""

from pyspark.sql import functions as F

from ..operators import sets as st
from ..operators import windows as win
from .registry import query


@query("union_all_tagged", "SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL")
def union_all_tagged(t):
    """One table a year, as many as there are years, put together again."""
    first, last = t.orders.agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    years = {str(y): t.orders.filter((F.col("o_orderdate") >= F.lit(f"{y}-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(f"{y + 1}-01-01").cast("timestamp_ntz"))) for y in range(first, last + 1)}
    return st.union_tagged(years, "year").filter("o_orderpriority IS NOT NULL").groupBy("year", "o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "union_unified_jobs",
    """SELECT id, source, status, CASE WHEN status IN ('done', 'failed') THEN 'ended' END AS summary FROM (
         SELECT o_orderkey AS id, 'orders' AS source, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'running' ELSE 'pending' END AS status FROM orders WHERE o_orderkey % 3 = 0
         UNION ALL SELECT event_id, 'events', CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END FROM events WHERE event_id % 3 <> 0 OR event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0))""",
)
def union_unified_jobs(t):
    """Jobs of two tables under one id; the first table wins. What orders lack here comes from events."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "running").otherwise("pending")
    first = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("source"), status.alias("status"))
    second = t.events.select(F.col("event_id").alias("id"), F.lit("events").alias("source"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"))
    return st.first_found([first, second], "id").withColumn("summary", F.when(F.col("status").isin("done", "failed"), "ended"))


@query(
    "union_all_orphans",
    "SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996) UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5 AND l_discount > 0.08)",
)
def union_all_orphans(t):
    a = t.customer.join(t.orders.filter(F.year("o_orderdate") == 1996), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))
    b = t.supplier.join(t.lineitem.filter("l_quantity > 49.5 AND l_discount > 0.08"), F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select(F.col("s_suppkey").alias("id"))
    return st.union_tagged({"customer": a, "supplier": b}, "kind").select("kind", "id")


@query("set_difference_ids", "SELECT vec_id AS id FROM embeddings EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def set_difference_ids(t):
    return t.embeddings.select(F.col("vec_id").alias("id")).subtract(t.labels.filter("quality = 1").select(F.col("doc_id").alias("id")))


@query("set_intersection_tags", "SELECT doc_id, (lang = 'en')::BIGINT + (source IN ('src0', 'src1'))::BIGINT AS overlap FROM documents")
def set_intersection_tags(t):
    own = F.array(F.lit("en"), F.lit("src0"), F.lit("src1"))
    return t.documents.select("doc_id", F.size(F.array_intersect(F.array("lang", "source"), own)).cast("long").alias("overlap"))


@query("distinct_rows", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_rows(t):
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()


@query(
    "interleave_round_robin",
    """WITH r AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents)
       SELECT doc_id, source, place FROM (SELECT *, row_number() OVER (PARTITION BY substr(text, 1, 200) ORDER BY place, source) AS k FROM r) WHERE k = 1""",
)
def interleave_round_robin(t):
    return st.interleave(t.documents, "source", "doc_id", "text").select("doc_id", "source", F.col("place").cast("long").alias("place"))


@query(
    "dedup_jaccard_greedy",
    """WITH RECURSIVE m AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
            f AS (SELECT conv_id, k, turn, [w] AS kept, true AS keep FROM m WHERE k = 1
                  UNION ALL SELECT conv_id, k, turn, CASE WHEN alike THEN kept ELSE list_append(kept, w) END, NOT alike FROM (
                    SELECT m.conv_id, m.k, m.turn, m.w, f.kept, len(list_filter(f.kept, lambda y: len(m.w) + len(y) > 0 AND len(list_intersect(m.w, y)) / (len(m.w) + len(y) - len(list_intersect(m.w, y))) > 0.9)) > 0 AS alike
                    FROM f JOIN m ON m.conv_id = f.conv_id AND m.k = f.k + 1))
       SELECT conv_id, turn FROM f WHERE keep""",
)
def dedup_jaccard_greedy(t):
    """In each conversation the messages that are not 0.9 alike to one kept before."""
    rows = t.conversations.withColumn("w", F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")))
    return win.greedy_distinct(rows, "conv_id", ["turn"], "turn", "w", 0.9)


@query("dedup_content_hash", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedup_content_hash(t):
    return st.by_content(t.documents, "text", "doc_id")


@query("idempotency_key", "SELECT doc_id, sha256(sha256(text) || ':' || source || ':') AS key FROM documents")
def idempotency_key(t):
    return t.documents.select("doc_id", st.idempotency_key(F.sha2("text", 256), F.col("source"), F.lit(None)).alias("key"))


@query("dedup_citations", "SELECT conv_id, (conv_id * 7 + turn) % 5 AS source_id, min(turn) AS turn FROM conversations GROUP BY ALL")
def dedup_citations(t):
    cited = t.conversations.withColumn("source_id", (F.col("conv_id") * 7 + F.col("turn")) % 5)
    return win.first_per_group(cited, ["conv_id", "source_id"], [F.col("turn")]).select("conv_id", "source_id", "turn")


@query(
    "dedup_ordered_tags",
    "SELECT p_partkey, CASE WHEN lower(trim(p_type)) = split_part(p_name, ' ', 1) THEN lower(p_type) ELSE lower(p_type) || ',' || split_part(p_name, ' ', 1) END || CASE WHEN split_part(p_name, ' ', 2) IN (lower(p_type), split_part(p_name, ' ', 1)) THEN '' ELSE ',' || split_part(p_name, ' ', 2) END AS tags FROM part",
)
def dedup_ordered_tags(t):
    tags = F.transform(F.array(F.concat(F.lit(" "), "p_type"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))), lambda x: F.lower(F.trim(x)))
    valid = F.filter(F.array_distinct(tags), lambda x: x.rlike("^[a-z0-9][a-z0-9:-]{0,63}$"))
    return t.part.select("p_partkey", F.array_join(valid, ",").alias("tags"))
