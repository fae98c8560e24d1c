"""Joins."""

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import cosine
from ..operators import joins as jn
from .registry import query


@query("join_inner_equi", "SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1")
def join_inner_equi(t):
    rows = t.lineitem.filter("l_returnflag = 'R'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("join_left_outer", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_left_outer(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("join_left_filtered_on", "SELECT c_custkey, count(o_orderkey) AS n_urgent FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1")
def join_left_filtered_on(t):
    right = t.orders.filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return t.customer.select("c_custkey").join(right, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_urgent"))


@query(
    "join_lateral_top1",
    "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) ON true",
)
def join_lateral_top1(t):
    right = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    return jn.latest_of(t.customer.select("c_custkey"), right, "c_custkey", [F.desc("o_orderdate"), F.asc("o_orderkey")]).drop("o_orderdate")


@query("join_many_to_many_bridge", "SELECT doc_id FROM documents WHERE lang = 'de' OR source IN ('src1', 'src2')")
def join_many_to_many_bridge(t):
    bridge = t.documents.select("doc_id", F.explode(F.array("lang", "source")).alias("tag"))
    return t.documents.join(bridge.filter(F.col("tag").isin("de", "src1", "src2")), "doc_id").select("doc_id").distinct()


@query("join_semi_any", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1-%')")
def join_semi_any(t):
    return t.customer.join(t.orders.filter(F.col("o_orderpriority").like("1-%")), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("join_anti_orphan", "SELECT c_custkey FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997) ON c_custkey = o_custkey WHERE o_custkey IS NULL")
def join_anti_orphan(t):
    return t.customer.join(t.orders.filter(F.year("o_orderdate") == 1997), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(
    "join_full_reconcile",
    """WITH a AS (SELECT doc_id, doc_id % 3 AS n FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT vec_id AS doc_id, vec_id % 3 + (vec_id % 11 = 0)::INT AS m FROM embeddings),
       i AS (SELECT CASE WHEN m IS NULL THEN 'ghost_doc' WHEN n IS NULL THEN 'orphan_vectors' WHEN n <> m THEN 'chunk_count_mismatch' END AS issue FROM a FULL JOIN b USING (doc_id))
       SELECT coalesce(issue, 'synced') AS issue, count(*) AS n FROM i GROUP BY 1""",
)
def join_full_reconcile(t):
    stored = t.documents.filter("doc_id % 5 <> 0").select("doc_id", (F.col("doc_id") % 3).alias("n"))
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 3 + (F.col("vec_id") % 11 == 0).cast("int")).alias("m"))
    found = jn.reconcile(stored, vectors, "doc_id", "n", "m")
    return found.groupBy(F.coalesce("issue", F.lit("synced")).alias("issue")).agg(F.count("*").alias("n"))


@query("join_eager_load", "SELECT conv_id, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS messages FROM conversations GROUP BY conv_id")
def join_eager_load(t):
    message = F.concat("role", F.lit(":"), F.length("text"))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]), ",").alias("messages"))


@query(
    "join_cross_candidates",
    """SELECT n_nationkey, max(round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6)) AS best
       FROM embeddings e CROSS JOIN (SELECT n_nationkey, embedding FROM nation JOIN embeddings ON n_nationkey = vec_id) p WHERE e.vec_id <> n_nationkey GROUP BY 1""",
)
def join_cross_candidates(t):
    """Every candidate against the few probes of a fixed table (one for each nation, 25 rows)."""
    probes = t.nation.join(t.embeddings.withColumnRenamed("vec_id", "n_nationkey"), "n_nationkey").select("n_nationkey", F.col("embedding").alias("probe"))
    rows = t.embeddings.join(F.broadcast(probes), F.col("vec_id") != F.col("n_nationkey"))
    return rows.groupBy("n_nationkey").agg(F.max(F.round(cosine("embedding", "probe"), 6)).alias("best"))


@query(
    "join_trigger_lookup",
    """WITH c AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]{2,}'))) AS toks FROM documents),
            k AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]{2,}'))) AS need FROM benchmark)
       SELECT doc_id, item_id FROM c, k WHERE len(need) > 0 AND list_has_all(toks, need)""",
)
def join_trigger_lookup(t):
    """Entries (here benchmark items) of which all keywords are in a document."""
    asked = t.documents.select("doc_id", tokens("text").alias("tokens"))
    entries = t.benchmark.select("item_id", tokens("text").alias("tokens")).filter(F.size("tokens") > 0)
    return jn.keyword_lookup(asked, entries, "doc_id", "item_id")


@query("join_dual_registry_override", "SELECT table_name, CASE WHEN n_regionkey % 2 = 0 THEN 'document' ELSE 'sheet' END AS registry FROM (SELECT n_name AS table_name, n_regionkey FROM nation)")
def join_dual_registry_override(t):
    sheet = t.nation.select(F.col("n_name").alias("table_name"), F.lit("sheet").alias("registry"))
    document = t.nation.filter("n_regionkey % 2 = 0").select(F.col("n_name").alias("table_name"), F.lit("document").alias("registry"))
    return jn.override([document, sheet], ["table_name"])


@query("join_duplicate_check", "SELECT p_name IN (SELECT p_name FROM part WHERE p_size > 45) AS duplicate, count(*) AS n FROM part WHERE p_size <= 45 GROUP BY 1")
def join_duplicate_check(t):
    old, new = jn.duplicates(t.part.filter("p_size <= 45"), t.part.filter("p_size > 45"), ["p_name"])
    return old.select(F.lit(True).alias("duplicate")).unionByName(new.select(F.lit(False).alias("duplicate"))).groupBy("duplicate").agg(F.count("*").alias("n"))
