"""Ranked and windowed operators."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import windows as win
from .registry import query


@query(
    "win_latest_per_group",
    "SELECT conv_id, n, preview FROM (SELECT conv_id, substr(text, 1, 100) AS preview, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'user') WHERE k = 1",
)
def win_latest_per_group(t):
    last = t.conversations.filter("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("n"), F.max_by(F.substring("text", 1, 100), "turn").alias("preview"))
    return last


@query("win_limit_per_document", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem) WHERE k <= 2")
def win_limit_per_document(t):
    return win.first_per_group(t.lineitem, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")], 2).select("l_orderkey", "l_linenumber")


@query("win_priority_first_per_namespace", "SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS k FROM part WHERE p_brand <> 'Brand#3') WHERE k = 1")
def win_priority_first_per_namespace(t):
    return win.first_per_group(t.part.filter("p_brand <> 'Brand#3'"), ["p_type"], [F.desc("p_size"), F.asc("p_partkey")]).select("p_type", "p_partkey")


@query("win_monotonic_seq", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def win_monotonic_seq(t):
    return win.numbered(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "seq").select("event_id", "seq")


@query("win_ring_buffer_keep_n", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 1000")
def win_ring_buffer_keep_n(t):
    """The ring buffer holds the thousand newest events: its size is the feature."""
    return t.events.orderBy(F.desc("event_id")).limit(1000).select("event_id")


@query(
    "win_running_token_budget_stop",
    "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS s FROM conversations) WHERE s <= 400",
)
def win_running_token_budget_stop(t):
    rows = t.conversations.withColumn("cost", F.expr("length(text) div 4"))
    return win.within_budget(rows, ["conv_id"], [F.desc("turn")], "cost", 400).select("conv_id", "turn")


@query(
    "win_greedy_fit_skip",
    """WITH RECURSIVE c AS (SELECT source, doc_id, n_chars // 4 AS cost, row_number() OVER (PARTITION BY source ORDER BY -coalesce(quality, 0), doc_id) AS k FROM documents LEFT JOIN labels USING (doc_id)),
            f AS (SELECT source, k, CASE WHEN cost <= 3000 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 3000 THEN doc_id END AS doc_id FROM c WHERE k = 1
                  UNION ALL SELECT c.source, c.k, CASE WHEN used + cost <= 3000 THEN used + cost ELSE used END, CASE WHEN used + cost <= 3000 THEN c.doc_id END FROM f JOIN c ON c.source = f.source AND c.k = f.k + 1 WHERE c.k <= 15)
       SELECT source, doc_id FROM f WHERE doc_id IS NOT NULL""",
)
def win_greedy_fit_skip(t):
    """For each source: of its 15 best documents (by quality, then id) those that fit 3,000 tokens one after the other. 15 is the operator's limit of candidates."""
    rows = t.documents.join(t.labels, "doc_id", "left").withColumn("cost", F.expr("n_chars div 4")).withColumn("o", -F.coalesce("quality", F.lit(0)))
    return win.fit_and_skip(rows, "source", F.col("o"), "doc_id", "cost", 3000, 15)


@query(
    "win_budget_split",
    """SELECT conv_id, available, least(1000, available // 3) AS history, least(3000, available - least(1000, available // 3)) AS context
       FROM (SELECT conv_id, 8192 - CAST(sum(length(text)) FILTER (role = 'system') AS BIGINT) // 4 - 1024 AS available FROM conversations GROUP BY 1) WHERE available >= 0""",
)
def win_budget_split(t):
    system = F.sum(F.when(F.col("role") == "system", F.length("text")))
    rows = t.conversations.groupBy("conv_id").agg(system.cast("long").alias("s")).select("conv_id", F.expr("8192 - s div 4 - 1024").alias("available")).filter("available >= 0")
    history = F.least(F.lit(1000), F.expr("available div 3"))
    return rows.select("conv_id", "available", history.alias("history"), F.least(F.lit(3000), F.col("available") - history).alias("context"))


@query(
    "win_session_gap_chunks",
    """SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
       WHERE n <= 9 OR k <= 3 OR k > n - 3 OR (k > n // 2 - 1 AND k <= n // 2 + 2)""",
)
def win_session_gap_chunks(t):
    return win.spread_sample(t.documents.select("source", "doc_id"), "source", "doc_id").select("source", "doc_id")


@query("win_lru_evict", "SELECT user_id FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) ORDER BY last DESC, user_id LIMIT 50")
def win_lru_evict(t):
    """The users that a cache of fifty entries still holds after all events."""
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "user_id").limit(50).select("user_id")


@query("win_prev_next_scd", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS valid_from, CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS DATE) AS valid_to FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)")
def win_prev_next_scd(t):
    rows = t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("valid_from")).distinct()
    return win.versions(rows, "o_custkey", "valid_from")


# sort, limit, pages


@query("sort_dynamic", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def sort_dynamic(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(100)


@query("page_offset_limit", "SELECT c_custkey, (SELECT count(*) FROM customer) AS total FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50)")
def page_offset_limit(t):
    page = t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").offset(50).limit(25).select("c_custkey")
    return page.join(F.broadcast(t.customer.agg(F.count("*").alias("total"))))


@query(
    "page_keyset_cursor",
    "SELECT conv_id, turn, (SELECT count(*) FROM conversations WHERE (conv_id, turn) > (20, 3)) > 20 AS has_more FROM conversations WHERE (conv_id, turn) > (20, 3) ORDER BY conv_id, turn LIMIT 20",
)
def page_keyset_cursor(t):
    """The page after a cursor; one row more than the page tells if more follow."""
    after = t.conversations.filter("conv_id > 20 OR (conv_id = 20 AND turn > 3)").orderBy("conv_id", "turn").limit(21).select("conv_id", "turn")
    k = F.row_number().over(W.partitionBy().orderBy("conv_id", "turn"))  # 21 rows
    return after.withColumn("k", k).withColumn("has_more", (F.count("*").over(W.partitionBy()) > 20)).filter("k <= 20").drop("k")


@query("limit_least_params", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def limit_least_params(t):
    return t.spark.sql("SELECT o_orderkey FROM {orders} ORDER BY o_orderdate DESC, o_orderkey LIMIT least(:limit, :row_cap)", args={"limit": 20, "row_cap": 50}, orders=t.orders)


@query("sort_year_tag_desc", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'year:0000' ELSE 'year:' || year(o_orderdate) END AS year_tag FROM orders ORDER BY year_tag DESC, o_orderkey LIMIT 200")
def sort_year_tag_desc(t):
    tags = F.when(F.col("o_orderstatus") == "P", F.array("o_orderpriority")).otherwise(F.array(F.col("o_orderpriority"), F.concat(F.lit("year:"), F.year("o_orderdate"))))
    tag = F.coalesce(F.try_element_at(F.filter(tags, lambda x: x.startswith("year:")), F.lit(1)), F.lit("year:0000"))
    return t.orders.select("o_orderkey", tag.alias("year_tag")).orderBy(F.desc("year_tag"), "o_orderkey").limit(200)


@query(
    "topn_soonest_future",
    """WITH r AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), f AS (SELECT *, d >= DATE '2000-01-01' AS future FROM r),
            g AS (SELECT *, max(future::INT) OVER (PARTITION BY o_custkey) AS any_future FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey) AS k FROM g WHERE any_future = 0 OR future)
       SELECT o_custkey, o_orderkey FROM k WHERE k <= 2""",
)
def topn_soonest_future(t):
    """The next two dates of each customer from a day on, or the first two if none is left."""
    day = F.col("o_orderdate").cast("date")
    rows = t.orders.select("o_custkey", "o_orderkey", day.alias("d"), (day >= F.lit("2000-01-01").cast("date")).alias("future"))
    rows = rows.withColumn("any_future", F.max("future").over(W.partitionBy("o_custkey"))).filter("future OR NOT any_future")
    return win.first_per_group(rows, ["o_custkey"], [F.col("d"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")
