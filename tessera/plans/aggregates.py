"""Aggregates."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import aggregates as agg
from .registry import query


@query("agg_count_group", "SELECT CASE WHEN contains(p_type, ':') THEN split_part(p_type, ':', 1) ELSE 'other' END AS namespace, p_type AS tag, count(*) AS n FROM part GROUP BY ALL")
def agg_count_group(t):
    namespace = F.when(F.col("p_type").contains(":"), F.split_part("p_type", F.lit(":"), F.lit(1))).otherwise("other")
    return t.part.groupBy(namespace.alias("namespace"), F.col("p_type").alias("tag")).agg(F.count("*").alias("n"))


@query("agg_count_max_group_topn", "SELECT user_id, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def agg_count_max_group_topn(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last")).orderBy(F.desc("n"), "user_id").limit(10)


@query(
    "agg_conditional_count",
    "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS open, CAST(trunc(count(*) FILTER (o_orderstatus = 'F') / count(*) * 100) AS BIGINT) AS percent FROM orders GROUP BY 1",
)
def agg_conditional_count(t):
    done = F.count_if(F.col("o_orderstatus") == "F")
    return t.orders.groupBy("o_custkey").agg(done.alias("done"), F.count_if(F.col("o_orderstatus") == "P").alias("open"), (done / F.count("*") * 100).cast("long").alias("percent"))


@query("agg_avg_nullable", "SELECT round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, round(avg(CASE WHEN quality > 1 THEN 1 END), 6) AS none FROM labels")
def agg_avg_nullable(t):
    return t.labels.agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.round(F.avg(F.when(F.col("quality") > 1, 1)), 6).alias("none"))


@query("agg_count_null_cells", "SELECT CAST(sum((quality IS NULL)::INT + (toxic IS NULL)::INT) AS BIGINT) AS n FROM documents LEFT JOIN labels USING (doc_id)")
def agg_count_null_cells(t):
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return rows.agg(F.sum(F.col("quality").isNull().cast("long") + F.col("toxic").isNull().cast("long")).alias("n"))


@query(
    "agg_avg_of_avgs",
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) AS a FROM orders GROUP BY 1), l AS (SELECT * FROM m ORDER BY month DESC LIMIT 10)
       SELECT month, round(a, 4) AS a, (SELECT round(avg(a), 4) FROM l) AS mean_of_means FROM l""",
)
def agg_avg_of_avgs(t):
    months = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.avg("o_totalprice").alias("a")).orderBy(F.desc("month")).limit(10)
    return months.select("month", F.round("a", 4).alias("a"), F.round(F.avg("a").over(W.partitionBy()), 4).alias("mean_of_means")).orderBy("month")


@query("agg_time_bucket_hour", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' GROUP BY 1")
def agg_time_bucket_hour(t):
    day = t.events.filter("ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-16 00:00:00'")
    return day.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query(
    "agg_sum_case_min",
    "SELECT l_returnflag, count(*) AS n, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS closed, CAST(sum(CASE WHEN l_shipdate <= TIMESTAMP '1996-01-01' THEN 1 ELSE 0 END) AS BIGINT) AS old, CAST(min(l_shipdate) AS DATE) AS first FROM lineitem GROUP BY 1",
)
def agg_sum_case_min(t):
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), flag(F.col("l_linestatus") == "F").alias("closed"), flag(F.expr("l_shipdate <= TIMESTAMP_NTZ '1996-01-01 00:00:00'")).alias("old"), F.min("l_shipdate").cast("date").alias("first")
    )


_COST = "SELECT CAST(ts AS DATE) AS day, coalesce(sum(value), 0) AS spent, count(*) AS n FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1"


@query("agg_coalesce_sum_period", f"SELECT day, round(spent, 4) AS spent, n, round(greatest(1500 - spent, 0), 4) AS remaining, round(spent / 1500, 4) AS used, spent > 1500 AS over_cap FROM ({_COST})")
def agg_coalesce_sum_period(t):
    spent = F.coalesce(F.sum("value"), F.lit(0.0))
    days = t.events.filter(F.col("event_type").isin("purchase", "signup")).groupBy(F.col("ts").cast("date").alias("day")).agg(spent.alias("spent"), F.count("*").alias("n"))
    return days.select("day", F.round("spent", 4).alias("spent"), "n", F.round(F.greatest(1500 - F.col("spent"), F.lit(0.0)), 4).alias("remaining"), F.round(F.col("spent") / 1500, 4).alias("used"), (F.col("spent") > 1500).alias("over_cap"))


@query("agg_min_max", "SELECT count(*) AS n, CAST(min(o_orderdate) AS DATE) AS oldest, CAST(max(o_orderdate) AS DATE) AS newest, count(*) * 10240 AS bytes FROM orders")
def agg_min_max(t):
    return t.orders.agg(F.count("*").alias("n"), F.min("o_orderdate").cast("date").alias("oldest"), F.max("o_orderdate").cast("date").alias("newest"), (F.count("*") * 10240).alias("bytes"))


@query("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def agg_count_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("agg_chunk_count_per_doc", "SELECT l_orderkey, count(*) AS chunks FROM lineitem GROUP BY 1")
def agg_chunk_count_per_doc(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("chunks"))


@query("agg_accuracy_threshold", "SELECT source, round(coalesce(avg(quality), 0), 6) AS accuracy, coalesce(avg(quality), 0) >= 0.9 AS passed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def agg_accuracy_threshold(t):
    rate = F.coalesce(F.avg("quality"), F.lit(0.0))
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.round(rate, 6).alias("accuracy"), (rate >= 0.9).alias("passed"))


@query(
    "agg_suggestion_outcomes",
    """SELECT source, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'already_processed') AS already FROM (
         SELECT source, CASE WHEN quality IS NULL THEN 'failed' WHEN toxic = 1 THEN 'already_processed' WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS status FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""",
)
def agg_suggestion_outcomes(t):
    status = F.when(F.col("quality").isNull(), "failed").when(F.col("toxic") == 1, "already_processed").when(F.col("quality") == 1, "approved").otherwise("rejected")
    rows = t.documents.join(t.labels, "doc_id", "left").select("source", status.alias("status"))
    n = lambda s: F.count_if(F.col("status") == s)
    return rows.groupBy("source").agg(n("approved").alias("approved"), n("failed").alias("failed"), n("already_processed").alias("already"))


@query(
    "agg_weighted_score",
    "SELECT lang, round(coalesce(sum(quality * n_chars::DOUBLE) / nullif(sum(n_chars::DOUBLE), 0), 0), 6) AS score, coalesce(sum(quality * n_chars::DOUBLE) / nullif(sum(n_chars::DOUBLE), 0), 0) >= 0.7 AS passed FROM documents JOIN labels USING (doc_id) GROUP BY 1",
)
def agg_weighted_score(t):
    score = agg.weighted(F.col("quality"), F.col("n_chars").cast("double"))
    return t.documents.join(t.labels, "doc_id").groupBy("lang").agg(F.round(score, 6).alias("score"), (score >= 0.7).alias("passed"))


@query(
    "agg_column_totals",
    """SELECT 'p_size' AS name, round(sum(p_size::DOUBLE), 2) AS total FROM part UNION ALL SELECT 'p_retailprice', round(sum(p_retailprice), 2) FROM part""",
)
def agg_column_totals(t):
    """Of four columns two are text, and drop out."""
    return agg.numeric_totals(t.part, "p_partkey", ["p_name", "p_brand", "p_size", "p_retailprice"])


@query(
    "agg_percentiles",
    """WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT l_returnflag, v[CAST(floor(n * 0.5) AS INT) + 1] AS p50, v[least(CAST(floor(n * 0.95) AS INT), n - 1) + 1] AS p95, v[least(CAST(floor(n * 0.99) AS INT), n - 1) + 1] AS p99 FROM s""",
)
def agg_percentiles(t):
    return agg.index_percentiles(t.lineitem, "l_returnflag", "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("agg_histogram_snapshot", "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def agg_histogram_snapshot(t):
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"), r(F.min("value")).alias("least"), r(F.max("value")).alias("most"), r(F.avg("value")).alias("mean"))


@query("agg_counter_labels", "SELECT 'events_total{type=\"' || event_type || '\",user=\"' || (user_id % 5) || '\"} ' || count(*) AS line FROM events GROUP BY event_type, user_id % 5")
def agg_counter_labels(t):
    counted = t.events.groupBy("event_type", (F.col("user_id") % 5).alias("u")).agg(F.count("*").alias("n"))
    return counted.select(F.format_string('events_total{type="%s",user="%d"} %d', "event_type", "u", "n").alias("line"))


@query(
    "agg_mode_tag",
    """WITH c AS (SELECT l_suppkey, p_brand, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS p FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#1' GROUP BY ALL)
       SELECT l_suppkey, arg_max(p_brand, n * 1000000000 - p) AS p_brand FROM c GROUP BY 1""",
)
def agg_mode_tag(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).filter("p_brand <> 'Brand#1'").withColumn("p", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return agg.mode(rows, "l_suppkey", "p_brand", "p")


@query(
    "agg_estimate_eta",
    """WITH a AS (SELECT coalesce(avg(o_totalprice / 100) FILTER (o_orderstatus = 'F' AND o_totalprice > 0), 5000) AS ms, count(*) FILTER (o_orderstatus = 'P') AS n FROM orders), s AS (SELECT ms * n / 1000 AS sec FROM a)
       SELECT CASE WHEN sec < 60 THEN CAST(trunc(sec) AS BIGINT) || ' seconds' WHEN sec < 3600 THEN CAST(trunc(sec / 60) AS BIGINT) || ' minutes' ELSE round(sec / 3600, 1) || ' hours' END AS eta FROM s""",
)
def agg_estimate_eta(t):
    mean = F.coalesce(F.avg(F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 0), F.col("o_totalprice") / 100)), F.lit(5000.0))
    s = t.orders.agg((mean * F.count_if(F.col("o_orderstatus") == "P") / 1000).alias("s"))
    eta = F.when(F.col("s") < 60, F.concat(F.col("s").cast("long"), F.lit(" seconds"))).when(F.col("s") < 3600, F.concat((F.col("s") / 60).cast("long"), F.lit(" minutes")))
    return s.select(eta.otherwise(F.concat(F.round(F.col("s") / 3600, 1), F.lit(" hours"))).alias("eta"))


@query(
    "agg_mean_pool_vectors",
    "SELECT label, CAST(i - 1 AS INTEGER) AS place, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL",
)
def agg_mean_pool_vectors(t):
    return agg.mean_vectors(t.embeddings, "label", "embedding").withColumn("mean", F.round("mean", 6))


@query(
    "agg_list_dedup_first3",
    """WITH s AS (SELECT o_custkey, o_orderpriority AS v, min((o_orderdate, o_orderkey)) AS o FROM orders GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o, v) AS k FROM s)
       SELECT o_custkey, string_agg(v, ', ' ORDER BY k) AS firsts FROM k WHERE k <= 3 GROUP BY 1""",
)
def agg_list_dedup_first3(t):
    return agg.first_seen(t.orders, "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"], 3)


@query(
    "recompute_counts",
    "SELECT source, n_docs % 7 + 40 AS stored, n_labels AS actual FROM (SELECT source, count(*) AS n_docs, count(quality) AS n_labels FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) WHERE n_docs % 7 + 40 <> n_labels",
)
def recompute_counts(t):
    """Stored counts (here made from the number of documents) that differ from the true ones."""
    stored = t.documents.groupBy("source").agg((F.count("*") % 7 + 40).alias("stored"))
    actual = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count("quality").alias("actual"))
    both = stored.join(actual, "source", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return both.filter("stored <> actual").select("source", "stored", "actual")
