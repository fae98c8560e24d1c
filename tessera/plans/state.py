"""States of jobs, and events as streams and as their batch forms."""

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import tenants
from ..operators import windows as win
from ..sources import connectors, modules, pages
from ..streaming import events as ev
from ..streaming import jobs
from .registry import query


def scratch(t):
    """A new folder: in the shared one that the session names; where it names none, and all runs on one machine, a temporary one."""
    where = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and not re.fullmatch(r"local(\[[^]]*\])?", t.spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: streams and files need a folder that all executors share")
    return f"{(where or 'file://' + tempfile.mkdtemp(prefix='tessera-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("stream_tumbling_hour", "WITH w AS (SELECT date_trunc('hour', ts) AS b, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1) SELECT strftime(b, '%Y-%m-%d %H') AS hour, n, mean FROM w WHERE b + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_tumbling_hour(t):
    """Hourly windows of the events as a stream; those that the watermark has closed."""
    streamed = ev.tumbling(ev.stream(t.events, f"{t.folder}/events.parquet*"), "1 hour", "10 minutes")
    out = ev.run_to_end(streamed, scratch(t), "append")
    return out.select(F.date_format("begin", "yyyy-MM-dd HH").alias("hour"), "n", "mean")


_OUTCOMES = {"click": "completed", "error": "failed", "signup": "skipped", "view": "paused"}


@query(
    "stream_progress_poll",
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, CASE event_type WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' WHEN 'view' THEN 'paused' ELSE 'running' END AS outcome FROM events),
            n AS (SELECT user_id, t, event_id, outcome, row_number() OVER o AS r, min(t) OVER u AS began, lag(outcome, 1, 'running') OVER o AS before,
                         count(*) FILTER (outcome = 'completed') OVER o AS completed, count(*) FILTER (outcome = 'failed') OVER o AS failed, count(*) FILTER (outcome = 'skipped') OVER o AS skipped,
                         count(*) FILTER (outcome IN ('completed', 'failed', 'skipped')) OVER u AS total
                  FROM e WINDOW u AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY t, event_id)),
            p AS (SELECT *, completed + failed + skipped AS processed, lag(completed + failed + skipped, 1, -1) OVER (PARTITION BY user_id ORDER BY r) AS told FROM n),
            l AS (SELECT user_id, began, min(r) AS last, min(t) AS ended FROM p WHERE processed >= total GROUP BY 1, 2), k AS (SELECT * FROM p JOIN l USING (user_id, began) WHERE r <= last)
       SELECT user_id, 'connected' AS kind, t AS at_us, NULL AS processed, NULL AS completed, NULL AS failed, NULL AS skipped, NULL AS total, CAST(NULL AS INT) AS percent, NULL AS status FROM k WHERE r = 1
       UNION ALL SELECT user_id, 'progress', t, processed, completed, failed, skipped, total, CAST(CASE WHEN total > 0 THEN processed * 100 // total ELSE 0 END AS INT), CASE outcome WHEN 'paused' THEN 'paused' ELSE 'running' END FROM k WHERE processed <> told
       UNION ALL SELECT user_id, 'paused', t, processed, completed, failed, skipped, total, NULL, 'paused' FROM k WHERE outcome = 'paused' AND before <> 'paused' AND r < last
       UNION ALL SELECT user_id, 'complete', t, processed, completed, failed, skipped, total, NULL, CASE WHEN failed > 0 THEN 'completed_with_errors' ELSE 'completed' END FROM k WHERE r = last
       UNION ALL SELECT user_id, 'heartbeat', unnest(generate_series(began + 86400000000, ended, 86400000000)), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM l""",
)
def stream_progress_poll(t):
    """What a client that follows each user's job is told: clicks, errors and sign-ups are queries that ended, a view is a pause."""
    outcome = F.create_map(*[F.lit(x) for pair in _OUTCOMES.items() for x in pair])[F.col("event_type")]
    of_job = t.events.groupBy(F.col("user_id").alias("key")).agg(F.count(F.when(F.col("event_type").isin("click", "error", "signup"), 1)).alias("total"))
    events = ev.stream(t.events, f"{t.folder}/events.parquet*").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.coalesce(outcome, F.lit("running")).alias("outcome"))
    with jobs.state_store(t.spark):
        told = ev.run_to_end(jobs.follow(events.join(of_job, "key")), scratch(t), "append")
    return told.withColumnRenamed("key", "user_id")


@query(
    "stream_replay_since",
    """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events),
            h AS (SELECT * FROM e WHERE seq > n - 50), c AS (SELECT DISTINCT user_id, [NULL, '60', 'b7e1-x', '2'][1 + user_id % 4] AS last FROM events), k AS (SELECT user_id, last, try_cast(last AS BIGINT) AS l FROM c)
       SELECT user_id, event_id, seq, 'event' AS kind FROM h JOIN k USING (user_id) WHERE l IS NULL OR seq > l
       UNION ALL SELECT user_id, NULL, l, 'state' FROM k JOIN (SELECT user_id, min(seq) AS oldest FROM h GROUP BY 1) USING (user_id) WHERE l < oldest - 1""",
)
def stream_replay_since(t):
    """A client for each user: some without a last number, some with one that is none, some whose next events are held no more."""
    rows = win.numbered(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "seq").select("user_id", "event_id", "seq")
    last = F.element_at(F.array(F.lit(None).cast("string"), F.lit("60"), F.lit("b7e1-x"), F.lit("2")), (1 + F.col("user_id") % 4).cast("int"))
    return ev.since(rows, t.events.select("user_id").distinct().withColumn("last", last), "user_id", "seq", 50)


@query(
    "stream_job_poll",
    """WITH j AS (SELECT user_id AS job, CASE WHEN user_id % 2 = 0 THEN 'cache_warming' ELSE 'reindex' END AS type, event_id, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM events),
            r AS (SELECT *, count(*) FILTER (status IN ('completed', 'failed')) OVER (PARTITION BY job ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM j)
       SELECT job, type, event_id, status FROM r WHERE coalesce(before, 0) = 0""",
)
def stream_job_poll(t):
    """Two kinds of jobs as one stream of states, each job to its first terminal state (here users are jobs, their events states)."""
    states = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    of = lambda rest, kind: ev.stream(t.events, f"{t.folder}/events.parquet*").filter(F.col("user_id") % 2 == rest).select(F.col("user_id").alias("job"), F.lit(kind).alias("type"), "event_id", "ts", states.alias("status"))
    told = ev.run_to_end(of(0, "cache_warming").unionByName(of(1, "reindex")), scratch(t), "append")
    return ev.until_terminal(told, "job", ["ts", "event_id"], "status", ("completed", "failed")).select("job", "type", "event_id", "status")


@query("stream_bounded_queue", "SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS offered, greatest(0, count(*) - 3) AS dropped FROM events GROUP BY 1")
def stream_bounded_queue(t):
    """A queue of three that is emptied every minute: what was offered and dropped."""
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute")).agg(F.count("*").alias("offered"), F.greatest(F.lit(0), F.count("*") - 3).alias("dropped"))


@query("stream_live_sample", "SELECT event_id FROM events WHERE ('0x' || md5(CAST(event_id AS VARCHAR))[1:8])::BIGINT % 10 = 0")
def stream_live_sample(t):
    """A tenth of the events, by a hash of their id: sampling is the feature, and it is the same each time."""
    return t.events.filter(F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long") % 10 == 0).select("event_id")


@query(
    "state_batch_finalize",
    "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'running' WHEN count(*) FILTER (o_orderpriority = '1-URGENT') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS state FROM orders GROUP BY 1",
)
def state_batch_finalize(t):
    open_, failed = F.count_if(F.col("o_orderstatus") == "P"), F.count_if(F.col("o_orderpriority") == "1-URGENT")
    return t.orders.groupBy("o_custkey").agg(F.when(open_ > 0, "running").when(failed > 0, "completed_with_errors").otherwise("completed").alias("state"))


@query("state_cancel_skip", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('P', 'O') THEN 'skipped' ELSE o_orderstatus END AS status FROM orders")
def state_cancel_skip(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus").isin("P", "O"), "skipped").otherwise(F.col("o_orderstatus")).alias("status"))


@query("state_lease_reclaim", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS lease FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01') ORDER BY o_orderdate, o_orderkey LIMIT 1")
def state_lease_reclaim(t):
    """The oldest item that is pending, or running with its lease run out: one is claimed at a time."""
    due = F.expr("o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00')")
    return t.orders.filter(due).orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey", F.col("o_orderdate").cast("date").alias("lease"))


@query("state_retry_backoff", "SELECT event_id, [5, 30, 120][least(event_id % 6, 2) + 1] AS delay FROM events")
def state_retry_backoff(t):
    delays = F.array(F.lit(5), F.lit(30), F.lit(120))
    return t.events.select("event_id", F.element_at(delays, (F.least(F.col("event_id") % 6, F.lit(2)) + 1).cast("int")).alias("delay"))


@query(
    "state_reindex_job",
    """WITH m AS (SELECT unnest(['all', 'ready', 'failed']) AS mode, unnest([['F', 'O', 'P'], ['F'], ['P']]) AS takes)
       SELECT mode, count(*) AS selected, count(*) FILTER (o_orderpriority = '1-URGENT') AS failed, CASE WHEN count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0) > 0 THEN 'paused' ELSE 'completed' END AS state,
              count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 1) AS skipped, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 2) AS retried
       FROM m JOIN orders ON list_contains(takes, o_orderstatus) GROUP BY 1""",
)
def state_reindex_job(t):
    """What a job selects in each mode, and how it stands: of its failures some are skipped, some are tried again, and one that is neither pauses it."""
    modes = {"all": ("F", "O", "P"), "ready": ("F",), "failed": ("P",)}
    rows = t.orders.withColumn("mode", F.explode(F.array_compact(F.array(*[F.when(F.col("o_orderstatus").isin(*takes), m) for m, takes in modes.items()]))))
    failed, how = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") % 3
    count = lambda c: F.count_if(failed & c)
    state = F.when(count(how == 0) > 0, "paused").otherwise("completed")
    return rows.groupBy("mode").agg(F.count("*").alias("selected"), F.count_if(failed).alias("failed"), state.alias("state"), count(how == 1).alias("skipped"), count(how == 2).alias("retried"))


@query("state_ttl_expiry", "SELECT event_id FROM events WHERE coalesce(CASE WHEN event_type = 'view' THEN ts + INTERVAL 2 DAY END, ts) >= TIMESTAMP '2024-01-16' - INTERVAL 7 DAY")
def state_ttl_expiry(t):
    """Entries that are alive: by last access (here views are read again two days on), else by creation."""
    used = F.when(F.col("event_type") == "view", F.expr("ts + INTERVAL '2' DAY"))
    return t.events.filter(F.coalesce(used, F.col("ts")) >= F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00' - INTERVAL '7' DAY")).select("event_id")


@query("state_stuck_recovery", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'pending' ELSE o_orderstatus END AS status FROM orders")
def state_stuck_recovery(t):
    stuck = F.expr("o_orderstatus = 'O' AND o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    return t.orders.select("o_orderkey", F.when(stuck, "pending").otherwise(F.col("o_orderstatus")).alias("status"))


@query(
    "plug_settings",
    """WITH l AS (SELECT user_id, event_type AS key, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type IN ('view', 'click') AND user_id % 3 < 2),
            d AS (SELECT unnest(['view', 'click', 'limit']) AS key, unnest([NULL, 7.5, NULL]) AS env, unnest([1.0, 2.0, 3.0]) AS base), u AS (SELECT DISTINCT user_id FROM events)
       SELECT u.user_id, d.key, CAST(coalesce(l.value, env, base) AS DOUBLE) AS value, CASE WHEN l.value IS NOT NULL THEN 'stored' WHEN env IS NOT NULL THEN 'environment' ELSE 'default' END AS found
       FROM u CROSS JOIN d LEFT JOIN l ON l.user_id = u.user_id AND l.key = d.key AND l.k = 1""",
)
def plug_settings(t):
    """The setting in force of each user and key: the last change in the audit, else the environment's, else the default."""
    stored = win.first_per_group(t.events.filter("event_type IN ('view', 'click') AND user_id % 3 < 2"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    stored = stored.select("user_id", F.col("event_type").alias("key"), F.col("value").alias("stored"))
    keys = F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(env).cast("double").alias("env"), F.lit(base).alias("base")) for k, env, base in (("view", None, 1.0), ("click", 7.5, 2.0), ("limit", None, 3.0))]))
    rows = t.events.select("user_id").distinct().select("user_id", keys).join(stored, ["user_id", "key"], "left")
    found = F.when(F.col("stored").isNotNull(), "stored").when(F.col("env").isNotNull(), "environment").otherwise("default")
    return rows.select("user_id", "key", F.coalesce("stored", "env", "base").alias("value"), found.alias("found"))


@query("repo_generic_crud", "SELECT n_regionkey, count(*) AS n, max(CASE WHEN n_nationkey = 7 THEN 'renamed' ELSE n_name END) AS name FROM nation WHERE n_nationkey <> 3 GROUP BY 1")
def repo_generic_crud(t):
    """Delete one row, update another, count the rest."""
    rows = t.nation.filter("n_nationkey <> 3").withColumn("n_name", F.when(F.col("n_nationkey") == 7, "renamed").otherwise(F.col("n_name")))
    return rows.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.max("n_name").alias("name"))


@query(
    "connector_ams",
    """SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS tenant, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS revision
       FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 3""",
)
def connector_ams(t):
    """Customers pushed to a system that keeps JSON pages, those in debt once more with a balance of nothing; the newest of each pulled again, nation by nation outside one region."""
    systems = connectors.Connectors(t.spark)
    systems.register("pages", pages.JsonPages)
    folder = scratch(t)
    rows = t.customer.select("c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("tenant"), "c_acctbal", "c_mktsegment", F.lit(1).alias("revision"))
    systems.push("pages", rows, "overwrite", path=folder, tenant_column="tenant")
    systems.push("pages", rows.filter("c_acctbal < 0").withColumns({"c_acctbal": F.lit(0.0), "revision": F.lit(2)}), path=folder, tenant_column="tenant")
    wanted = [str(r[0]) for r in t.nation.filter("n_regionkey <> 3").select("n_nationkey").collect()]  # the nations, a dimension of 25
    return win.first_per_group(systems.pull("pages", path=folder, tenant=",".join(wanted)), ["c_custkey"], [F.desc("revision")], 1)


@query(
    "plug_tenant_config",
    """WITH c AS (SELECT *, c_custkey % 7 AS k FROM customer)
       SELECT c_custkey, CASE k WHEN 0 THEN c_name ELSE '' END AS display_name, CASE k WHEN 0 THEN 'core,' || lower(c_mktsegment) ELSE 'core' END AS active_modules, k = 0 AS feature_flags_structured_query, false AS feature_flags_enrichment,
              CASE k WHEN 0 THEN 'medium-1' ELSE 'small-1' END AS ai_models_query_model, 'large-1' AS ai_models_enrichment_model, 150.0::DOUBLE AS ai_models_monthly_query_cap_usd,
              CASE k WHEN 0 THEN c_acctbal WHEN 6 THEN 2.5 ELSE 10.0 END AS ai_models_daily_enrichment_cap_usd, '#1a73e8' AS branding_primary_color,
              CASE k WHEN 2 THEN 'no JSON object' WHEN 3 THEN 'ai_models_daily_enrichment_cap_usd is no double' WHEN 4 THEN 'ai_models_query_model: no model named medium' END AS error FROM c""",
)
def plug_tenant_config(t):
    """Each customer as a tenant: settings of its own, unknown keys, a broken text, a wrong type, a model without its version, none, and a number as text."""
    own = F.to_json(F.struct(
        F.col("c_name").alias("display_name"), F.array(F.lit("core"), F.lower("c_mktsegment")).alias("active_modules"), F.struct(F.lit(True).alias("structured_query")).alias("feature_flags"),
        F.struct(F.lit("medium-1").alias("query_model"), F.col("c_acctbal").alias("daily_enrichment_cap_usd"), F.lit(1).alias("unknown")).alias("ai_models"),
    ))
    texts = [own, F.lit('{"colour": "red", "ai_models": {"x": [1]}}'), F.concat(F.lit('{"display_name": "'), "c_name"), F.lit('{"display_name": "x", "ai_models": {"daily_enrichment_cap_usd": "many"}}'), F.lit('{"ai_models": {"query_model": "medium"}}'), F.lit(None).cast("string"), F.lit('{"ai_models": {"daily_enrichment_cap_usd": "2.5"}}')]
    rows = t.customer.select("c_custkey", F.element_at(F.array(*texts), (1 + F.col("c_custkey") % 7).cast("int")).alias("text"))
    return tenants.resolved(rows, "c_custkey", "text", ["small-1", "medium-1", "large-1"]).withColumn("active_modules", F.array_join("active_modules", ","))


@query(
    "plug_tenant_prompt_resolve",
    """WITH a AS (SELECT c_custkey, c_mktsegment, c_acctbal, unnest(['answer', 'route', 'title']) AS name FROM customer)
       SELECT c_custkey, name, CASE WHEN name = 'answer' AND c_acctbal < 0 THEN 'own ' || c_custkey WHEN name = 'route' THEN 'of ' || c_mktsegment WHEN name = 'answer' THEN 'core answer' END AS prompt,
              CASE WHEN name = 'answer' AND c_acctbal < 0 THEN 'tenant' WHEN name = 'route' THEN 'module' WHEN name = 'answer' THEN 'core' END AS layer FROM a""",
)
def plug_tenant_prompt_resolve(t):
    """Three prompts for each customer: those in debt have one of their own, segments another, all a third; nobody has a title."""
    asked = t.customer.select("c_custkey", "c_mktsegment", F.explode(F.array(F.lit("answer"), F.lit("route"), F.lit("title"))).alias("name"))
    mine = t.customer.filter("c_acctbal < 0").select(F.lit("tenant").alias("layer"), F.col("c_custkey").cast("string").alias("owner"), F.lit("answer").alias("name"), F.concat_ws(" ", F.lit("own"), "c_custkey").alias("prompt"))
    segment = t.customer.select(F.lit("module").alias("layer"), F.col("c_mktsegment").alias("owner"), F.lit("route").alias("name"), F.concat_ws(" ", F.lit("of"), "c_mktsegment").alias("prompt")).distinct()
    core = t.spark.createDataFrame([("core", "", name, f"core {name}") for name in ("answer", "route")], "layer string, owner string, name string, prompt string")
    return tenants.prompts(asked, mine.unionByName(segment).unionByName(core), {"tenant": "c_custkey", "module": "c_mktsegment", "core": None}).select("c_custkey", "name", "prompt", "layer")


@query(
    "plug_module_registry",
    """WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'large' WHEN o_totalprice >= 50000 THEN 'middle' ELSE 'small' END AS band FROM orders), c AS (SELECT c_nationkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS band FROM customer)
       SELECT * FROM (SELECT 'orders' AS module, band, count(*) AS n, min(o_orderkey) AS least FROM o GROUP BY band ORDER BY band LIMIT 100)
       UNION ALL SELECT * FROM (SELECT 'accounts', band, count(*), min(c_nationkey) FROM c GROUP BY band ORDER BY band LIMIT 100) UNION ALL SELECT 'failed', 'broken', 0, 0""",
)
def plug_module_registry(t):
    """Two modules with a function of the same name and a template each, side by side; a third fails half-way and is only told of."""

    def orders(m):
        m.function("band", "x DOUBLE", "STRING", "CASE WHEN x >= 200000 THEN 'large' WHEN x >= 50000 THEN 'middle' ELSE 'small' END")
        m.template("bands", "SELECT 'orders' AS module, orders_band(o_totalprice) AS band, count(*) AS n, min(o_orderkey) AS least FROM orders GROUP BY 2 ORDER BY 2 LIMIT :row_cap")

    def accounts(m):
        m.function("band", "x DOUBLE", "STRING", "CASE WHEN x < 0 THEN 'debt' ELSE 'credit' END")
        m.template("bands", "SELECT 'accounts' AS module, accounts_band(c_acctbal) AS band, count(*) AS n, min(c_nationkey) AS least FROM customer GROUP BY 2 ORDER BY 2 LIMIT :row_cap")

    def broken(m):
        m.function("half", "x DOUBLE", "DOUBLE", "x / 2")
        m.template("all", "SELECT * FROM orders")

    known = modules.Modules(t.spark)
    for name, loader in (("orders", orders), ("broken", broken), ("accounts", accounts)):
        known.load(name, loader)
    out = t.spark.createDataFrame([("failed", name, 0, 0) for name in known.failed], "module string, band string, n long, least long")
    for name in known.names():
        out = out.unionByName(known.run(t, name, "bands", {"row_cap": 100}))
    return out
