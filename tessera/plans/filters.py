"""Filters, predicates, projections and access checks."""

from pyspark.sql import functions as F

from ..operators import filters as flt
from ..sources import sql
from .registry import query


@query("filter_eq_composed", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 ")
def filter_eq_composed(t):
    rows = flt.compose(t.orders, flt.equals("o_orderstatus", "F"), flt.equals("o_orderpriority", None), F.col("o_totalprice") >= 100000)
    return rows.select("o_orderkey", "o_orderpriority")


@query("filter_like_or_ci", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%bl_e%' OR lower(p_type) LIKE '%promo%'")
def filter_like_or_ci(t):
    return t.part.filter(flt.contains_any_ci("bl_e", "p_name") | flt.contains_any_ci("PROMO", "p_type")).select("p_partkey", "p_name")


@query("filter_ilike", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%eco%' OR p_name ILIKE '%RING'")
def filter_ilike(t):
    return t.part.filter(F.col("p_type").ilike("%eco%") | F.col("p_name").ilike("%RING")).select("p_partkey", "p_type")


@query("filter_like_prefix", "SELECT p_type, count(*) AS n FROM part WHERE p_type LIKE 'S%' GROUP BY p_type")
def filter_like_prefix(t):
    return t.part.filter(F.col("p_type").startswith("S")).groupBy("p_type").agg(F.count("*").alias("n"))


@query("filter_in_list", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey IN (1, 5, 7, 24)")
def filter_in_list(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).filter(F.col("n_nationkey").isin(1, 5, 7, 24)).select("c_custkey")


@query("filter_optional_param", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def filter_optional_param(t):
    sql = "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE (:priority IS NULL OR o_orderpriority = :priority) AND (:status IS NULL OR o_orderstatus = :status)"
    return t.spark.sql(sql, args={"priority": None, "status": "O"}, orders=t.orders)


@query("filter_between_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_date FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-04-01'")
def filter_between_dates(t):
    day = F.col("o_orderdate").cast("date")
    return t.orders.filter(day.between(F.lit("1998-01-01").cast("date"), F.lit("1998-04-01").cast("date"))).select("o_orderkey", day.alias("o_date"))


@query("filter_date_interval_default", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1998-01-01' - INTERVAL 2 YEAR")
def filter_date_interval_default(t):
    cutoff = F.coalesce(F.lit(None).cast("date"), F.expr("DATE '1998-01-01' - INTERVAL '2' YEAR"))
    return t.lineitem.filter(F.col("l_shipdate").cast("date") >= cutoff).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("filter_json_field", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def filter_json_field(t):
    return t.events.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("filter_visibility_by_role", "SELECT o_orderkey, o_orderstatus, 0 AS n_fields FROM orders WHERE o_orderstatus = 'F'")
def filter_visibility_by_role(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.array("o_orderpriority", "o_orderstatus").alias("fields"))
    return flt.visible(rows, False, "o_orderstatus", "F", "fields").select("o_orderkey", "o_orderstatus", F.size("fields").alias("n_fields"))


@query("filter_compound_bool", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag IN ('R', 'A') OR (l_linestatus = 'O' AND NOT l_discount > 0.05)) AND l_shipdate IS NOT NULL")
def filter_compound_bool(t):
    late = F.col("l_returnflag").isin("R", "A") | ((F.col("l_linestatus") == "O") & ~(F.col("l_discount") > 0.05))
    return t.lineitem.filter(late & F.col("l_shipdate").isNotNull()).select("l_orderkey", "l_linenumber")


@query("project_days_until", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1998-01-01' AS BIGINT) AS days_until FROM orders")
def project_days_until(t):
    return t.orders.select("o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1998-01-01").cast("date")).cast("long").alias("days_until"))


@query(
    "project_case_bucket",
    """SELECT urgency, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (
         SELECT o_totalprice, CASE WHEN d <= 30 THEN 'urgent' WHEN d <= 90 THEN 'soon' ELSE 'later' END AS urgency
         FROM (SELECT o_totalprice, CAST(o_orderdate AS DATE) - DATE '1998-01-01' AS d FROM orders) WHERE d >= 0) GROUP BY urgency""",
)
def project_case_bucket(t):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1998-01-01").cast("date"))
    rows = t.orders.filter(days >= 0).select("o_totalprice", flt.bucket(days, [(30, "urgent"), (90, "soon")], "later").alias("urgency"))
    return rows.groupBy("urgency").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_TAGGED = "(SELECT doc_id, lang, source, CASE WHEN doc_id % 7 = 0 THEN ['public', lang, source] ELSE [lang, source] END AS tags FROM documents)"


def _tagged(t):
    tags = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("public"), "lang", "source")).otherwise(F.array("lang", "source"))
    return t.documents.select("doc_id", "lang", "source", tags.alias("tags"))


@query("acl_public_or_any", f"SELECT doc_id FROM {_TAGGED} WHERE list_contains(tags, 'public') OR list_has_any(tags, ['de', 'src3'])")
def acl_public_or_any(t):
    return _tagged(t).filter(flt.public_or_any(F.col("tags"), ["de", "src3"])).select("doc_id")


@query(
    "acl_any_postfilter",
    """WITH s AS (SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score, d.lang
         FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) p),
       a AS (SELECT * FROM s ORDER BY round(score, 6) DESC, vec_id LIMIT 120)
       SELECT vec_id, round(score, 6) AS score FROM a WHERE lang = 'de' ORDER BY score DESC, vec_id LIMIT 10""",
)
def acl_any_postfilter(t):
    """The mode that filters after an over-fetch of twelve times the limit."""
    from ..functions.vectors import cosine

    probe = t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("probe"))
    rows = t.embeddings.join(t.documents.select(F.col("doc_id").alias("vec_id"), "lang"), "vec_id").join(F.broadcast(probe))
    scored = rows.select("vec_id", F.round(cosine("embedding", "probe"), 6).alias("score"), "lang")
    first = scored.orderBy(F.desc("score"), "vec_id").limit(10 * 12)
    return first.filter(F.col("lang") == "de").orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", "score")


@query("acl_all_required", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src0', 'src4', 'src8')")
def acl_all_required(t):
    own = F.array(*[F.lit(x) for x in ("en", "fr", "src0", "src4", "src8")])
    return t.documents.filter(flt.all_required(F.array("lang", "source"), own)).select("doc_id")


@query("acl_any_overlap_gate", "SELECT doc_id FROM documents WHERE lang = 'es' OR source = 'src1'")
def acl_any_overlap_gate(t):
    return t.documents.filter(flt.any_overlap(F.array("lang", "source"), F.array(F.lit("es"), F.lit("src1")))).select("doc_id")


@query("acl_document_get", "SELECT doc_id, lang FROM documents WHERE lang IN (SELECT 'fr' UNION ALL SELECT 'de')")
def acl_document_get(t):
    """Documents with a tag of the user's, by semi join on the bridge of documents and tags."""
    bridge = t.documents.select("doc_id", F.explode(F.array("lang", "source")).alias("tag"))
    own = t.spark.createDataFrame([("fr",), ("de",)], "tag string")
    return t.documents.select("doc_id", "lang").join(bridge.join(F.broadcast(own), "tag", "left_semi"), "doc_id", "left_semi")


@query(
    "cache_access_verify",
    """WITH cited AS (SELECT DISTINCT conv_id, (conv_id * 7 + turn) % (SELECT count(*) FROM documents) AS doc_id FROM conversations),
            n AS (SELECT conv_id, count(*) AS cited, count(d.doc_id) AS seen FROM cited LEFT JOIN (SELECT doc_id FROM documents WHERE lang <> 'fr') d USING (doc_id) GROUP BY conv_id)
       SELECT conv_id, cited = seen AS valid FROM n""",
)
def cache_access_verify(t):
    """A cached answer may be used if every document it cites may be read."""
    number = t.documents.agg(F.count("*").alias("n"))  # one row
    cited = t.conversations.join(F.broadcast(number)).select("conv_id", ((F.col("conv_id") * 7 + F.col("turn")) % F.col("n")).alias("doc_id")).distinct()
    readable = t.documents.filter("lang <> 'fr'").select("doc_id", F.lit(1).alias("ok"))
    return cited.join(readable, "doc_id", "left").groupBy("conv_id").agg((F.count("*") == F.count("ok")).alias("valid"))


#: Statements as a model may write them, by turn of an order's key; the order's own values stand in them.
STATEMENTS = ("SELECT {k} AS k FROM orders LIMIT 5", "select * from orders where o_orderkey = {k}", "DROP TABLE orders_{k}", "SELECT {k}; delete from orders", "  SELECT '%s' LIMIT {k}", "WITH x AS (SELECT {k}) SELECT * FROM x", "SELECT updated_{k} FROM orders LIMIT 1")
_STATEMENT = f"replace([{', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in STATEMENTS)}][1 + o_orderkey % {len(STATEMENTS)}], '{{k}}', CAST(o_orderkey AS VARCHAR))"
_WORDS = "(?i)\\b(" + "|".join(sql.FORBIDDEN) + ")\\b"
_REFUSED = f"WHEN NOT regexp_matches(s, '(?i)^\\s*select\\b') THEN 'only SELECT is allowed' WHEN regexp_matches(s, '{_WORDS}') THEN upper(regexp_extract(s, '{_WORDS}', 1)) || ' is not allowed'"


def _statements(t):
    made = F.element_at(F.array(*[F.lit(x) for x in STATEMENTS]), (1 + F.col("o_orderkey") % len(STATEMENTS)).cast("int"))
    return t.orders.select("o_orderkey", F.replace(made, F.lit("{k}"), F.col("o_orderkey").cast("string")).alias("s"))


@query("sql_guard_select_only", f"SELECT o_orderkey, CASE {_REFUSED} END AS refusal FROM (SELECT o_orderkey, {_STATEMENT} AS s FROM orders)")
def sql_guard_select_only(t):
    return _statements(t).select("o_orderkey", sql.refusal(F.col("s")).alias("refusal"))


@query("sql_template_validate", f"SELECT o_orderkey, CASE {_REFUSED} WHEN NOT regexp_matches(s, '(?i)\\blimit\\b') THEN 'a template needs a LIMIT' WHEN regexp_matches(s, '\\{{\\w*\\}}|%s|%\\(') THEN 'values belong in named parameters' END AS refusal FROM (SELECT o_orderkey, {_STATEMENT} AS s FROM orders)")
def sql_template_validate(t):
    return _statements(t).select("o_orderkey", sql.refusal(F.col("s"), template=True).alias("refusal"))


@query("soft_pref_should", "SELECT doc_id, CAST((lang = 'de')::INT + (source = 'src2')::INT AS BIGINT) AS preferred FROM documents")
def soft_pref_should(t):
    """Preferred tags rank, they don't filter."""
    own = F.array(F.lit("de"), F.lit("src2"))
    return t.documents.select("doc_id", F.size(F.array_intersect(F.array("lang", "source"), own)).cast("long").alias("preferred"))
