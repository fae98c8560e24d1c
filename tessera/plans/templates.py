"""The shipped query templates: SQL text with named parameters, and services made of them."""

from pyspark.sql import functions as F

from ..sources.sql import run_template
from .registry import query

#: name: (template with named parameters, parameters, the same query with them filled in)
TEMPLATES = {
    "tpl_coverage_by_account_line": (
        "SELECT o_orderkey, l_linenumber, l_extendedprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = :status AND l_returnflag = :flag AND (:mode IS NULL OR l_linestatus = :mode) AND l_quantity > :least ORDER BY l_extendedprice DESC, o_orderkey, l_linenumber LIMIT :row_cap",
        {"status": "F", "flag": "R", "mode": None, "least": 10, "row_cap": 100},
    ),
    "tpl_carrier_lookup": ("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey = :account ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT :row_cap", {"account": 7, "row_cap": 50}),
    "tpl_premium_query": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = :status ORDER BY o_totalprice DESC, o_orderkey LIMIT :row_cap", {"status": "O", "row_cap": 50}),
    "tpl_compliance_gap": ("SELECT p_partkey, p_type, p_size FROM part WHERE p_size >= :least AND p_type = :type AND p_brand <> :brand AND p_retailprice > :price ORDER BY p_type, p_size DESC, p_partkey LIMIT :row_cap", {"least": 20, "type": "PROMO", "brand": "Brand#1", "price": 1000.0, "row_cap": 100}),
    "tpl_coverage_schedule": ("SELECT o_orderkey, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = :flag WHERE o_custkey <= :account GROUP BY o_orderkey ORDER BY o_orderkey LIMIT :row_cap", {"flag": "R", "account": 50, "row_cap": 1000}),
    "tpl_comparison_by_line": (
        "SELECT o_custkey, o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = :status WHERE o_orderpriority = :priority ORDER BY o_custkey, l_quantity DESC NULLS LAST, o_orderkey, l_linenumber LIMIT :row_cap",
        {"status": "O", "priority": "1-URGENT", "row_cap": 200},
    ),
    "tpl_reserve_status": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = :account ORDER BY o_orderdate DESC, o_orderkey LIMIT 1", {"account": 8}),
    "tpl_requirements_by_source": ("SELECT p_partkey, p_name FROM part WHERE (:source IS NULL OR p_type = :source) AND p_size = :size ORDER BY p_partkey LIMIT :row_cap", {"source": None, "size": 7, "row_cap": 100}),
    "tpl_unit_owner_status": (
        "SELECT c_custkey, l.o_orderkey FROM customer JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) l ON true WHERE c_mktsegment = :segment ORDER BY c_custkey LIMIT :row_cap",
        {"segment": "BUILDING", "row_cap": 300},
    ),
    "tpl_board_resolutions": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = :status ORDER BY o_orderdate DESC, o_orderkey LIMIT least(:limit, :row_cap)", {"status": "F", "limit": 25, "row_cap": 100}),
}

#: Templates that Spark takes in another form: it keeps the ORDER BY of a lateral subquery only if its keys are in the subquery's list; else any row may be the first.
FOR_SPARK = {
    "tpl_unit_owner_status": "SELECT c_custkey, l.o_orderkey FROM customer JOIN LATERAL (SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey NULLS LAST LIMIT 1) l ON true WHERE c_mktsegment = :segment ORDER BY c_custkey LIMIT :row_cap",
}


def filled(sql: str, values: dict) -> str:
    """The template with its parameters as literals."""
    for name in sorted(values, key=len, reverse=True):
        value = values[name]
        sql = sql.replace(f":{name}", "NULL" if value is None else repr(value))
    return sql.replace("least(25, 100)", "25")


def _register(name: str) -> None:
    sql, values = TEMPLATES[name]
    query(name, filled(sql, values))(lambda t: run_template(t, FOR_SPARK.get(name, sql), values))


for _name in TEMPLATES:
    _register(_name)


@query("tpl_policy_dates", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1998-01-01' AS INTEGER) AS days FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' ORDER BY days, o_orderkey LIMIT 100")
def tpl_policy_dates(t):
    sql = "SELECT o_orderkey, datediff(CAST(o_orderdate AS DATE), :as_of::date) AS days FROM orders WHERE CAST(o_orderdate AS DATE) >= :as_of::date ORDER BY days, o_orderkey LIMIT :row_cap"
    return run_template(t, sql, {"as_of": "1998-01-01", "row_cap": 100})


@query("tpl_claims_history", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS loss_date FROM lineitem WHERE l_returnflag = 'R' AND CAST(l_shipdate AS DATE) >= DATE '2001-01-01' - INTERVAL 5 YEAR ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey LIMIT 200")
def tpl_claims_history(t):
    sql = "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS loss_date FROM lineitem WHERE l_returnflag = 'R' AND CAST(l_shipdate AS DATE) >= coalesce(:cutoff::date, :as_of::date - INTERVAL '5' YEAR) ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey LIMIT :row_cap"
    return run_template(t, sql, {"cutoff": None, "as_of": "2001-01-01", "row_cap": 200})


@query("svc_renewal_expiring", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1998-01-01' AS INTEGER) AS days_left, round(sum(o_totalprice) OVER (), 2) AS premium FROM (SELECT * FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-01-31' ORDER BY o_orderdate, o_orderkey LIMIT 50)")
def svc_renewal_expiring(t):
    """The fifty orders that end first within thirty days, with their total."""
    from pyspark.sql import Window as W

    day = F.col("o_orderdate").cast("date")
    rows = t.orders.filter(day.between(F.lit("1998-01-01").cast("date"), F.lit("1998-01-31").cast("date"))).orderBy("o_orderdate", "o_orderkey").limit(50)
    return rows.select("o_orderkey", F.datediff(day, F.lit("1998-01-01").cast("date")).alias("days_left"), F.round(F.sum("o_totalprice").over(W.partitionBy()), 2).alias("premium"))


@query("svc_board_packet", "SELECT 'coverage' AS part, o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) UNION ALL SELECT 'expiring', o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 20)")
def svc_board_packet(t):
    coverage = t.orders.filter("o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select(F.lit("coverage").alias("part"), "o_orderkey")
    expiring = t.orders.filter("o_orderdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00'").orderBy("o_orderdate", "o_orderkey").limit(20).select(F.lit("expiring").alias("part"), "o_orderkey")
    return coverage.unionByName(expiring)


@query("svc_noncompliant_owners", "SELECT l_orderkey, l_linenumber, 'Order ' || l_orderkey || ', line ' || l_linenumber || ': please reply.' AS letter FROM lineitem WHERE l_returnflag = 'A' OR (l_linestatus = 'O' AND NOT l_tax > 0.02) ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 500")
def svc_noncompliant_owners(t):
    """Letters to the first five hundred that need one: that is how many a batch has."""
    rows = t.lineitem.filter("l_returnflag = 'A' OR (l_linestatus = 'O' AND NOT l_tax > 0.02)").orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(500)
    return rows.select("l_orderkey", "l_linenumber", F.format_string("Order %d, line %d: please reply.", "l_orderkey", "l_linenumber").alias("letter"))


@query("svc_accounts_policies", "SELECT c_custkey, c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def svc_accounts_policies(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("n"))
