"""Sinks and changes of tables."""

from pyspark.sql import functions as F

from ..functions import config
from ..operators import mutations as mut
from ..operators import windows as win
from ..sources import office
from .registry import query


@query("sink_table_from_frame", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def sink_table_from_frame(t):
    return mut.all_text(t.supplier.select("s_suppkey", "s_name", "s_nationkey"))


@query("sink_table_typed", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def sink_table_typed(t):
    """The frame, typed, as a table that replaces the old one."""
    return mut.replace_table(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), "tessera_supplier_copy")


@query(
    "upsert_registry",
    "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
)
def upsert_registry(t):
    rows = t.events.select("user_id", "event_type", "ts", "event_id")
    return mut.upsert(rows.filter("event_id < 100").dropDuplicates(["user_id"]), rows, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type")


@query("replace_document_chunks", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 = 0 THEN 'new' ELSE 'old' END AS state FROM lineitem WHERE l_orderkey % 10 <> 0 OR l_linenumber <= 2")
def replace_document_chunks(t):
    old = t.lineitem.select("l_orderkey", "l_linenumber", F.lit("old").alias("state"))
    new = t.lineitem.filter("l_orderkey % 10 = 0").select("l_orderkey", "l_linenumber", F.lit("new").alias("state"))
    gone = mut.replace_where(old, new.filter("l_linenumber <= 2"), "l_orderkey")
    return gone.filter("state = 'new' OR l_orderkey % 10 <> 0")


@query("delete_by_document", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_by_document(t):
    return t.documents.select("doc_id").join(t.labels.filter("quality = 0"), "doc_id", "left_anti")


@query("delete_by_metadata_json", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') <> '7'")
def delete_by_metadata_json(t):
    return mut.delete_json(t.events, "props", "$.k", "7").select("event_id")


@query("update_document_tags", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'public,' || lang ELSE lang || ',' || source END AS tags FROM documents")
def update_document_tags(t):
    rows = t.documents.select("doc_id", "lang", F.array("lang", "source").alias("tags"))
    new = F.when(F.col("lang") == "de", F.array(F.lit("public"), "lang")).otherwise(F.col("tags"))
    return rows.withColumn("tags", new).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query(
    "soft_delete_versioning",
    "SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL AS current FROM orders",
)
def soft_delete_versioning(t):
    """Versions of a customer by order; the one without an end is the current one."""
    rows = t.orders.select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("valid_from"))
    return win.versions(rows, "o_custkey", "valid_from").select("o_custkey", "o_orderkey", F.col("valid_to").isNull().alias("current"))


@query(
    "claim_update_where",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01') THEN 'running' ELSE CASE o_orderstatus WHEN 'O' THEN 'running' ELSE 'done' END END AS status, o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01') AS claimed FROM orders",
)
def claim_update_where(t):
    """Items that a worker gets: pending ones, and running ones whose lease (here the day of the order) is over. Others keep their state."""
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "running").otherwise("done")
    now = F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    over = (status == "pending") | ((status == "running") & (F.col("o_orderdate") < now))
    return t.orders.select("o_orderkey", config.claim(status, F.col("o_orderdate"), now).alias("status"), over.alias("claimed"))


@query("export_chunks_excel", "SELECT s_suppkey, s_nationkey, s_name FROM supplier")
def export_chunks_excel(t):
    """Suppliers exported as workbooks, a sheet for each nation with a header, and read again."""
    books = office.workbooks(t.supplier.withColumn("book", F.lit("suppliers")), "book", "s_nationkey", ["s_suppkey"], ["s_suppkey", "s_name"])
    rows = office.parsed(books).filter("number > 1")
    return rows.select(F.col("cells")[0].cast("long").alias("s_suppkey"), F.col("part").cast("int").alias("s_nationkey"), F.col("cells")[1].alias("s_name"))


@query("retention_purge", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-16' - INTERVAL 7 DAY")
def retention_purge(t):
    return mut.purge(t.events, "ts", F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00' - INTERVAL '7' DAY")).select("event_id")


@query("lifecycle_soft_delete_repo", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '1998-01-01' WHEN o_orderkey % 9 = 0 THEN '1997-01-01' END AS deleted_at FROM orders")
def lifecycle_soft_delete_repo(t):
    rows = t.orders.withColumn("deleted_at", F.when((F.col("o_orderkey") % 9 == 0) & (F.col("o_orderstatus") != "F"), "1997-01-01"))
    return mut.soft_delete(rows, F.col("o_orderstatus") == "F", F.lit("1998-01-01")).select("o_orderkey", "deleted_at")


@query("lifecycle_idempotent_find", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def lifecycle_idempotent_find(t):
    return win.first_per_group(t.documents, ["source", "lang"], [F.col("doc_id")]).select("source", "doc_id")


@query("delete_non_system_tags", "SELECT count(*) FILTER (p_size > 10) AS deleted, count(*) FILTER (p_size <= 10) AS preserved FROM part")
def delete_non_system_tags(t):
    system = F.col("p_size") <= 10
    return t.part.agg(F.count_if(~system).alias("deleted"), F.count_if(system).alias("preserved"))


@query("pii_null_out", "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def pii_null_out(t):
    return mut.null_out(t.customer, ["c_name", "c_acctbal"], F.col("c_nationkey") < 5).select("c_custkey", "c_name", "c_acctbal")
