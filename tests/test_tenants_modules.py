"""Guards by the parsed plan, modules of a session, settings of tenants."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.catalog import NAMES
from tessera.functions import tenants
from tessera.plans import templates
from tessera.sources import modules, sql

FINE = [
    "SELECT 1", "select o_orderkey from Orders where o_custkey = :x", "SELECT * FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT a FROM (SELECT o_orderkey AS a FROM orders) WHERE a IN (SELECT l_orderkey FROM lineitem)",
    "SELECT (SELECT max(o_orderkey) FROM orders) AS m, 'a; -- secret' AS t FROM region LIMIT 3", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) FROM orders UNION ALL SELECT 1, 2 FROM (VALUES (1)) v(x)",
    "SELECT count(*) FROM orders GROUP BY o_custkey HAVING count(*) > 1 ORDER BY 1 LIMIT 5 OFFSET 2", "SELECT x FROM orders LATERAL VIEW explode(array(1, 2)) e AS x", "SELECT c_custkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey LIMIT 1)",
]
BAD = {
    "SELECT 1; SELECT 2": "syntax", "SELECT FROM (": "syntax", "SELECT 1) t; SELECT (2": "syntax", "SELECT /* x": "syntax", "": "statement", "WITH a AS (SELECT 1) SELECT * FROM a": "statement", "SHOW TABLES": "statement", "DROP TABLE orders": "statement",
    "SELECT * FROM secret": "relation", "SELECT * FROM other.orders": "relation", "SELECT * FROM parquet.`/etc/x`": "relation", "SELECT * FROM orders WHERE o_custkey IN (SELECT x FROM secret)": "relation", "SELECT (SELECT max(x) FROM secret)": "relation",
    "SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM secret)": "relation", "SELECT * FROM (WITH orders AS (SELECT * FROM secret) SELECT * FROM orders)": "relation", "SELECT 1 FROM orders, LATERAL (SELECT * FROM secret)": "relation",
    "SELECT reflect('java.lang.System', 'exit', 1)": "function", "SELECT * FROM range(10)": "statement", "SELECT TRANSFORM (o_orderkey) USING 'cat' FROM orders": "statement", "SELECT 1 UNION SELECT x FROM secret": "relation", "SELECT * FROM orders ORDER BY (SELECT x FROM secret)": "relation",
}


def test_statements_by_kind(spark):
    for text in FINE:
        sql.guard(text, NAMES)
    for text, kind in BAD.items():
        with pytest.raises(sql.Refused) as e:
            sql.guard(text, NAMES)
        assert e.value.kind == kind, text
    assert sql.inspect(spark, "WITH a AS (SELECT * FROM part), b AS (SELECT * FROM a) SELECT * FROM b JOIN nation ON true") == {"part", "nation"}


def test_templates_need_a_limit_on_top(spark):
    for text in ("SELECT 1", "SELECT * FROM (SELECT * FROM orders LIMIT 1)", "SELECT 'limit' FROM orders", "SELECT * FROM orders -- LIMIT 1"):
        with pytest.raises(sql.Refused) as e:
            sql.validate(text, NAMES)
        assert e.value.kind == "limit", text
    with pytest.raises(sql.Refused, match="named parameters"):
        sql.validate("SELECT {x} FROM orders LIMIT 1")
    for text, *_ in templates.TEMPLATES.values():
        sql.validate(text, NAMES)


def test_generated_statements_are_capped(spark):
    class Fake:
        def __init__(self):
            self.spark, self.orders = spark, spark.range(50).withColumnRenamed("id", "o_orderkey")

    assert sql.run_generated(Fake(), "SELECT o_orderkey FROM ORDERS LIMIT 40", ["orders"], 7).count() == 7
    with pytest.raises(sql.Refused):
        sql.run_generated(Fake(), "SELECT * FROM customer", ["orders"])


def test_modules(spark):
    def one(m):
        m.function("f", "x INT", "INT", "x + 1")
        m.function("t", "n INT", "TABLE (y INT)", "SELECT n + 1")
        m.python_function("g", F.udf(lambda x: x * 2, "int"))
        m.template("q", "SELECT one_f(1) AS y LIMIT 1")
        m.entity("units", "orders.o_orderkey")

    def fails(m):
        m.function("a", "x INT", "INT", "x")
        m.function("b", "x INT", "INT", "no_such_function(x)")

    def raises(m):
        m.template("fine", "SELECT 1 LIMIT 1")
        raise KeyError("mine")

    known = modules.Modules(spark)
    assert known.load("one", one) and spark.sql("SELECT one_f(1), one_g(4), (SELECT y FROM one_t(5))").first()[:] == (2, 8, 6)
    for name, loader in (("fails", fails), ("raises", raises), ("Bad name", one), ("templ", lambda m: m.template("q", "SELECT 1")), ("ent", lambda m: m.entity("a", "b")), ("twice", lambda m: [m.function("f", "", "INT", "1") for _ in range(2)])):
        assert not known.load(name, loader)
    assert not known.load("late", one, needs=("nowhere",))
    assert known.names() == ["one"] and set(known.failed) == {"fails", "raises", "Bad name", "templ", "ent", "twice", "late"} and "KeyError" in known.failed["raises"]
    with pytest.raises(Exception, match="fails_a"):
        spark.sql("SELECT fails_a(1)")
    # a new version that fails leaves the old one
    assert not known.load("one", lambda m: (m.function("f", "x INT", "INT", "x + 100"), m.function("z", "", "INT", "nothing")))
    assert spark.sql("SELECT one_f(1)").first()[0] == 2 and known.entities() == {"units": "orders.o_orderkey"}
    # one that loads takes its place as a whole
    assert known.load("one", lambda m: m.function("f", "x INT", "INT", "x + 100")) and spark.sql("SELECT one_f(1)").first()[0] == 101
    with pytest.raises(Exception, match="one_t"):
        spark.sql("SELECT * FROM one_t(1)")
    known.unload("one")
    with pytest.raises(Exception, match="one_f"):
        spark.sql("SELECT one_f(1)")


def test_settings_of_tenants(spark):
    given = [
        (1, None), (2, "{}"), (3, '{"display_name": "x", "colour": 1, "feature_flags": {"enrichment": true}, "active_modules": ["a", "b"]}'), (4, "[1]"), (5, "{"), (6, ""), (7, '{"display_name": null}'), (8, '{"ai_models": {"daily_enrichment_cap_usd": {}}}'),
        (9, '{"ai_models": {"query_model": "other"}}'), (10, '{"ai_models": {"monthly_query_cap_usd": 1, "query_model": "m"}}'), (10, '{"ai_models": 3}'),
    ]
    rows = spark.createDataFrame([(*g, "mine") for g in given], "id int, text string, error string")
    got = tenants.resolved(rows, "id", "text", ["m"]).orderBy("id", "ai_models_query_model").collect()
    errors = {r.id: r.error for r in got}
    assert [i for i in errors if errors[i] is None] == [1, 2, 3, 10] and errors[7] == "display_name is no string" and errors[9] == "ai_models_query_model: no model named other" and errors[4] == errors[5] == errors[6] == "no JSON object"
    three = next(r for r in got if r.id == 3)
    assert (three.display_name, three.active_modules, three.feature_flags_enrichment, three.feature_flags_structured_query, three.ai_models_query_model) == ("x", ["a", "b"], True, False, "small-1")
    assert [r.ai_models_monthly_query_cap_usd for r in got if r.id == 10] == [1.0, 150.0]
    assert all(r.active_modules == ["core"] for r in got if r.id != 3)


def test_prompts_by_layer(spark):
    asked = spark.createDataFrame([(1, "m", "a", "x"), (2, "m", "a", "x"), (2, None, "b", "x"), (None, "m", "c", "x"), (2, "n", "a", "x"), (2, "n", "a", "x")], "tenant int, module string, name string, layer string")
    stored = spark.createDataFrame([("tenant", "1", "a", "t"), ("module", "m", "a", "m"), ("core", "", "a", "c"), ("core", "", "b", "z"), ("core", "q", "b", "c"), ("tenant", None, "c", "no")], "layer string, owner string, name string, prompt string")
    out = tenants.prompts(asked.drop("layer"), stored, {"tenant": "tenant", "module": "module", "core": None})
    assert sorted((str(r.tenant), str(r.module), r.name, str(r.prompt), str(r.layer)) for r in out.collect()) == sorted([("1", "m", "a", "t", "tenant"), ("2", "m", "a", "m", "module"), ("2", "None", "b", "c", "core"), ("None", "m", "c", "None", "None"), *[("2", "n", "a", "c", "core")] * 2])
    assert json.dumps(out.columns) == '["tenant", "module", "name", "prompt", "layer"]'


def test_summaries_of_documents(spark):
    from tessera.functions import enrichment

    answers = [
        ("DOCUMENT_TYPE:  Loss_Run. \nCARRIER: A.B. Co.\nPOLICY_PERIOD: x\nSUMMARY:  one\n\ntwo ", ("one\n\ntwo", "loss_run", "A.B. Co", "x")), ("Document_Type: letter\nSummary: s", ("s", "other", "unknown", "unknown")),
        ("DOCUMENT_TYPE: policy\nCARRIER: c", ("DOCUMENT_TYPE: policy\nCARRIER: c", "other", "c", "unknown")), ("  ", None), (None, None),
    ]
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(answers)], "i int, a string").select("i", enrichment.summary_fields(F.col("a")).alias("f")).orderBy("i").collect()
    assert [r.f and tuple(r.f) for r in rows] == [f for _, f in answers]
    seen = []

    def model(prompts):
        return [f"SUMMARY: {p.count('[Chunk ')} of {p.split('Total chunks: ')[1].split()[0]}" if "Document: 3" not in p else "" for p in prompts]

    chunks = spark.createDataFrame([(1, i, f"w{i} x") for i in range(20)] + [(2, 0, None), (3, 0, "a"), (None, 0, "b c d")], "doc int, place int, words string")
    got = {r.doc: (r.text, r.n_chunks, r.n_words) for r in enrichment.summaries(chunks, "doc", "place", "words", model).collect()}
    assert got == {1: ("DOCUMENT SUMMARY: 9 of 20", 20, 40), 2: ("DOCUMENT SUMMARY: 1 of 1", 1, 0), None: ("DOCUMENT SUMMARY: 1 of 1", 1, 3)} and not seen


def test_variants_of_questions(spark):
    from tessera.functions import lists
    from tessera.functions import text as tx

    groups = (("paid time off", ("PTO", "vacation days")), ("x", ("one letter",)))
    asked = spark.createDataFrame([("How much PTO?",), ("off time, PAID",), ("vacation of days and pto",), ("photo",), (None,), ("Biggest vendor data",)], "q string")
    got = [r.v for r in asked.select(tx.variants(F.col("q"), groups, lists.EXPANSIONS).alias("v")).collect()]
    always = ["one letter"]  # a term without tokens is in every question
    assert got[:4] == [["How much PTO?", "paid time off", "vacation days", *always], ["off time, PAID", "PTO", "vacation days", *always], ["vacation of days and pto", "paid time off", "vacation days", *always], ["photo", *always]]
    assert got[4] is None and got[5][2:] == [lists.EXPANSIONS[1][1], lists.EXPANSIONS[4][1], lists.EXPANSIONS[7][1]]


def test_a_lateral_subquery_keeps_its_order_when_sorts_spill(spark, tmp_path):
    """Runs of a spilled sort are merged with ties in any order, as are the blocks of a shuffle between executors."""
    from tessera.plans import QUERIES

    customer = spark.range(40).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment"))
    orders = spark.range(4000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 40).alias("o_custkey"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(cast(id * 7919 % 997 as int))").alias("o_orderdate"))
    want = {}
    for r in sorted(orders.collect(), key=lambda r: r.o_orderkey):
        if r.o_custkey not in want or r.o_orderdate > want[r.o_custkey][0]:
            want[r.o_custkey] = r.o_orderdate, r.o_orderkey
    customer.write.parquet(f"{tmp_path}/customer.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    conf, key = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(key, "10")
    try:
        got = QUERIES["tpl_unit_owner_status"](spark, str(tmp_path)).collect()
    finally:
        conf.remove(key)
    assert {r.c_custkey: r.o_orderkey for r in got} == {k: v[1] for k, v in want.items()}
