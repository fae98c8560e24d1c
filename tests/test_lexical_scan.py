"""BM25 by scans of the documents: the rows of the SQL, whatever the keys, shards and cuts; no exchange of postings."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import lexical
from tessera.functions import retrieval as ret
from tessera.plans import ORACLES, QUERIES

WORDS = "alpha beta gamma delta one two three x1 zz the of und straße Ünï K".split()


def tables(spark, folder, odd=True):
    """Documents with repeated keys (alike, and of other lengths; if ``odd``), equal texts, none, empty ones, and items without a hit."""
    dice = random.Random(5)
    text = lambda n: " ".join(dice.choice(WORDS) for _ in range(n))
    docs = [(i, text(dice.randint(1, 12))) for i in range(120)] + [(200 + i, "alpha beta gamma") for i in range(40)]
    docs += [(300, None), (301, ""), (302, "a ? !")] + [(3, text(4)), (3, text(4)), (3, text(9)), (7, docs[7][1]), (9, None)] * odd
    items = [(i, text(dice.randint(1, 6))) for i in range(12)] + [(12, "nothing here"), (13, ""), (14, None), (15, "straße Ünï")]
    vectors = [(i, [dice.gauss(0, 1) for _ in range(4)], i % 3) for i in range(60)]
    for name, rows, kind in (
        ("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string"), ("embeddings", vectors, "vec_id long, embedding array<float>, label int"),
        ("nation", [(i,) for i in (*range(8), 14, 30)], "n_nationkey int"),
    ):
        spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd"))


def by_sql(folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return sorted(con.execute(ORACLES[name]).fetchall())


@pytest.mark.parametrize("name", ["lex_sparse_bm25", "hybrid_degraded_paths"])
@pytest.mark.parametrize("bounds", [{}, {"SHARD_TERMS": 9}, {"SHARD_QUERIES": 5, "BROADCAST_KEYS": 1}])
def test_rows_of_the_sql_on_odd_tables(spark, folder, monkeypatch, name, bounds):
    for key, value in bounds.items():
        monkeypatch.setattr(lexical, key, value)
    got = sorted(tuple(r) for r in QUERIES[name](spark, folder).collect())
    want = by_sql(folder, name)
    assert [(r[:2], r[3:]) for r in got] == [(r[:2], r[3:]) for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1.1e-6)


def test_neither_postings_nor_scores_are_exchanged(spark, tmp_path):
    plan = QUERIES["hybrid_degraded_paths"](spark, tables(spark, tmp_path, odd=False))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "hashpartitioning(term" not in plan and plan.count("Exchange hashpartitioning") <= 6


def test_texts_stay_where_they_are_and_are_searched_once(spark, tmp_path):
    folder = tables(spark, tmp_path, odd=False)
    spark.read.parquet(f"{folder}/documents.parquet").withColumns({"lang": F.lit("en"), "source": F.concat(F.lit("src"), F.col("doc_id") % 4)}).write.parquet(f"{folder}/more/documents.parquet")
    for name in ("benchmark", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{folder}/more/{name}.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 9, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/more/labels.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["retrieval_quality_pipeline"](spark, f"{folder}/more")
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert "hashpartitioning(doc_id" not in plan and "hashpartitioning(term" not in plan and plan.count("MapInArrow") == 1
        assert {r.query_id for r in df.collect()} >= {0, 2, 4, 6, 8}  # those with a form
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_all_scores_and_the_best_are_alike(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    asked = spark.createDataFrame([("a", ["alpha", "zz", None]), ("b", ["the"]), (None, ["beta", "gamma"]), ("c", []), ("d", None)], "query_id string, terms array<string>")
    every = ret.bm25(docs, asked, "doc_id", "text")
    best = ret.bm25(docs, asked, "doc_id", "text", k=4)
    rows = lambda df: sorted(map(repr, ret.top_k(df, "query_id", "score", "doc_id", 4).collect()))
    assert rows(every) == rows(best) and {r.query_id for r in best.collect()} == {"a", "b", None}
    assert ret.bm25(docs, asked.limit(0), "doc_id", "text", k=4).count() == 0 and ret.bm25(docs.limit(0), asked, "doc_id", "text").count() == 0
    named = docs.filter("doc_id >= 200").select(F.concat(F.lit("n"), "doc_id").alias("name"), "text")
    assert [r.name for r in ret.top_k(ret.bm25(named, asked, "name", "text", k=3), "query_id", "score", "name", 3).filter("query_id = 'a'").orderBy("rank").collect()] == ["n200", "n201", "n202"]


def test_the_best_are_those_of_a_sort_however_often_it_is_cut(monkeypatch):
    monkeypatch.setattr(lexical, "HELD", 0)
    dice, best, every = np.random.default_rng(3), lexical.Best(5, 7), []
    for part in range(30):
        query, score, key = dice.integers(0, 5, 40), dice.integers(1, 6, 40) / 4, pa.array(range(part * 40, part * 40 + 40))
        best.add(query, score, np.arange(40), key)
        every += zip(query.tolist(), (-score).tolist(), key.to_pylist(), strict=True)
    want = [r for q in range(5) for r in sorted(x for x in every if x[0] == q)[:7]]
    assert [(r["query"], -r["score"], r["key"]) for r in best.cut().to_pylist()] == want
    assert best.size == 35 and lexical._rounded(np.array([0.1234565, 2.0, 1e-9])).tolist() == pytest.approx([0.123457, 2.0, 0.0], abs=1e-12)
