"""Connectors, settings and strategies; streams by hand; queries as a whole."""

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.functions import config
from tessera.sources import connectors
from tessera.streaming import events


def test_export(spark, tmp_path):
    connectors.export(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, chunk string"), str(tmp_path / "out"), "doc_id")
    assert sorted(x for x in os.listdir(tmp_path / "out") if x.startswith("doc_id")) == ["doc_id=1", "doc_id=2"]


def test_dispatch_is_signed_and_tried_again(spark, tmp_path):
    log = str(tmp_path / "sent")

    def send(url, headers, body):
        with open(log, "a") as f:
            f.write(json.dumps([url, headers["X-Signature"], body.decode()]) + "\n")
        with open(log) as f:
            return len(f.readlines()) > 1

    batch = spark.createDataFrame([("x", 1)], "event_type string, n int").coalesce(1)
    connectors.dispatcher(send, {"x": ["u"]}, b"k")(batch, 0)
    sent = [json.loads(x) for x in open(log)]
    assert len(sent) == 2 and sent[0] == sent[1] and sent[0][1] == connectors.signature(b"k", sent[0][2].encode())


def test_settings(spark):
    assert config.lookup("a", {}, {"A": "2"}, "3") == "2" and config.lookup("a", {"a": "1"}, {"A": "2"}) == "1" and config.lookup("b", {}, {}, "3") == "3"
    assert config.tenant('{"row_cap": 5, "other": 1, "models": ["m"]}', ["m"]).row_cap == 5
    with pytest.raises(ValueError):
        config.tenant('{"models": ["x"]}', ["m"])
    assert config.first_prompt("p", {}, {"p": "module"}, {"p": "core"}) == "module"
    rows = spark.createDataFrame([("pending", 0), ("running", 1), ("running", 9), ("done", 0)], "s string, l int")
    assert [r[0] for r in rows.select(config.claim(F.col("s"), F.col("l"), F.lit(5))).collect()] == ["running", "running", "running", "done"]
    assert list(config.budgeted({"a_b": ["x"] * 30, "c_d": ["y"] * 30}, "the C D of", columns=1)) == ["c_d"]
    assert config.column_signals("profit_loss", {"net_sum": "double", "name": "string"})["__quantitative__"] == ["net_sum"]


def test_strategy(spark):
    text = json.dumps({"namespaces": ["client", "topic"], "path_rules": [{"namespace": "client", "level": 1, "pattern": "(.+)", "mapping": {"wc": "walnut"}}], "keyword_rules": [{"namespace": "topic", "value": "a", "any_of": ["Claim"], "priority": 1}, {"namespace": "topic", "value": "b", "all_of": ["claim", "loss"], "priority": 2}]})
    s = config.Strategy.load(text)
    rows = spark.createDataFrame([("x/wc/y", "a claim of loss"), ("x", "CLAIM"), ("x/z", "none")], "p string, t string")
    got = [(r[0], r[1]) for r in rows.select(s.path_tags(F.col("p")), s.keyword_tags(F.col("t"))).collect()]
    assert got == [(["client:walnut"], ["topic:b"]), ([], ["topic:a"]), (["client:z"], [])]
    with pytest.raises(ValueError):
        config.Strategy.load('{"namespaces": [], "path_rules": [{"namespace": "client", "level": 1, "pattern": "x"}]}')


def test_progress_is_told_on_change(spark, tmp_path):
    folder = str(tmp_path / "in")
    for ids in ([1, 1, 2], [1]):
        spark.createDataFrame([(i,) for i in ids], "user_id long").coalesce(1).write.mode("append").parquet(folder)
    like = spark.read.parquet(folder)
    out = events.run_to_end(events.progress(events.stream(like, folder, 1), "user_id"), str(tmp_path / "state"), "update")
    assert sorted(tuple(r) for r in out.collect()) in ([(1, 1), (1, 3), (2, 1)], [(1, 2), (1, 3), (2, 1)])


def test_late_events_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i, day in enumerate(("2024-01-01 10:30:00", "2024-01-01 15:00:00", "2024-01-01 15:10:00", "2024-01-01 10:40:00", "2024-01-01 18:00:00")):
        spark.sql(f"SELECT TIMESTAMP_NTZ '{day}' AS ts, {i}.0D AS value").coalesce(1).write.mode("append").parquet(folder)
    files = sorted(f"{folder}/{x}" for x in os.listdir(folder) if x.endswith(".parquet"))
    for k, f in enumerate(sorted(files, key=os.path.getmtime)):
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    streamed = events.tumbling(events.stream(spark.read.parquet(folder), folder, 1), "1 hour", "1 hour")
    out = events.run_to_end(streamed, str(tmp_path / "state"), "append")
    assert [(str(r.begin), r.n) for r in out.orderBy("begin").collect()] == [("2024-01-01 10:00:00", 1), ("2024-01-01 15:00:00", 2)]


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no data here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["vec_id", "score"]
