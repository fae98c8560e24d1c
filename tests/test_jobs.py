"""Progress of jobs as a stream with state and timers."""

import datetime
import os

import pytest

from tessera.streaming import events as ev
from tessera.streaming import jobs

SCHEMA = "key string, at timestamp_ntz, seq long, outcome string, total long"
DAY = 86_400_000_000


def at(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


def us(day, hour=0):
    return int((at(day, hour) - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


BATCHES = [
    [("a", at(1), 1, "completed", 4), ("a", at(1, 6), 3, "paused", 4), ("a", at(1, 6), 2, "other", 4), ("b", at(1), 1, None, 2), (None, at(1), 1, "failed", 1), ("c", None, 1, "failed", 1), ("e", at(1), 1, "x", None)],
    [("a", at(1, 12), 4, "paused", 4), ("a", at(3), 5, "failed", 4), ("a", at(3, 1), 6, "paused", 4), ("d", at(3), 1, "skipped", 1), ("d", at(3), 2, "completed", 1)],
    [("a", at(3, 2), 7, "skipped", 4), ("a", at(3, 3), 8, "completed", 4), ("a", at(3, 4), 9, "completed", 4), ("z", at(6), 1, "paused", 9)],
]


def written(spark, folder, batches, first=0):
    for i, rows in enumerate(batches, first):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.endswith(".parquet") and name not in seen:
                seen.add(name)
                os.utime(f"{folder}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))


seen: set[str] = set()


def told(spark, source, out):
    like = spark.createDataFrame([], SCHEMA)
    with jobs.state_store(spark):
        rows = ev.run_to_end(jobs.follow(ev.stream(like, source, 1)), out, "append").collect()
    return rows


def test_all_kinds_over_three_batches_and_a_restart(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    written(spark, source, BATCHES[:2])
    told(spark, source, out)
    written(spark, source, BATCHES[2:], 2)
    rows = told(spark, source, out)  # goes on from the checkpoint
    mine = sorted((r.at_us, r.kind) for r in rows if r.key == "a")
    assert mine == sorted([
        (us(1), "connected"), (us(1), "progress"), (us(1, 6), "paused"), (us(2), "heartbeat"), (us(3), "heartbeat"), (us(3), "progress"),
        (us(3, 1), "paused"), (us(3, 2), "progress"), (us(3, 3), "progress"), (us(3, 3), "complete"),
    ])
    last = next(r for r in rows if r.key == "a" and r.kind == "complete")
    assert (last.processed, last.completed, last.failed, last.skipped, last.total, last.status) == (4, 2, 1, 1, 4, "completed_with_errors")
    assert {(r.kind, r.percent) for r in rows if r.key == "a" and r.kind == "progress"} == {("progress", 25), ("progress", 50), ("progress", 75), ("progress", 100)}
    # nothing more came for b: its heartbeats are timers', up to the watermark
    assert sorted((r.at_us, r.kind) for r in rows if r.key == "b") == sorted([(us(1), "connected"), (us(1), "progress"), *[(us(d), "heartbeat") for d in (2, 3, 4, 5)]])
    assert sorted((r.kind, r.processed) for r in rows if r.key == "d") == [("complete", 1), ("connected", None), ("progress", 1)]
    assert sorted(r.kind for r in rows if r.key == "e") == ["complete", "connected", "progress"]
    assert sorted(r.kind for r in rows if r.key == "z") == ["connected", "paused", "progress"]
    assert {r.key for r in rows} == {"a", "b", "d", "e", "z"}


def test_same_rows_in_one_batch(spark, tmp_path):
    written(spark, str(tmp_path / "in"), [[r for rows in BATCHES[:2] for r in rows], BATCHES[2]])
    rows = told(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted((r.at_us, r.kind) for r in rows if r.key == "a" and r.kind != "heartbeat")[-1] == (us(3, 3), "progress") and sum(r.key == "a" for r in rows) == 10


def test_the_sessions_own_provider_comes_back(spark):
    name = jobs._PROVIDER[0]
    before = spark.conf.get(name, None)
    with pytest.raises(KeyError), jobs.state_store(spark):
        assert "RocksDB" in spark.conf.get(name)
        raise KeyError
    assert spark.conf.get(name, None) == before
