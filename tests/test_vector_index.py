"""The stored vector index against full comparison."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import vector_index
from tessera.sources.vector_index import CHUNK, VectorIndex

PROBE = "query_id long, probe array<double>"


def rows_of(rng, n, dim=4, tenant="a"):
    return [(tenant, f"d{i // 3}", i % 3, f"text {i}", [["x"], ["y", "x"], None][i % 3], None, [round(rng.uniform(-1, 1), 3) for _ in range(dim)]) for i in range(n)]


def cosine(a, b):
    a, b = [float(np.float32(x)) for x in a], [float(x) for x in b]
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / size, 6) if size else 0.0


def plain(rows, probes, k, least=None, allowed=lambda r: True):
    out = []
    for q, p in probes:
        scored = sorted((-cosine(r[6], p), *r[:4]) for r in rows if allowed(r) and (least is None or cosine(r[6], p) >= least))
        out += [(q, i + 1, -s, *rest) for i, (s, *rest) in enumerate(scored[:k])]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r.rank, r.score, r.tenant_id, r.document_id, r.chunk_index, r.chunk_text) for r in df.collect())


def test_writes_deletes_tags_and_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "HELD", 5)
    rng = random.Random(1)
    rows = rows_of(rng, 60) + [("b", "d1", 0, "other tenant", ["x"], None, [1.0, 0.0, 0.0, 0.0])] + [("a", "same", i, "copy", ["x"], None, [0.5] * 4) for i in range(9)]
    probes = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.5] * 4), (3, [0.0] * 4)]
    asked = spark.createDataFrame([*probes, (4, None), (5, [1.0])], PROBE)
    index = VectorIndex(spark, str(tmp_path / "index"), 4, cells=5)
    assert index.count() == 0 and got(index.search(asked, 3)) == [] and index.health()["details"]["version"] == 0
    bad = [("a", "bad", i, "", None, None, v) for i, v in enumerate([None, [1.0], [None] * 4, [float("nan")] * 4, [float("inf")] * 4])]
    assert index.upsert(spark.createDataFrame(rows + bad, CHUNK).withColumn("extra", F.lit(1))) == len(rows)
    assert got(index.search(asked, 5)) == plain(rows, probes, 5)
    # a document is replaced as a whole, in its tenant only
    again = [("a", "d1", 0, "new", ["y"], None, [0.0, 1.0, 0.0, 0.0])]
    assert index.upsert(spark.createDataFrame(again, CHUNK)) == 1
    rows = [r for r in rows if r[:2] != ("a", "d1")] + again
    assert index.delete(spark.createDataFrame([("a", "d2"), ("a", "nowhere"), ("a", "d2")], "tenant_id string, document_id string")) == 3
    rows = [r for r in rows if r[:2] != ("a", "d2")]
    assert index.update_tags(spark.createDataFrame([("a", "d3", ["z"])], "tenant_id string, document_id string, tags array<string>")) == 3
    rows = [(*r[:4], ["z"], *r[5:]) if r[:2] == ("a", "d3") else r for r in rows]
    assert index.count() == len(rows)
    assert sorted((r.tenant_id, r.document_id, r.chunk_index, r.tags) for r in index.rows().filter("document_id = 'd3'").collect()) == [("a", "d3", i, ["z"]) for i in range(3)]
    for _ in range(2):
        assert got(index.search(asked, 4)) == plain(rows, probes, 4)
        tagged = index.search(asked, 4, least=0.1, allowed=F.array_contains("tags", "x"))
        assert got(tagged) == plain(rows, probes, 4, 0.1, lambda r: r[4] is not None and "x" in r[4])
        assert index.compact() == len(rows)  # and once more after it
    assert index.health()["details"] == {"version": 6, "writes": 1, "vectors": len(rows), "tombstones": 0}
    index.clear()
    assert index.count() == 0
    assert index.upsert(spark.createDataFrame(again, CHUNK)) == 1 and index.count() == 1


def test_probes_in_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = rows_of(rng, 40)
    index = VectorIndex(spark, str(tmp_path / "index"), 4, cells=3)
    index.upsert(spark.createDataFrame(rows, CHUNK))
    probes = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(7)]
    monkeypatch.setattr(vector_index, "SENT", 12)
    assert got(index.search(spark.createDataFrame(probes, PROBE), 3)) == plain(rows, probes, 3)


def test_uncommitted_files_are_not_read_and_writers_take_turns(spark, tmp_path):
    rng = random.Random(3)
    one, two = (VectorIndex(spark, str(tmp_path / "index"), 4) for _ in range(2))
    one.upsert(spark.createDataFrame(rows_of(rng, 6), CHUNK))
    two._celled(spark.createDataFrame(rows_of(rng, 3), CHUNK)).write.partitionBy("cell").parquet(f"{tmp_path}/index/vectors/batch=lost")
    assert one.count() == 6
    known = two.versions

    def late():  # another writer commits between the look and the commit
        two.versions = known
        seen = known()
        one.upsert(spark.createDataFrame([("a", "x", 0, "", None, None, [1.0] * 4)], CHUNK))
        return seen

    two.versions = late
    assert two.upsert(spark.createDataFrame([("a", "y", 0, "", None, None, [1.0] * 4)], CHUNK)) == 1
    assert [v.version for v in one.versions()] == [1, 2, 3] and one.count() == 8


def test_few_cells_find_most(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(scale=0.35, size=(6000, 16))
    rows = [("a", f"d{i}", 0, "", None, None, v) for i, v in enumerate(x.tolist())]
    index = VectorIndex(spark, str(tmp_path / "index"), 16)
    index.upsert(spark.createDataFrame(rows, CHUNK))
    assert 60 <= len(index.centroids()) <= 80
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 6000, 300)], PROBE)
    full, few = ({(r.query_id, r.document_id) for r in index.search(asked, 10, cells).collect()} for cells in (None, 6))
    assert len(full & few) / len(full) >= 0.9


@pytest.mark.parametrize("rows", [[], [("a", "d", 0, "", None, None, [0.0] * 4)]])
def test_first_write_without_directions(spark, tmp_path, rows):
    index = VectorIndex(spark, str(tmp_path / "index"), 4)
    assert index.upsert(spark.createDataFrame(rows, CHUNK)) == len(rows)
    assert index.search(spark.createDataFrame([(1, [1.0] * 4)], PROBE), 3).count() == len(rows)
