import hashlib
import random

import pytest

from tessera.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, values int"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The method row by row, in Python's whole numbers."""
    import math

    kept = [(i, [math.floor(x * scale) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    n = width // parts
    cut = lambda v: [tuple(v[p * n : (p + 1) * n]) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]

    def nearest(part, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[part]))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in kept:
                x = cut(v)[p]
                mine.setdefault(nearest(p, x)[1], []).append(x)
            books[p] = [tuple(sum(c) // len(mine[k]) for c in zip(*mine[k], strict=True)) if k in mine else e for k, e in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        found = [nearest(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    return out, [x for book in books for e in book for x in e]


def given(rng):
    rows = [(i, [rng.uniform(-1, 1) * rng.choice([1, 3, 40]) for _ in range(16)], rng.choice([1, 2, None])) for i in range(300)]
    rows = [(i, [float(f"{x:.3f}") for x in v], label) for i, v, label in rows]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] + [0.0] * 15, 2), (304, [float("inf")] + [0.0] * 15, 2)]
    rows += [(5, rows[5][1], 1), (None, rows[7][1], None), (400, [-0.00001] * 11, 3), (401, [], 3), *[(500 + i, rows[0][1], 1) for i in range(150)]]
    return rows


def single(x):
    import struct

    return x if x is None else struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("block", [8192, 50])
def test_same_as_row_by_row(spark, monkeypatch, block):
    monkeypatch.setattr(codes, "BLOCK", block)
    rows = [(i, v and [single(x) for x in v], label) for i, v, label in given(random.Random(4))]
    found, books = codes.compress(spark.createDataFrame([(i, v, label, "c", 1, 2) for i, v, label in rows], SCHEMA).repartition(3))
    wanted, flat = plain(rows)
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.vec_id, r.code, r.error) for r in found.collect()), key=key) == sorted(((i, c, e) for i, c, e, _ in wanted), key=key)
    assert books.ravel().tolist() == flat


def test_few_rows_ties_and_none(spark):
    rows = [(2, [1.0] * 8, 1), (1, [1.0] * 8, 1)]
    found, books = codes.compress(spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA))
    assert {(r.vec_id, r.code, r.error) for r in found.collect()} == {(1, "00" * 8, 0), (2, "00" * 8, 0)}
    assert books.shape == (8, 2, 1)
    for nothing in ([], [(1, None, 1, "c", 1, 2)]):
        found, books = codes.compress(spark.createDataFrame(nothing, SCHEMA))
        assert found.collect() == [] and books.size == 0


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1, "c", 1, 2)], SCHEMA))


def test_query_labels_and_digest(spark, tmp_path):
    rows = [(i, [float(i % 5)] * 8, [1, None][i % 2]) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    wanted, flat = plain(rows)
    got = codes.op11_vector_codes(spark, str(tmp_path)).collect()
    sums = {}
    for _, _, e, label in wanted:
        sums[label] = sums.get(label, 0) + e
    labels = {i: label for i, _, label in rows}
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in got} == {(i, c, e, sums[labels[i]]) for i, c, e, _ in wanted}
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()}
