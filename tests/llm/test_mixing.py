import pytest

from tessera.llm import mixing


def places(df):
    return [(r.slot, r.place, r.source, r.block) for r in df.orderBy("slot", "place").collect()]


def test_no_source_is_a_block_off(spark):
    targets = spark.createDataFrame([("a", 5), ("b", 3), (None, 1), ("d", 7)], "source string, q long")
    slots = sorted((r.slot, r.source, r.k) for r in mixing.schedule(targets).collect())
    assert [s for s, _, _ in slots] == list(range(16))
    shares = {"a": 5, "b": 3, None: 1, "d": 7}
    for upto in range(1, 17):
        for source, q in shares.items():
            ran = sum(s == source for _, s, _ in slots[:upto])
            assert abs(ran - upto * q / 16) < 1


@pytest.mark.parametrize("block", [1, 4])
def test_every_row_has_a_place_of_its_own(spark, block):
    rows = [(i, "a" if i % 3 else "b", 9, 9) for i in range(200)] + [(1, "a", 9, 9), (1, "a", 9, 9), (None, None, 9, 9), (7, None, 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot long, n long")
    got = mixing.mix(docs, block_docs=block, period=64)
    found = places(got)
    assert len(found) == len(rows) == len({x[:2] for x in found})
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r[0]) for r in rows)
    for slot in {x[0] for x in found}:
        assert len({x[2:] for x in found if x[0] == slot}) == 1
    n = {"a": 0, "b": 0}
    targets = {r.source: r.q for r in mixing.shares(docs.groupBy("source").count().withColumnRenamed("count", "n"), period=64).collect()}
    total = sum(targets.values())
    last = min(max(s for s, _, source, _ in found if source == k) for k in n)
    for upto in range(1, last + 1):
        for k in n:
            ran = len({s for s, _, source, _ in found if source == k and s < upto})
            assert abs(ran - upto * targets[k] / total) < 1


def test_given_targets_and_an_empty_table(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "doc_id long, source string")
    targets = spark.createDataFrame([("a", 3)], "source string, q long")
    found = places(mixing.mix(docs, targets, block_docs=1))
    assert [x[2] for x in found[:8]].count("a") == 6 and len(found) == 40
    assert mixing.mix(docs.limit(0)).count() == 0


def test_the_schedule_is_that_of_a_plain_loop(spark):
    shares = {"a": 13, "b": 3, "c": 1, "d": 7, "e": 40}
    got = sorted((r.slot, r.source, r.k) for r in mixing.schedule(spark.createDataFrame(list(shares.items()), "source string, q long")).collect())
    total, done, expected = sum(shares.values()), dict.fromkeys(shares, 0), []
    for slot in range(total):
        released = [(-(-(done[s] + 1) * total // q), s) for s, q in shares.items() if done[s] < q and done[s] * total < (slot + 1) * q]
        _, s = min(released)
        expected.append((slot, s, done[s]))
        done[s] += 1
    assert got == expected


def test_columns_of_any_name_pass(spark):
    names = ["_b", "_h", "_r", "_rank", "_row", "_doc", "_s", "_q", "a.b", "k", "q"]
    docs = spark.createDataFrame([(i, f"s{i % 2}", *[f"{n}{i}" for n in names], i) for i in range(50)], "doc_id long, source string, " + ", ".join(f"`{n}` string" for n in names) + ", slot long")
    got = mixing.mix(docs, block_docs=2, period=16)
    assert got.columns == ["doc_id", "source", *names, "block", "slot", "place"]
    rows = got.collect()
    assert len(rows) == 50 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    plain = mixing.mix(docs.select("doc_id", "source"), block_docs=2, period=16)
    assert sorted((r.doc_id, r.slot, r.place) for r in rows) == sorted((r.doc_id, r.slot, r.place) for r in plain.collect())


def test_one_hot_source_and_null_ids(spark):
    rows = [(i, "hot") for i in range(500)] + [(None, "hot")] * 200 + [(i, None) for i in range(9)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_docs=4, period=8).collect()
    assert len({(r.slot, r.place) for r in got}) == len(rows)
