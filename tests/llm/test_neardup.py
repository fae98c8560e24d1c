import random

import numpy as np
import pytest

from tessera.llm import neardup


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is None or rows[j][1] is None:
                continue
            both = len(sets[i] | sets[j])
            if rows[i][1] == rows[j][1] or (both and len(sets[i] & sets[j]) >= 0.8 * both):
                root[find(i)] = find(j)
    return {frozenset(k for k in range(len(rows)) if find(k) == r) for r in {find(k) for k in range(len(rows))}}


def corpus():
    random.seed(4)
    text = lambda n: [f"w{random.randint(0, 400)}" for _ in range(n)]
    rows = []
    for _ in range(12):
        base = text(random.randint(30, 150))
        rows.append(" ".join(base))
        for _ in range(random.randint(0, 8)):
            copy = list(base)
            for _ in range(random.randint(0, 3)):
                copy[random.randrange(len(copy))] = "new"
            rows.append(" ".join(copy))
    rows += ["a b c", "a b c", "a b", "", "", None, None, "one"]
    random.shuffle(rows)
    return [(i, x) for i, x in enumerate(rows)]


@pytest.mark.parametrize(("rounds", "bands"), [(2, 25), (1, 40)])
def test_classes_are_those_of_all_pairs(spark, rounds, bands, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rows = corpus()
    docs = spark.createDataFrame([(i, x, 1, b"n") for i, x in rows], "doc_id long, text string, least int, node binary")
    got = {}
    for r in neardup.near_duplicates(docs, rounds=rounds, bands=bands).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(x) for x in got.values()} == brute(rows)
    assert all(min(v) == k for k, v in got.items())


def test_one_of_each_class_stays(spark):
    rows = [(2, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "y"), (5, None, "z"), (6, None, "z"), (None, "q r s t u", "n"), (None, "q r s t u", "n"), (9, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((str(r.doc_id), str(r.text), r.source) for r in neardup.deduplicate(docs).collect())
    assert got == [("1", "a b c d e f", "y"), ("5", "None", "z"), ("6", "None", "z"), ("9", "", "e"), ("None", "q r s t u", "n")]


def test_an_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(5)
    elements = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    a, b = rng.uniform(0.2, 6, 60), rng.uniform(0.2, 6, 60)
    row, h, w = np.repeat([0, 1], 60), np.r_[elements, elements], np.r_[a, b]
    s = neardup.signatures(row, h, w, 2, 4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_repeats_within_a_text_do_not_hide_it(spark):
    random.seed(6)
    rows = []
    for i in range(20):
        text = " ".join(f"t{i}w{random.randint(0, 10_000)}" for _ in range(150))
        rows += [(3 * i, text), (3 * i + 1, " ".join([text] * 2)), (3 * i + 2, " ".join([text] * 5))]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 3 for i in range(60)}


def test_very_long_texts_and_one_large_group(spark):
    random.seed(9)
    long = [f"w{random.randint(0, 5000)}" for _ in range(60_000)]
    base = [f"b{random.randint(0, 300)}" for _ in range(120)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:30_000], "new", *long[30_000:]])), (3, " ".join(long[:20_000]))]
    rows += [(10 + i, " ".join(base)) for i in range(300)] + [(400 + i, " ".join([*base[: i % 110], f"x{i}", *base[i % 110 :]])) for i in range(300)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 1 if i < 3 else 3 if i == 3 else 10 for i, _ in rows}


def test_columns_of_any_names_stay(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(2, text, "a", "b", "c", "d"), (1, text, "e", "f", "g", "h"), (3, None, "i", "j", "k", "l"), (4, "other words here and there", "m", "n", "o", "p")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, node string, label string, _row string, `a.b` string")
    got = neardup.deduplicate(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(rows[1:])
