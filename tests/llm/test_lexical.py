import math
import random
import re
from collections import Counter

import pytest

from tessera.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, limit):
    counts = [(i, Counter(terms(x))) for i, x in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_all = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c in counts:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if gone else doc_id, -score) for rank, (score, gone, doc_id) in enumerate(sorted(found)[:limit], 1)]
    return out


DOCS = [
    (1, "The cat sat. THE CAT'S hat"), (2, "cat"), (3, "cat"), (3, "cat"), (4, None), (5, ""), (6, " .,- \x00\n"), (7, "Straße straße STRASSE Ärger ärger café"), (8, "a a a a_b a-b 9x 9X"),
    (None, "cat hat"), (9, "hat " * 30_000), (10, "catcat concat cat\x7fcat dog"), (11, "日本語 x 日本"), (12, "the " * 5), (13, "the"),
]
ITEMS = [(1, "cat"), (2, "Cat cat the dog"), (3, None), (4, "..."), (5, "straße ÄRGER ärger"), (6, "a b 9x zebra"), (1, "hat cat"), (7, "日本"), (None, "hat"), (8, "x" * 5000 + " cat")]


@pytest.mark.parametrize(("limit", "held", "size"), [(20, 400_000, 4_000_000), (2, 3, 5_300)])
def test_same_as_row_by_row(spark, monkeypatch, limit, held, size):
    monkeypatch.setattr(lexical, "HELD", held)
    monkeypatch.setattr(lexical, "SHARD_BYTES", size)
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = DOCS + [(100 + i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(200)]
    items = ITEMS + [(50 + i, " ".join(rng.choices(words, k=10))) for i in range(15)]
    given = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, row int").repartition(3)
    asked = spark.createDataFrame([(*d, 1, 2) for d in items], "item_id long, text string, rank int, doc_id int")
    got = [tuple(r) for r in lexical.rank(given, asked, limit).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(plain(docs, items, limit), key=key)


def test_nothing_to_rank(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "doc_id long, text string")
    ask, no_items = spark.createDataFrame([(1, "a")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert lexical.rank(none, ask).collect() == lexical.rank(some, no_items).collect() == []
    assert lexical.rank(some, spark.createDataFrame([(1, None), (2, "-")], "item_id long, text string")).collect() == []
    assert lexical.rank(some, ask).columns == lexical.rank(some, no_items).columns == ["item_id", "rank", "doc_id", "score"]


def test_only_whole_terms_match():
    shard = lexical.Shard([0], ["cat at a"])
    found = shard.counts(lexical.normal("Cat cats concat at. a,a catat"))
    assert {shard.terms[i]: n for i, n in found.items()} == {"cat": 1, "at": 1, "a": 2}
