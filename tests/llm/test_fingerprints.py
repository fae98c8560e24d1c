import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import fingerprints as fp


@pytest.mark.parametrize("rows_per_part", [1, 3, 4000])
def test_each_row_meets_the_next(spark, rows_per_part):
    texts = ["the cat sat on the mat " * k for k in range(1, 12)] + ["", None, "one", "né " * 30, "né " * 30]
    rows = [(3 * i, x, True) for i, x in enumerate(texts)] + [(None, "no id here at all", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, guest boolean")
    got = {r.doc_id: r for r in fp.fingerprints(docs, rows_per_part=rows_per_part).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for i, (doc_id, text, _) in enumerate(order):
        following = order[(i + 1) % len(order)][1] or ""
        changed = fp.edited(text or "", following)
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text or ""), hashlib.sha256(changed.encode()).hexdigest())
        own = fp.sampled(pa.array([text or "", changed, following], pa.string()))
        assert r.fingerprint == fp.hexes(own)[0] and r.edited_fingerprint == fp.hexes(own)[1]
        assert r.near_edited == (own[0] == own[1]).mean() and r.near_next == (own[0] == own[2]).mean()
    assert got[42].fingerprint == got[45].fingerprint and got[42].near_next == 1


def test_repeated_ids_one_row_and_no_rows(spark):
    schema = "doc_id long, text string"
    assert fp.fingerprints(spark.createDataFrame([], schema)).count() == 0
    (one,) = fp.fingerprints(spark.createDataFrame([(5, "abcd efgh")], schema)).collect()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest()
    rows = fp.fingerprints(spark.createDataFrame([(5, "abcd efgh")] * 3 + [(6, "x")], schema), rows_per_part=1).collect()
    assert sorted(r.doc_id for r in rows) == [5, 5, 5, 6]


def test_collisions_estimate_generalised_jaccard():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(200)]
    a, b = (list(rng.choice(words, 300)) for _ in range(2))
    texts = [" ".join(a), " ".join(a[:150] + b[:150])]
    found = fp.sampled(pa.array(texts), samples=2000, terms=1 << 12)
    count = [{} for _ in texts]
    for c, t in zip(count, texts):
        w = t.split()
        for term in [*w, *zip(w, w[1:])]:
            c[term] = c.get(term, 0) + 1
    keys = set(count[0]) | set(count[1])
    true = sum(min(c.get(k, 0) for c in count) for k in keys) / sum(max(c.get(k, 0) for c in count) for k in keys)
    assert abs((found[0] == found[1]).mean() - true) < 0.08


def test_no_two_terms_of_long_texts_are_merged():
    texts = [" ".join(f"{x}{i}" for i in range(20_000)) for x in "ab"] + ["a b " * 3, ""]
    found = fp.sampled(pa.array(texts), samples=256)
    assert (found[0] == found[1]).mean() < 0.02 and not found[3].any()
    assert (fp.sampled(pa.array(texts), samples=256, terms=1 << 12) == found).all()
    assert (fp.sampled(pa.array(texts[:1]), samples=256) == found[:1]).all()


def test_marks_are_those_of_the_least_of_all_terms():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(n)], m)) for n, m in ((5, 1), (3, 40), (400, 900), (50, 3))] + ["é é é", "one"]
    got = fp.sampled(pa.array(texts), samples=96, terms=64)
    for text, marks in zip(texts, got, strict=True):
        words = text.split()
        column = fp.hashing.Words(pa.array([text]))
        count = {}
        for h in fp.hashing.mix(column.hash, 12).tolist() + column.grams(2, 11)[1].tolist():
            count[h] = count.get(h, 0) + 1
        assert len(count) == len(set(words)) + len(set(zip(words, words[1:])))
        terms = np.array(list(count), np.uint64)
        (r, b), one = fp.variates(terms, 96), fp.at_one(terms, 96)
        value = np.array([[o - (rr * np.floor(np.log(n).astype(np.float32) / rr + bb) if n > 1 else 0) for o, rr, bb in zip(*row, strict=True)] for n, row in zip(count.values(), zip(one, r, b, strict=True), strict=True)], np.float32)
        least = value.min(0)
        assert (marks == (fp.hashing.mix(least.view(np.uint32).astype(np.uint64), 13) & np.uint64(0xFFFF)).astype(np.uint16)).all()


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "a b")]
    got = {r.doc_id: r for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_next > 0.95 and got[2].near_next < 0.05 and got[1].n_chars == len(long)


def test_variates_have_the_distributions_asked_for():
    terms = fp.hashing.mix(np.arange(4000, dtype=np.uint64), 99)
    r, c, b = map(np.concatenate, zip(*[x[1:] for x in fp._drawn(terms, 64)], strict=True))
    c = np.exp(c)
    for g in (r, c):
        assert abs(g.mean() - 2) < 0.02 and abs(g.var() - 2) < 0.05 and abs((g < 1).mean() - (1 - 2 / np.e)) < 0.005
    assert abs(b.mean() - 0.5) < 0.003 and abs(b.var() - 1 / 12) < 0.001 and 0 < b.min() and b.max() < 1
    for x, y in ((r, c), (r, b), (c, b), (r[:, :-1], r[:, 1:]), (r[:-1], r[1:])):
        assert abs(np.corrcoef(x.reshape(-1), y.reshape(-1))[0, 1]) < 0.01
