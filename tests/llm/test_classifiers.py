import random
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import language, quality

SYLLABLES = {"en": "the ing th er on wh ou".split(), "de": "der ung sch ein ä ver ich".split(), "fr": "les eau que ou é ment ai".split(), "es": "los ción que ado ñ ar ll".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_languages_of_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randint(20, 80)), lang, 0.5) for i, lang in enumerate(list(SYLLABLES) * 40)]
    rows += [(1000, None, "en", 0.5), (1001, "", "en", 0.5), (1002, "123 --- 456", "en", 0.5), (1003, "x" * 300_000, None, 0.5), (None, rows[0][1], "en", 0.5), (7, rows[7][1], rows[7][2], 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    folds = language.fold(docs)
    got = language.identify(docs, folds.filter("_fold <> 1"), keep=("doc_id", "lang")).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1000, 1001, 1002)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 and r.lang_pred in SYLLABLES for r in got if r.doc_id not in (1000, 1001, 1002))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.identify(docs, docs).collect()] == [("und", 0.0)]
    one = docs.selectExpr("doc_id", "text", "'xx' as lang")
    assert [r.lang_pred for r in language.identify(docs, one).collect()] == ["xx"]
    assert language.identify(docs.limit(0), one).count() == 0


def test_neighbours_in_a_slice_dont_change_a_text():
    weights = np.random.default_rng(0).standard_normal((language.CELLS + 1, 3)).astype(np.float32)
    weights[-1], weights[:-1, -1] = 0, 1
    texts = ["abc déf", "zz", "", "ghi jkl mno"]
    whole = language.margins(pa.array(texts), weights)
    for i, text in enumerate(texts):
        assert np.allclose(whole[i], language.margins(pa.array([text]), weights)[0])


def test_quality_of_held_out_texts(spark):
    rng = random.Random(2)
    good = lambda: prose(rng, "en", rng.randint(20, 200))
    bad = lambda: " ".join(x + rng.choice(["###", "%%%", "&&&"]) for x in good().split()) if rng.random() < 0.5 else (prose(rng, "en", 1) + " ") * rng.randint(20, 90)
    rows = [(i, good() if i % 4 else bad(), int(i % 4 > 0), 1) for i in range(600)]
    extra = [(900, None, 1, 1), (901, "", 0, 1), (902, "y" * 200_000, None, 1), (None, "a b", 1, 1), (3, rows[3][1], rows[3][2], 1)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, label int, n_bytes int")
    got = quality.score(docs, docs.filter("doc_id % 5 <> 0")).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    truth = {i: label for i, _, label, _ in rows}
    held = [(r.score >= quality.THRESHOLD) == truth[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 5 == 0]
    assert np.mean(held) > 0.95


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", 1)], "doc_id long, text string, label int")
    assert [r.score for r in quality.score(docs, docs.limit(0)).collect()] == [0.5]
    assert quality.score(docs.limit(0), docs).count() == 0
    assert quality.score(docs, docs).first().score > 0.9


def test_ties_go_to_the_name_that_sorts_first():
    model = {"families": ["germanic", "romance"], "members": [["de", "en"], ["es", "fr"]], "pairs": [("de", "en"), ("es", "fr")], "slopes": np.ones(4)}
    langs, score = language.decide(model, np.zeros((1, 4)))
    assert langs == ["de"] and score[0] == 0.25


def test_equal_texts_have_equal_scores(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, "en", 60) if i % 2 else "### " * rng.randint(5, 60), i % 2) for i in range(80)]
    rows += [(200 + i, rows[i][1], None) for i in range(80)] + [(i, *rows[i][1:]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    by = {}
    for r in quality.score(docs, docs.filter("label is not null"), ("doc_id", "text")).collect():
        by.setdefault(r.text, set()).add(r.score)
    assert all(len(x) == 1 for x in by.values())


def test_isotonic_is_the_nearest_rising_function():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, 200).astype(float)
    y = (rng.random(200) < x / 12).astype(float)
    places, values = quality.isotonic(x, y)
    assert (np.diff(values) >= 0).all() and (np.diff(places) >= 0).all()
    levels = np.unique(x)
    share, n = np.array([y[x == k].mean() for k in levels]), np.array([(x == k).sum() for k in levels])
    for i, k in enumerate(levels):  # the largest of the least means over ranges around k
        best = max(min(np.average(share[a : b + 1], weights=n[a : b + 1]) for b in range(i, len(levels))) for a in range(i + 1))
        own = np.interp(k, places, values)
        assert abs(own - best) < 0.06
