import random

import pytest

import corpus_pipeline
from tessera.llm import common, packing, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(6)
    word = lambda lang: "".join(random.choices({"en": ["the", "ing", "th"], "de": ["sch", "ung", "ä"]}[lang], k=random.randint(1, 4)))
    passage = " ".join(word("en") + str(i) for i in range(70))
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(word(lang) for _ in range(120)) + (f" {passage}" if i % 10 == 5 else ""), lang, f"s{i % 4}"))
    rows += [(100 + i, rows[i][1], rows[i][2], "s0") for i in range(5)] + [(200, None, "en", "s1"), (201, "12345", "en", "s1"), (202, rows[7][1] + " more", "en", None)]
    where = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame([(*r, len(r[1] or ""), "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{where}/documents.parquet")
    return where


def test_stages_act_one_after_the_other(spark, folder):
    docs = common.table(spark, folder, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, folder), name)
        if name != "packing":
            assert set(docs.columns) == set(corpus_pipeline.COLUMNS)
        kept[name] = docs.collect()
    ids = {k: sorted(r.doc_id for r in v) for k, v in kept.items()}
    assert {200, 201}.isdisjoint(ids["language"]) and len(ids["language"]) == 66
    assert ids["near_duplicates"] == list(range(60))
    assert ids["repeats"] == ids["mixing"] == list(range(60))
    words = {r.doc_id: r.text.split() for r in kept["repeats"]}
    assert len(words[5]) == 190 and all(len(words[i]) in (118, 119, 120) for i in range(60) if i != 5)  # a word before the passage may be the same, too
    assert sorted(set(ids["packing"])) == list(range(60))
    assert max(r.offset + r.length for r in kept["packing"]) <= packing.CAPACITY


def test_run_gives_the_last_stage(spark, folder):
    assert set(corpus_pipeline.run(spark, folder).columns) >= {"doc_id", "piece", "sequence_id", "offset", "length"}


def test_the_queries_are_all_there():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))


def test_empty_tables_stay_empty(spark, folder):
    docs = common.table(spark, folder, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, folder), name)
        assert docs.count() == 0


def test_repeated_rows_nulls_and_long_texts(spark, folder, tmp_path):
    random.seed(7)
    text = lambda n: " ".join(random.choice(["the", "ing", "th"]) + str(random.randint(0, 99)) for _ in range(n))
    short, long = text(40), text(30_000)
    rows = [(1, short, "en", "a"), (1, short, "en", "a"), (None, text(60), None, None), (None, None, None, None), (2, "", "en", "a"), (3, long, "en", "b"), (4, text(60), "en", None)]
    spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {None, 1, 3, 4} and sum(r.doc_id == 1 for r in got) == 1
    assert sum(r.length for r in got if r.doc_id == 3) > packing.CAPACITY


def test_sequences_follow_the_mix(spark, tmp_path):
    rows = [(i, f"the {i}", "en", "ab"[i % 4 == 0], 5) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mixed(spark, docs, "")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = common.written(mixed, "mixing")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    source = {r[0]: r[3] for r in rows}
    got = corpus_pipeline.packed(spark, stored, "").orderBy("sequence_id").collect()
    first = [source[r.doc_id] for r in got[:1000]]
    assert 0.3 < first.count("b") / 1000 < 0.5  # damped weights: 0.37 of the mix, against a quarter of the rows
