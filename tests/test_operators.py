"""Operators by hand: small rows, known results."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import backends, ids, lists, rules
from tessera.functions import retrieval as ret
from tessera.functions import text as tx
from tessera.functions.vectors import cosine
from tessera.operators import aggregates as agg
from tessera.operators import chunking as ch
from tessera.operators import filters as flt
from tessera.operators import joins as jn
from tessera.operators import mutations as mut
from tessera.operators import sets as st
from tessera.operators import windows as win
from tessera.sources import files, sql


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_public_or_any(spark):
    rows = [(["public"],), (["a"],), (["b", None],), ([],), (None,)]
    see = lambda user: values(spark, rows, "tags array<string>", flt.public_or_any(F.col("tags"), user))
    assert see(None) == [True] * 5
    assert see([]) == [True, False, False, False, False]
    assert see(["b"]) == [True, False, True, False, False]
    assert all(b or not a for a, b in zip(see(["a"]), see(["a", "b"])))  # more tags never hide a row


def test_all_required_and_any_overlap(spark):
    own = F.array(F.lit("x"), F.lit("y"))
    rows = [(["x"],), (["x", "z"],), ([],)]
    assert values(spark, rows, "r array<string>", flt.all_required(F.col("r"), own)) == [True, False, True]
    assert values(spark, rows, "r array<string>", flt.any_overlap(F.col("r"), own)) == [True, True, True]


def test_tokens_of_four_languages(spark):
    assert values(spark, [("müller abc señor x9 I a1",)], "t string", tx.tokens("t")) == [["abc", "x9", "a1"]]
    assert values(spark, [("The limits of policy, the LIMITS",)], "t string", tx.key_terms("t", lists.STOP_WORDS)) == [["limits", "policy"]]


def test_coverage_and_confidence(spark):
    rows = [(["a", "b"], ["a"]), ([], ["a"]), (["g"], ["a"])]
    assert values(spark, rows, "x array<string>, y array<string>", tx.coverage(F.col("x"), F.col("y"), F.array(F.lit("g")))) == [0.5, 0.0, 0.7]
    assert values(spark, [(0.99, 0.5, 77, 1), (5.0, 5.0, 100, 1), (1.0, 1.0, 100, 0)], "r double, c double, l int, n int", rules.confidence(F.col("r"), F.col("c"), F.col("l"), F.col("n"))) == [72, 100, 0]


def test_phonetic_variant(spark):
    names = ["Ashcraft", "Tymczak", "Robert", "Rupert", "", "123", "Pfister", "A"]
    assert values(spark, [(n,) for n in names], "n string", tx.phonetic(F.col("n"))) == ["A226", "T252", "R163", "R163", "0000", "0000", "P236", "A000"]


def test_redaction_is_idempotent(spark):
    text = "a@b.org 123-45-6789 987654321 (212) 555-0123 4/17/1990 1990-04-17 4111 1111 1111 1111 ok 12"
    (once,) = values(spark, [(text,)], "t string", tx.redact("t", lists.PII))
    assert once.count("-REDACTED]") == 7 and "ok 12" in once
    assert values(spark, [(once,)], "t string", tx.redact("t", lists.PII)) == [once]


def test_names_in_tiers(spark):
    assert values(spark, [("  Walnut  Creek HOA",), ("Walnut Creek Community Association,",), ("Walnut Creek",)], "n string", rules.without_suffix(F.col("n"))) == ["walnut creek"] * 3
    assert values(spark, [("Smith", "Smyth")], "a string, b string", rules.sound_likeness(F.col("a"), F.col("b"))) == [0.5]  # S530, S523


def test_routes(spark):
    rows = [(0, 3), (1, 3), (2, 3), (3, 3), (1, 1)]
    assert [round(x, 6) for x in values(spark, rows, "m int, n int", rules.trigger_confidence(F.col("m"), F.col("n")))] == [0, 0.7, 0.85, 1.0, 0.7]
    assert values(spark, [(0.6,), (0.59,), (0.4,), (0.39,)], "c double", rules.route(F.col("c"))) == ["SQL", "REVIEW", "REVIEW", "RAG"]
    assert values(spark, [(90, False)], "o int, c boolean", rules.action(F.col("o"), F.col("c")))[0].asDict() == {"confidence": 50, "action": "CITE"}


def test_scores_are_cleaned(spark):
    rows = [(None,), (float("nan"),), (float("inf"),), (-0.05,), (-0.06,), (1.05,), (1.06,), (0.5,)]
    assert values(spark, rows, "x double", rules.sanitize_score(F.col("x"))) == [None, None, None, 0.0, None, 1.0, None, 0.5]


def test_dates_and_years(spark):
    rows = [("1/2/2024",), ("01/02/24",), ("2024-1-2",), ("2 Jan",), ("13/40/2024",), (None,)]
    assert [str(x) for x in values(spark, rows, "t string", tx.parse_date(F.col("t")))] == ["2024-01-02"] * 3 + ["None"] * 3
    assert values(spark, [("24",), ("5",), ("124",), ("x",)], "t string", rules.year_range(F.col("t"))) == ["2024-2025", "2005-2006", None, None]


def test_slugs_and_html(spark):
    assert values(spark, [("  A__b C!-",)], "t string", tx.slug("t")) == ["a-b-c"]
    page = "<p>a<script>x<b>y</script></p>\n<style>z</style><i>b</i>"
    assert values(spark, [(page,)], "t string", tx.html_text("t")) == ["a b"]
    assert files.dom_text(page) == "a\nb"


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0, 5.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [-1.0, -1.0])]
    got = values(spark, rows, "a array<float>, b array<float>", cosine("a", "b"))
    assert got[0] == pytest.approx(1 / 26**0.5) and got[1:] == [0.0, pytest.approx(-1)]


def test_fusion_and_min_max(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, d int, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "query_id int, d int, rank int")
    assert {r.d: r.score for r in ret.fuse(a, b, "d").collect()} == {10: round(1 / 61, 8), 11: round(1 / 62 + 1 / 61, 8)}
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 3.0), (2, 7.0)], "q int, s double")
    assert sorted(r[0] for r in rows.select(ret.min_max("s", "q")).collect()) == [0.0, 0.5, 1.0, 1.0]


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(i, "common words here") for i in range(9)] + [(9, "common rare words")], "id int, text string")
    asked = spark.createDataFrame([(1, ["rare", "common"])], "query_id int, terms array<string>")
    got = ret.top_k(ret.bm25(docs, asked, "id", "text"), "query_id", "score", "id", 3).orderBy("rank").collect()
    assert [r.id for r in got] == [9, 0, 1]


def test_greedy_operators(spark):
    rows = spark.createDataFrame([("g", 1, 60), ("g", 2, 50), ("g", 3, 40), ("g", 4, 1)], "g string, k long, c int")
    assert sorted(r.k for r in win.fit_and_skip(rows, "g", F.col("k"), "k", "c", 100, 15).collect()) == [1, 3]
    assert sorted(r.k for r in win.within_budget(rows, ["g"], [F.col("k")], "c", 110).collect()) == [1, 2]
    texts = spark.createDataFrame([("g", 1, ["a", "b"]), ("g", 2, ["a", "b"]), ("g", 3, ["a", "c"]), ("g", 4, []), ("g", 5, [])], "g string, t long, w array<string>")
    assert sorted(r.t for r in win.greedy_distinct(texts.withColumn("o", F.col("t")), "g", ["o"], "t", "w", 0.9).collect()) == [1, 3, 4, 5]


def test_samples_of_nine(spark):
    rows = spark.createDataFrame([("a", i) for i in range(20)] + [("b", i) for i in range(9)], "g string, k int")
    got = [(r.g, r.k) for r in win.spread_sample(rows, "g", "k").collect()]
    assert sorted(k for g, k in got if g == "a") == [0, 1, 2, 9, 10, 11, 17, 18, 19] and len([1 for g, _ in got if g == "b"]) == 9


def test_percentiles_by_index(spark):
    rows = spark.createDataFrame([("g", float(i)) for i in range(10)], "g string, v double")
    (r,) = agg.index_percentiles(rows, "g", "v", {"p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()
    assert (r.p50, r.p95, r.p100) == (5.0, 9.0, 9.0)


def test_totals_leave_years_out(spark):
    rows = spark.createDataFrame([("1", "$1,200", "1999", "x"), ("2", "3.5", "2020", "y")], "k string, a string, year string, t string")
    assert [(r.name, r.total) for r in agg.numeric_totals(rows, "k", ["a", "year", "t"]).collect()] == [("a", 1203.5)]


def test_reconcile_and_keywords(spark):
    a = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "id int, n int")
    b = spark.createDataFrame([(2, 2), (3, 1), (4, 1)], "id int, m int")
    assert {r.id: r.issue for r in jn.reconcile(a, b, "id", "n", "m").collect()} == {1: "ghost_doc", 2: None, 3: "chunk_count_mismatch", 4: "orphan_vectors"}
    asked = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"])], "q int, tokens array<string>")
    entries = spark.createDataFrame([(7, ["a", "b"]), (8, ["a"]), (9, ["z"])], "e int, tokens array<string>")
    assert sorted(tuple(r) for r in jn.keyword_lookup(asked, entries, "q", "e").collect()) == [(1, 7), (1, 8), (2, 8)]


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert sorted(tuple(r) for r in mut.upsert(old, new, ["k"], [F.desc("v")]).collect()) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(tuple(r) for r in mut.replace_where(old, new, "k").collect()) == [(1, "a"), (2, "x"), (2, "y"), (3, "z")]
    (key,) = values(spark, [(None, "p")], "a string, b string", st.idempotency_key(F.col("a"), F.col("b")))
    import hashlib

    assert key == hashlib.sha256(b":p").hexdigest()


def test_uuid5(spark):
    import uuid

    names = ["doc:1", "é", ""]
    assert values(spark, [(n,) for n in names], "n string", ids.uuid5(str(uuid.NAMESPACE_DNS), F.col("n"))) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


@pytest.mark.parametrize("size", [5, 17, 100])
def test_recursive_chunks_hold_all_words(size):
    text = "One two three. Four five\nsix seven\n\neight nine ten eleventwelvethirteen " * 5
    chunks = ch.split_text(text, size, size // 4)
    assert all(0 < len(c) <= size for c in chunks)
    if size > 20:
        assert set(text.split()) <= {w for c in chunks for w in c.replace(".", ". ").split()} | {w + "." for c in chunks for w in c.split()}
    assert ch.split_text("  ", 5, 1) == [] and ch.split_text("abc", 5, 1) == ["abc"]


def test_lines_are_packed_whole(spark):
    rows = [("aa\nbb\ncccccc\nd",), ("",), (None,)]
    assert values(spark, rows, "t string", ch.line_pack(F.col("t"), 5)) == [["aa\nbb", "cccccc", "d"], [""], None]


def test_guards():
    sql.validate("SELECT 1 LIMIT 1")
    for bad in ("DELETE FROM x LIMIT 1", "SELECT 1; DROP TABLE x LIMIT 1", "SELECT 1", "SELECT {x} LIMIT 1", "SELECT %s LIMIT 1"):
        with pytest.raises(ValueError):
            sql.validate(bad)


def test_registry_and_stand_ins():
    registry = backends.Registry()
    registry.register("embedder", "hash", backends.hashed_vectors)
    with pytest.raises(ValueError):
        registry.register("embedder", "hash", backends.hashed_vectors)
    with pytest.raises(KeyError):
        registry.create("embedder", "none")
    a, b, c = registry.create("embedder", "hash", dim=16)(["a b", "b a", ""])
    assert a == b and sum(x * x for x in a) == pytest.approx(1) and sum(x * x for x in c) == pytest.approx(1)
    assert backends.first_sentence()(["who signed it"], ["It rained. Ann signed it. Yes."]) == ["Ann signed it."]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id;name\n1;x\n2;y\n")
    assert [tuple(r) for r in files.delimited(spark, str(tmp_path / "a.csv")).select("name").collect()] == [("x",), ("y",)]
    assert files.sniff(["a", "b"]) is None and files.sniff(["a\tb"]) == "\t"
    (tmp_path / "m.eml").write_bytes(b"Subject: Hi\nFrom: a@b.org\nContent-Type: text/html\n\n<p>Hello <b>you</b></p><script>x</script>")
    (tmp_path / "n.eml").write_bytes(b"\xff\xfe")
    found = {r.path[-5:]: (r.text, r.error) for r in files.parsed_files(spark, str(tmp_path / "*.eml"), files.email_text).collect()}
    assert found["m.eml"] == ("Subject: Hi\nFrom: a@b.org\nHello\nyou", None)
    (tmp_path / "bad.txt").write_bytes(b"ok \xff")
    assert files.text_files(spark, str(tmp_path / "bad.txt")).first().text == "ok �"
    def broken(content):
        raise RuntimeError("no")

    assert {r.error for r in files.parsed_files(spark, str(tmp_path / "*.eml"), broken).collect()} == {"RuntimeError: no"}


def test_names_are_cut_and_numbered(spark):
    df = spark.createDataFrame([(1, "abcdefgh1"), (2, "abcdefgh2"), (3, "b")], "k int, n string")
    assert [r.short for r in ch.shortened(df, "n", "k", 8).orderBy("k").collect()] == ["abcdefgh", "abcdef_1", "b"]


def test_lexical_asks_for_all_tokens(spark):
    import math
    from types import SimpleNamespace

    from tessera.plans import retrieval

    docs = {1: "zz yy zz", 2: "aa bb", 3: "cc dd ee xx", 4: "none here"}
    item = "zz yy xx aa bb cc dd ee"
    t = SimpleNamespace(benchmark=spark.createDataFrame([(0, item)], "item_id long, text string"), documents=spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    words = {k: v.split() for k, v in docs.items()}
    mean, n, want = sum(map(len, words.values())) / len(docs), len(docs), {}
    for k, w in words.items():
        for term in set(w) & set(item.split()):
            df, tf = sum(term in x for x in words.values()), w.count(term)
            want[k] = want.get(k, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    got = {r.doc_id: r.score for r in retrieval.lexical(t).collect()}
    assert got == pytest.approx(want, abs=1e-5) and set(got) == {1, 2, 3}


def test_messages_are_read_with_all_their_fields(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(
        b"From: Ann <Ann@X.org>\r\nTo: b@y.org, C <c@y.org>\r\nCc: d@z.org\r\nSubject: Renewal\r\nDate: Mon, 01 Jan 2024 10:00:00 +0200\r\nMIME-Version: 1.0\r\n"
        b'Content-Type: multipart/mixed; boundary="q"\r\n\r\n--q\r\nContent-Type: text/html\r\n\r\n<p>Hello <b>you</b></p>\r\n--q\r\n'
        b'Content-Type: application/pdf\r\nContent-Disposition: attachment; filename="quote.pdf"\r\n\r\nxx\r\n--q--\r\n'
    )
    (tmp_path / "b.eml").write_bytes(b"Subject: bare\r\nDate: never\r\n\r\nbody")
    got = {r.path[-5:]: r for r in files.email_rows(spark, str(tmp_path / "*.eml")).collect()}
    a, b = got["a.eml"], got["b.eml"]
    assert (a.sender, a.recipients, a.date, a.attachments, a.error) == ("ann@x.org", ["b@y.org", "c@y.org", "d@z.org"], "2024-01-01T08:00:00", ["quote.pdf"], None)
    assert "Hello" in a.body and "<b>" not in a.body
    assert (b.subject, b.sender, b.recipients, b.date, b.attachments, b.body) == ("bare", "", [], None, [], "body")


def test_a_model_that_cant_be_reached_is_asked_again(spark):
    from tessera.functions import enrichment

    rows = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "id long, prompt string").coalesce(1)
    calls = {"n": 0}

    def sometimes(prompts):
        calls["n"] += 1
        if calls["n"] < 3:
            raise ConnectionError("down")
        return [p.upper() for p in prompts]

    def never(prompts):
        raise TimeoutError("slow")

    assert sorted(r.answer for r in enrichment.prompted(rows, ["id"], "prompt", sometimes, wait=0.01).collect()) == [f"P{i}" for i in range(5)]
    assert {(r.answer, r.error) for r in enrichment.prompted(rows, ["id"], "prompt", never, wait=0.01).collect()} == {(None, "TimeoutError: slow")}
    answers = spark.createDataFrame([('{"a": 1}',), ("```json\n{\"a\": 2}\n```",), ('so: {"a": 3} ok',), ("none",), (None,)], "answer string")
    assert [r.p and r.p.a for r in answers.select(enrichment.parsed(F.col("answer"), "a int").alias("p")).collect()] == [1, 2, 3, None, None]
