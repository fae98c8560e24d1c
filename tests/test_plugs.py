"""Chunkers by name, chunks below headings, JSON pages as a data source, rules as a table."""

import datetime
import decimal
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import chunkers, config
from tessera.operators import structure, tagging
from tessera.sources import connectors, pages

TEXT = "One two. Three four five.\n\nSix\nseven eight nine ten eleven twelve thirteen. " + "x" * 40 + "\n\n\n last "


def call(spark, more, text="d.text"):
    return [tuple(r) for r in spark.sql(f"SELECT d.doc_id, c.* FROM texts d, LATERAL chunks({text}{more}) c ORDER BY 1, 2").collect()]


def test_chunkers_by_name(spark):
    spark.createDataFrame([(1, TEXT, 3), (2, None, 1), (3, "", 2), (4, "a b", 1), (5, " \n ", 1)], "doc_id long, text string, n int").createOrReplaceTempView("texts")
    shout = chunkers.Chunker(lambda text, size, overlap: iter([(text.upper(),)] if text else []), 1, 0)
    chunkers.register(spark, {"chunker": "recursive", "size": 20, "overlap": 4}, {"shout": shout})
    found = call(spark, "")
    assert all(len(r[2]) <= 20 and r[3] == len(r[2]) for r in found) and {r[0] for r in found} == {1, 4}
    assert re.sub(r"\s", "", found[0][2]) and [r[1] for r in found if r[0] == 1] == list(range(sum(r[0] == 1 for r in found)))
    windows = call(spark, ", chunker => 'sliding', size => d.n, overlap => 1")  # a size of its own for each text
    words = TEXT.split()
    assert [r[2:] for r in windows if r[0] == 1] == [(" ".join(words[i : i + 3]), i, len(words[i : i + 3])) for i in range(0, len(words) - 1, 2)]
    assert [r[1:] for r in windows if r[0] == 4] == [(0, "a", 0, 1), (1, "b", 1, 1)]
    lines = call(spark, ", chunker => 'lines', size => 30")
    assert "\n".join(r[2] for r in lines if r[0] == 1) == TEXT and [r[3:] for r in lines if r[0] == 5] == [(0, 2)]
    assert call(spark, ", chunker => 'shout'", "'a'") == [(i, 0, "A") for i in range(1, 6)]
    assert call(spark, ", chunker => NULL, size => NULL") == found
    for wrong in (", chunker => 'none'", ", chunker => d.text"):
        with pytest.raises(Exception, match="no chunker named|constant"):
            call(spark, wrong)
    chunkers.register(spark)
    with pytest.raises(Exception, match="no chunker named None"):
        call(spark, "")


def plain_chunks(blocks, limit):
    stack, out, held = [], [], []

    def close():
        if held:
            titles = [t for _, t in stack]
            out.append((" > ".join(titles) or None, titles[-1] if titles else None, "\n".join(held)))
            held.clear()

    n = 0
    for level, text in blocks:
        if level:
            close()
            stack = [x for x in stack if x[0] < level] + [(level, text)]
            continue
        words = text.split(" ")
        for i in range(0, len(words), limit):
            part = words[i : i + limit]
            if held and n + len(part) > limit:
                close()
            n = n + len(part) if held else len(part)
            held.append(" ".join(part))
    close()
    return out


def test_chunks_below_headings(spark):
    html = """before<title>no</title><nav><h1>no</h1></nav><!-- <h1>no</h1> --><script>var a="<p>no</p>"</script><H1 class=x>A &amp; <b>B</b></H1><p>one two<p>three<br>four
        <h3>C</h3>five<h2>D</h2><ul><li>six</li><li>seven eight nine ten eleven</li></ul><h3>E</h3><h1>F</h1><div><div>  g\th&nbsp;&lt;i&gt; </div></div>"""
    rng = random.Random(5)
    signs = ["<h1>x</h1>", "<h2>y z</h2>", "<h4>q</h4>", "<p>", "</p>", "w ", "w w w ", "<b>", "<br>", "\n"]
    htmls = [html, None, "", "plain", "<h1>only</h1>", *["".join(rng.choices(signs, k=40)) for _ in range(60)]]
    rows = spark.createDataFrame(list(enumerate(htmls)), "i int, html string").withColumn("e", structure.elements(F.col("html"))).select("i", "e", structure.chunks(F.col("e"), 4).alias("c")).orderBy("i").collect()
    assert [tuple(x) for x in rows[0].e] == [(0, "before"), (1, "A & B"), (0, "one two"), (0, "three"), (0, "four"), (3, "C"), (0, "five"), (2, "D"), (0, "six"), (0, "seven eight nine ten eleven"), (3, "E"), (1, "F"), (0, "g h <i>")]
    assert [tuple(x) for x in rows[0].c][:4] == [(None, None, "before"), ("A & B", "A & B", "one two\nthree\nfour"), ("A & B > C", "C", "five"), ("A & B > D", "D", "six")]
    for r in rows:
        assert [tuple(x) for x in r.c] == plain_chunks([tuple(x) for x in r.e], 4)


def test_pages_keep_what_was_written(spark, tmp_path):
    folder = str(tmp_path / "pages")
    systems = connectors.Connectors(spark)
    systems.register("pages", pages.JsonPages)
    systems.register("null", pages.Nothing)
    with pytest.raises(TypeError):
        systems.register("bad", object)
    assert systems.names() == ["null", "pages"]
    row = (1, "é\n\"", None, 1.5, decimal.Decimal("1.10"), datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5, 6), ["a", None], True)
    schema = "id long, tenant string, gone int, x double, money decimal(10,2), day date, at timestamp_ntz, tags array<string>, flag boolean"
    rows = spark.createDataFrame([row, (2, None, 3, float("nan"), None, None, None, None, None), *[(i, "t", i, float("inf"), None, None, None, [], False) for i in range(3, 60)]], schema)
    systems.push("pages", rows.repartition(3), path=folder, tenant_column="tenant", page_rows="10")
    back = systems.pull("pages", path=folder)
    assert back.schema.simpleString() == rows.schema.simpleString()
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))
    assert {r.id for r in systems.pull("pages", path=folder, tenant="t").collect()} == set(range(3, 60))
    assert systems.pull("pages", path=folder, tenant="t,é\n\"").count() == 58 and systems.pull("pages", path=folder, tenant="none").count() == 0
    systems.push("pages", rows.limit(1), path=folder)
    assert systems.pull("pages", path=folder).count() == 60
    with pytest.raises(Exception, match="other columns"):
        systems.push("pages", rows.select("id"), path=folder)
    assert systems.pull("pages", path=folder).count() == 60
    systems.push("pages", rows.select("id"), "overwrite", path=folder)
    assert systems.pull("pages", path=folder).columns == ["id"] and sum(x.startswith("job-") for x in os.listdir(folder)) == 1
    systems.push("pages", rows.select("id").limit(0), "overwrite", path=folder)
    assert systems.pull("pages", path=folder).count() == 0
    systems.push("null", rows)
    assert systems.pull("null").collect() == []
    with pytest.raises(Exception, match="holds no pages"):
        systems.pull("pages", path=str(tmp_path / "nothing")).collect()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "pages")
    systems = connectors.Connectors(spark)
    systems.register("pages", pages.JsonPages)
    systems.push("pages", spark.range(5), path=folder)
    listed = sorted(os.listdir(folder))
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        systems.push("pages", broken, path=folder, page_rows="2")
    assert sorted(os.listdir(folder)) == listed and systems.pull("pages", path=folder).count() == 5
    with open(f"{folder}/{pages.MANIFEST}") as f:
        name = json.load(f)["pages"][0]["name"]
    with open(f"{folder}/{name}", "w") as f:
        json.dump({"seq": 0, "tenant": None, "rows": []}, f)
    with pytest.raises(Exception, match="has 0 rows"):
        systems.pull("pages", path=folder).collect()


def test_ten_thousand_rules(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)] + ["Ärger", "straße"]
    rules = [(i, "keyword", rng.choice(["topic", "entity"]), f"v{i}", None, None, None, None, None, None, [" ".join(rng.choices(words, k=2)) for _ in range(rng.randrange(3))], rng.choices(words, k=rng.randrange(3)), rng.random() < 0.3, rng.randrange(1, 9)) for i in range(10_000)]
    texts = [None, "", "  ", *[" ".join(rng.choice([w, w.upper()]) for w in rng.choices(words, k=rng.randrange(1, 120))) for _ in range(40)]]
    table = spark.createDataFrame(rules, tagging.RULES)
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, value int")
    wanted = set()
    for i, x in enumerate(texts):
        for namespace in ("topic", "entity"):
            for r in sorted((r for r in rules if r[2] == namespace and x and (r[10] or r[11])), key=lambda r: (-r[13], r[0])):
                hay = tagging.plain(x, r[12])
                if all(tagging.plain(w, r[12]) in hay for w in r[11]) and (not r[10] or any(tagging.plain(w, r[12]) in hay for w in r[10])):
                    wanted.add((i, namespace, r[3], r[0]))
                    break
    assert {tuple(r) for r in tagging.keyword_tags(docs, "doc_id", "text", table).collect()} == wanted and len(wanted) > 40
    monkeypatch.setattr(tagging, "PHRASES", 5_000)
    assert {tuple(r) for r in tagging.keyword_tags(docs, "doc_id", "text", table).collect()} == wanted
    assert tagging.keyword_tags(docs, "doc_id", "text", table.limit(0)).collect() == []


def test_paths_mail_and_types(spark):
    strategy = config.Strategy.load(json.dumps({
        "namespaces": ["client", "year", "stage", "topic"], "path_offset": 1, "document_types": ["policy", "unknown"],
        "path_rules": [
            {"namespace": "client", "level": 0, "pattern": r"^(.+?)(?:\s*\(.*\))?$", "transform": "slugify"}, {"namespace": "year", "level": 1, "pattern": r"(\d{2})\s+(?:NB|Renewal)$"},
            {"namespace": "stage", "level": 2, "mapping": {"Bind": "bind", "Sub": "submission"}, "parent": "24"}, {"namespace": "topic", "level": 0, "mapping": {"Acme": "a"}, "parent": "x"}, {"namespace": "stage", "level": 3, "transform": "lowercase"},
        ],
        "email_patterns": [{"pattern": "(?i)renew", "tags": [{"namespace": "topic", "value": "r"}, {"namespace": "stage", "value": "s"}]}, {"pattern": "al$", "tags": [{"namespace": "topic", "value": "r"}]}],
    }))
    rules = strategy.rules(spark)
    paths = [(1, "/Root/Acme Co (old)/24 NB/Bind/a.pdf"), (2, r"Root\Acme\23 NB\Bind\DEEP\x.txt"), (3, ""), (4, None), (5, "Root"), (6, "Root/Acme/24 Renewal/Sub"), (6, "Root/Acme/24 Renewal/Sub"), (7, "a.txt")]
    got = sorted((r.id, f"{r.namespace}:{r.value}") for r in tagging.path_tags(spark.createDataFrame([(*p, 0) for p in paths], "id int, path string, level int"), "id", "path", rules, strategy.path_offset).collect())
    assert got == sorted([(1, "client:acme-co"), (1, "year:24"), (1, "stage:bind"), (2, "client:acme"), (2, "year:23"), (2, "stage:deep"), *[(6, "client:acme"), (6, "year:24"), (6, "stage:submission")] * 2])
    mails = spark.createDataFrame([(1, "RENEWal"), (2, "final"), (3, None), (4, "other"), (4, "other")], "id int, subject string")
    assert sorted((r.id, r.namespace, r.value) for r in tagging.email_tags(mails, "id", "subject", rules).collect()) == [(1, "stage", "s"), (1, "topic", "r"), (2, "topic", "r")]
    said = spark.createDataFrame([(" Policy",), ("letter",), (None,)], "said string")
    assert [r[0] for r in said.select(tagging.document_type(F.col("said"), list(strategy.document_types))).collect()] == ["policy", "unknown", "unknown"]
    for wrong in ({"keyword_rules": [{"namespace": "topic", "value": "a", "any_of": ["x"], "priority": 0}]}, {"keyword_rules": [{"namespace": "topic", "value": "a"}]}, {"keyword_rules": [{"namespace": "client", "value": "a", "any_of": ["x"]}]}, {"document_types": ["policy"]}, {"namespaces": ["Client"]}, {"path_rules": [{"namespace": "client", "level": -1}]}):
        with pytest.raises(ValueError):
            config.Strategy.load(json.dumps({"namespaces": ["client", "topic"]} | wrong))
