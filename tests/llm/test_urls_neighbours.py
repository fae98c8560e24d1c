import random

import numpy as np
import pytest

from tessera.llm import neighbours, urls


def by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [k for k in (rest.find(c) for c in "/?#") if k >= 0]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    ends = [k for k in (rest.find(c) for c in "?#") if k >= 0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return host, rest[: min(ends)] if ends else rest


def rule_by_hand(host, path):
    best = None
    for verdict, rule in urls.RULES:
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


URLS = [
    "http://A.Example.COM/en/7x", "https://example.com/en/8", "http://x.example.net/de/81?q#f", "http://net/de/", "ftp://ÀB.org/es/1", "http://example.org?x=/es/", "no scheme", None, "", "http://",
    "a://b://c/en/1", "http://badexample.com/en/7", "http://h.test/a/b/c/d/e/f/g/h/1", "http://h.test//x//", "http://h.test/é/\n/5",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "t") for i, u in enumerate([*URLS, *URLS])] + [(None, URLS[0], "x", "t")], "page_id long, url string, host string, template string")
    got = urls.judge(pages, spark.createDataFrame([], "page_id long, good int")).collect()
    assert len(got) == 2 * len(URLS) + 1
    for r in got:
        host, path = by_hand(URLS[0 if r.page_id is None else r.page_id % len(URLS)])
        fits = rule_by_hand(host, path)
        assert (r.host, r.path, r.rule) == (host, path, fits and fits[1])
        assert r.verdict == (fits[0] if fits else "allow")


def test_templates_with_bad_labels_are_rejected(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'bad'}.test/p{i}/item-{i}") for i in range(400)] + [(1000 + i, f"http://bad.test/about/{i}") for i in range(100)]
    labels = [(i, i % 2) for i in range(0, 400, 3)] + [(1000 + i, 1) for i in range(0, 100, 2)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int")).collect()
    assert {(r.host, r.path.startswith("/about"), r.verdict) for r in got} == {("good.test", False, "allow"), ("bad.test", False, "block"), ("bad.test", True, "allow")}


def test_many_segments_become_a_wildcard(spark):
    rows = [(i, f"http://h.test/user/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}/post") for i in range(100)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(1, 1)], "page_id long, good int"))
    assert got.select("template").distinct().count() == 1


def templates_by_hand(counts):
    """{(host, shape): (template, purity)} of {(host, shape): (n, labelled, good)}, level by level."""
    place, up = {k: "" for k in counts}, {k: "" for k in counts}
    for level in range(1, max(len(s) for _, s in counts) + 1):
        seen = {}
        for (host, shape), c in counts.items():
            if len(shape) >= level:
                own = seen.setdefault((host, place[host, shape]), {}).setdefault(shape[level - 1], [0, 0, 0])
                own[:] = [x + y for x, y in zip(own, c)]
        step = {}
        for at, below in seen.items():
            pages = sum(c[0] for c in below.values())
            if (len(below) > urls.CHILDREN and len(below) > urls.SPREAD * pages) or len(below) > urls.MANY:
                step |= {(at, s): "*" for s in below}
                continue
            groups, before = [], None
            for s, (_, n, g) in sorted(((s, c) for s, c in below.items() if c[1]), key=lambda x: (x[1][2] / x[1][1], x[0])):
                z = 0
                if before and 0 < (p := (g + before[1]) / (n + before[0])) < 1:
                    z = (g / n - before[1] / before[0]) / (p * (1 - p) * (1 / n + 1 / before[0])) ** 0.5
                if before is None or z >= urls.Z:
                    groups.append([])
                groups[-1].append(s)
                before = (n, g)
            for group in [*groups, [s for s, c in below.items() if not c[1]]]:
                step |= {(at, s): min(group) + "~" * (len(group) > 1) for s in group}
        for key in counts:
            if len(key[1]) >= level:
                up[key] = place[key]
                place[key] += "/" + step[(key[0], up[key]), key[1][level - 1]]
    def total(keys):
        return [sum(counts[k][i] for k in keys) for i in (1, 2)]
    def smooth(keys, prior):
        n, g = total(keys)
        return (g + urls.WEIGHT * prior) / (n + urls.WEIGHT)
    n, g = total(counts)
    out = {}
    for key in counts:
        hosts = [k for k in counts if k[0] == key[0]]
        ups = [k for k in hosts if up[k] == up[key]]
        leaf = [k for k in ups if place[k] == place[key]]
        out[key] = place[key], smooth(leaf, smooth(ups, smooth(hosts, (g + 1) / (n + 2))))
    return out


def test_templates_are_those_of_the_tree_by_hand(spark):
    random.seed(5)
    counts = {}
    for _ in range(600):
        host, depth = random.choice("hijk"), random.choice([0, 1, 2, 3, 12])
        shape = tuple(random.choice("abcdef") + random.choice(["", "", str(random.randint(0, 40) if host == "k" else "")]) for _ in range(depth))
        n = random.randint(1, 30)
        labelled = random.choice([0, 0, random.randint(0, n)])
        good = labelled if shape[:1] == ("a",) else sum(random.random() < (0.1 if "c" in shape else 0.8) for _ in range(labelled))
        counts[host, shape] = (n, labelled, good)
    rows = [(h, list(s), *c) for (h, s), c in counts.items()]
    got = urls.templates(spark.createDataFrame(rows, "host string, shape array<string>, n long, labelled long, good long")).collect()
    expected = templates_by_hand(counts)
    assert len(got) == len(expected)
    for r in got:
        template, purity = expected[r.host, tuple(r.shape)]
        assert r.template == template and abs(r.purity - purity) < 1e-12


def test_deep_paths_are_judged_to_their_ends(spark):
    deep = "http://h.test/" + "/".join("abcdefghijk")
    rows = [(i, f"{deep}/{'good' if i % 2 else 'bad'}/{i}") for i in range(200)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(i, i % 2) for i in range(100)], "page_id long, good int")).collect()
    assert {(r.page_id % 2, r.verdict) for r in got} == {(1, "allow"), (0, "block")}


def test_depth_takes_no_rounds(spark, monkeypatch):
    deep = "/".join(f"s{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(2000))
    paths = ["h/a/b", "h/a/c", "h/a", f"h/{deep}", f"i/{deep}", f"i/{deep}/x", f"i/{deep}/y/z", "i"]
    rounds = []
    own = urls.along_chains
    monkeypatch.setattr(urls, "along_chains", lambda tree: rounds.append(1) or own(tree))
    pages = spark.createDataFrame([(i, f"http://{p}") for i, p in enumerate(paths)], "page_id long, url string")
    got = {r.page_id: r.template for r in urls.judge(pages, spark.createDataFrame([(0, 1), (2, 0), (6, 0)], "page_id long, good int")).collect()}
    assert len(rounds) <= 4 and len(got) == len(paths)
    assert got[3].endswith(deep.split("/", 1)[1]) and got[4] == f"/{deep}" and got[7] == ""


def test_rules_label_the_pages_that_they_fit(spark):
    rows = [(i, f"http://x.com/en/{i}") for i in range(30)] + [(100 + i, f"http://x.com/en{i % 2}/a") for i in range(10)] + [(200, "http://y.test/a"), (200, "http://y.test/a")]
    rows += [(300 + i, f"http://example.net/d{k}/{i}") for i, k in enumerate("abcdefghijklmnopqrstuvwxyz")] + [(400 + i, f"http://example.net/de/8{i}") for i in range(9)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows) and {(r.host, r.rule, r.verdict) for r in got} == {("x.com", "com/en/", "block"), ("x.com", None, "allow"), ("y.test", None, "allow"), ("example.net", "example.net/de/8", "block"), ("example.net", "net/de/", "allow"), ("example.net", None, "block")}


def test_no_pages(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, good int")).count() == 0


def brute(rows, query, k=10):
    (q,) = [v for i, v in rows if i == query]
    found = sorted((float(np.sqrt(((np.float32(v).astype(float) - np.float32(q).astype(float)) ** 2).sum())), i) for i, v in rows if i != query)
    return [i for _, i in found[:k]], [s for s, _ in found[:k]]


@pytest.mark.parametrize("part_rows", [10_000, 100])
def test_recall_ties_and_copies(spark, part_rows):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 8)) * 3
    rows = [(i, (centres[i % 20] + rng.standard_normal(8)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(300)]  # copies of a query
    bad = [(5000, None), (5100, [0.0] * 8), (5200, [float("nan")] * 8), (5300, [1.0] * 7), (5400, [None] + [1.0] * 7), (5500, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows + bad + [rows[100]]], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in neighbours.search(vectors, vectors.filter("vec_id % 100 = 0"), part_rows=part_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = [i for i, _ in rows if i % 100 == 0]
    assert sorted(got) == asked
    hits = 0
    for q in asked:
        ids, scores = brute(rows, q)
        assert [r for r, _, _ in got[q]] == list(range(1, 11))
        hits += len({i for _, i, _ in got[q]} & set(ids))
        if part_rows == 10_000 or q in (0, 2000):
            assert [i for _, i, _ in got[q]] == ids and np.allclose([s for _, _, s in got[q]], scores, rtol=1e-12)
    assert hits >= 0.9 * 10 * len(asked)


def rows_made(plan):
    """The rows out of each Python step of an executed plan."""
    name, below = plan.nodeName(), plan.children()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [below.apply(i) for i in range(below.size())]
    own = [plan.metrics().apply("pythonNumRowsReceived").value()] if plan.metrics().contains("pythonNumRowsReceived") else []
    return own + [n for p in inner for n in rows_made(p)]


def test_rows_made_grow_with_the_queries_not_with_the_parts(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((5000, 24)).tolist())]
    for n in (1000, 5000):  # alike in all directions: most of 64 and of 256 parts are probed
        vectors = spark.createDataFrame(rows[:n], "vec_id long, embedding array<float>")
        found = neighbours.search(vectors, vectors.filter("vec_id % 100 = 0"), part_rows=15)
        assert len(found.collect()) == n // 10
        assert n // 10 <= max(rows_made(found._jdf.queryExecution().executedPlan())) <= n // 100 * 16 * 11


@pytest.mark.parametrize("limits", [{"BLOCK": 7, "ROUND": 8 * 5, "PAIRS": 20}, {"BLOCK": 300, "LANES": 3}])
def test_rounds_and_lanes_lose_nothing(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(neighbours, name, value)
    fit = neighbours.fit
    monkeypatch.setattr(neighbours, "fit", lambda x, parts, recall: (fit(x, parts, recall)[0], parts))  # every part is probed
    rng = np.random.default_rng(8)
    rows = [(i, v) for i, v in enumerate(rng.integers(-2, 3, (900, 8)).astype(float).tolist())]  # many equal distances
    rows = [r for r in rows + [(3000 + i, rows[i % 3 + 1][1]) for i in range(60)] if any(r[1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(vectors, vectors.filter("vec_id % 20 = 0"), part_rows=60).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == [i for i, _ in rows if i % 20 == 0]
    for q, found in got.items():
        assert ([i for i, _ in found], [s for _, s in found]) == brute(rows, q)


def test_distances_that_overflow_when_squared(spark):
    rows = [(100 * i, [1e200 + i * 1e188, 2.0]) for i in range(5)]
    got = neighbours.search(df := spark.createDataFrame(rows, "vec_id long, embedding array<double>"), df.filter("vec_id = 0")).orderBy("rank").collect()
    assert {r.vec_id for r in got} == {100, 200, 300, 400}


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 3.0])], schema)
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(few, few.filter("vec_id = 0")).collect()] == [(0, 1, 3)]
    assert neighbours.search(few.limit(0), few.limit(0)).count() == 0


@pytest.mark.parametrize("width", [16, 64])
def test_few_parts_hold_the_neighbours_of_vectors_that_were_never_seen(width):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((150, width)) * 2
    x = (centres[rng.integers(0, 150, 9000)] + 0.6 * rng.standard_normal((9000, width))).astype(np.float32)
    parts = 64
    model, probes = neighbours.fit(x[: neighbours.SAMPLE], parts)
    order = np.argsort(-neighbours.scores(model, x), axis=1, kind="stable")
    asked = np.arange(neighbours.SAMPLE, len(x), 50)
    near, rank = neighbours.nearest(x, 10, asked), np.argsort(order[asked], axis=1)
    recall = (rank[np.repeat(np.arange(len(asked)), 10), order[near.reshape(-1), 0]] < probes).mean()
    assert recall >= 0.9 and probes <= parts / 5


def test_vectors_of_doubles_stay_doubles(spark):
    rows = [(100 * i, [1.0 + i * 1e-12, 2.0]) for i in range(5)]
    got = neighbours.search(df := spark.createDataFrame(rows, "vec_id long, embedding array<double>"), df.filter("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [100, 200, 300, 400] and all(r.score > 0 for r in got)


def test_long_urls_repeated_rows_and_rules_of_one_length(spark):
    deep = "http://h.test/" + "/".join(f"s{i % 7}" for i in range(20))
    rows = [(i % 3, deep + "x" * 3000) for i in range(6)] + [(9, "http://a.b.test/p/q")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=(("allow", "b.test/p/"), ("block", "b.test/p/q"), ("allow", "test/p/qqq"))).collect()
    assert len(got) == 7 and {(r.rule, r.verdict) for r in got} == {(None, "allow"), ("b.test/p/q", "block")}
