"""URL filters: rules of host and path, and a tree of path templates for what no rule fits.

Templates: numbers in path segments become ``<n>``. Going down a host's tree level by level, a place with very
many different segments, for its number of pages or at all, becomes ``*``. Elsewhere the branches below a place
are put in the order of their shares of good labels, and each that does not differ from the one before
(|z| < Z of a test of two proportions) is merged with it, with all that lies below; branches without labels are
one. A template's purity is its share of good labels, smoothed towards that of the place above, that towards its
host's, and that towards all pages'. A template with a purity below PURITY is rejected. All of it runs on counts
of (host, shape of the path), not on pages, to the end of the deepest path; where a place has one branch only, as far as that goes in one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: A place in the tree is a wildcard if it has more different segments than this, and more than this share of its pages.
CHILDREN, SPREAD = 20, 0.1
#: Or more than this, however many pages: so many branches at most are put in order below one place.
MANY = 1000
WEIGHT, Z, PURITY = 8.0, 2.0, 0.5


def host_path(url: Column) -> tuple[Column, Column]:
    """Host in ASCII lower case and path; both empty for a null or a url without ``://``."""
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """(verdict, rule) of the longest rule that fits, else null. ``rules``: a list written by hand, so a ladder of tests."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def shape(path: Column) -> Column:
    """The path's segments, with their numbers as ``<n>``."""
    return F.filter(F.split(F.regexp_replace(path, "[0-9]+", "<n>"), "/"), lambda x: x != "")


def branches(seen: DataFrame) -> DataFrame:
    """(host, place, s, step) from (host, place, s, n, labelled, good): the name of the branch that segment s leads to, below each place."""
    count = seen.groupBy("host", "place").agg(F.count("*").alias("c"), F.sum("n").alias("pages"))
    wide = ((F.col("c") > CHILDREN) & (F.col("c") > SPREAD * F.col("pages"))) | (F.col("c") > MANY)
    told = seen.join(count, ["host", "place"]).withColumn("wide", wide)
    apart = W.partitionBy("host", "place", F.col("labelled") > 0)  # MANY rows at most
    ordered = apart.orderBy(F.col("good") / F.greatest("labelled", F.lit(1)), "s")
    n, g, m, h = F.col("labelled"), F.col("good"), F.lag("labelled").over(ordered), F.lag("good").over(ordered)
    pooled = (g + h) / (n + m)
    z = (g / n - h / m) / F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    differs = m.isNull() | ((n > 0) & (F.coalesce(F.when((pooled > 0) & (pooled < 1), z), F.lit(0.0)) >= Z))
    fixed = told.filter(~F.col("wide")).withColumn("new", F.when(differs, 1).otherwise(0)).withColumn("group", F.sum("new").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    same = W.partitionBy("host", "place", F.col("labelled") > 0, "group")
    name = F.concat(F.min("s").over(same), F.when(F.count("*").over(same) > 1, "~").otherwise(""))
    return fixed.select("host", "place", "s", name.alias("step")).unionByName(told.filter("wide").select("host", "place", "s", F.lit("*").alias("step")))


def along_chains(tree: DataFrame) -> DataFrame:
    """The tree with all rows moved on to where their place branches or a path ends: as far as the first and the last path below a place agree."""
    rest = F.slice("shape", F.col("at") + 1, F.size("shape"))
    ends = tree.filter(F.size("shape") > F.col("at")).groupBy("host", "place").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"))
    shorter = F.least(F.size("lo"), F.size("hi"))
    apart = F.array_position(F.transform(F.sequence(F.lit(1), shorter), lambda i: F.element_at("lo", i) == F.element_at("hi", i)), False)
    steps = ends.select("host", "place", F.when(apart == 0, shorter).otherwise(apart - 1).cast("int").alias("steps")).filter("steps > 0")
    joined = tree.join(steps, ["host", "place"], "left").withColumn("steps", F.when(F.size("shape") > F.col("at"), F.col("steps")))
    way = lambda n: F.concat("place", F.when(n > 0, F.concat(F.lit("/"), F.array_join(F.slice("shape", F.col("at") + 1, n), "/"))).otherwise(""))
    moved = F.col("steps").isNotNull()
    return joined.select(
        "host", "shape", "n", "labelled", "good", F.when(moved, way(F.col("steps"))).otherwise(F.col("place")).alias("place"),
        F.when(moved, way(F.col("steps") - 1)).otherwise(F.col("up")).alias("up"), F.when(moved, F.col("at") + F.col("steps")).otherwise(F.col("at")).alias("at"),
    )


def templates(counts: DataFrame, prior: float | None = None) -> DataFrame:
    """(host, shape, template, purity, labelled) from (host, shape, n, labelled, good). ``prior``: what hosts are smoothed towards, by default the purity of all pages.

    A round takes each place along its chain of single segments, and then one branch down; there are as many rounds as a path
    has places with several branches, however deep paths are.
    """
    tree = common.written(counts.select("host", "shape", "n", "labelled", "good", F.lit("").alias("place"), F.lit("").alias("up"), F.lit(0).alias("at")), "shapes")
    while tree.filter(F.size("shape") > F.col("at")).limit(1).count():
        tree = common.written(along_chains(tree), "chains")
        live = F.size("shape") > F.col("at")
        here = F.get("shape", F.col("at"))
        seen = tree.filter(live).groupBy("host", "place", here.alias("s")).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
        moved = tree.withColumn("s", here).join(branches(seen), ["host", "place", "s"], "left").withColumn("up", F.when(live, F.col("place")).otherwise(F.col("up")))
        moved = moved.withColumn("place", F.when(live, F.concat("place", F.lit("/"), "step")).otherwise(F.col("place"))).withColumn("at", F.when(live, F.col("at") + 1).otherwise(F.col("at")))
        tree = common.written(moved.drop("s", "step"), "tree")
    leaf = tree.groupBy("host", "up", "place").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    up = leaf.groupBy("host", "up").agg(F.sum("labelled").alias("up_labelled"), F.sum("good").alias("up_good"))
    host = up.groupBy("host").agg(F.sum("up_labelled").alias("host_labelled"), F.sum("up_good").alias("host_good"))
    if prior is None:
        prior = host.agg(F.coalesce((F.sum("host_good") + 1) / (F.sum("host_labelled") + 2), F.lit(1.0))).first()[0]
    smooth = lambda good, n, prior: (good + WEIGHT * prior) / (n + WEIGHT)
    host = host.select("host", smooth(F.col("host_good"), F.col("host_labelled"), F.lit(float(prior))).alias("host_purity"))
    up = up.join(host, "host").select("host", "up", smooth(F.col("up_good"), F.col("up_labelled"), F.col("host_purity")).alias("up_purity"))
    purity = leaf.join(up, ["host", "up"]).select("host", "up", "place", smooth(F.col("good"), F.col("labelled"), F.col("up_purity")).alias("purity"), "labelled")
    return tree.select("host", "shape", "up", "place").join(purity, ["host", "up", "place"]).select("host", "shape", F.col("place").alias("template"), "purity", "labelled")


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each row of (page_id, url, ...).

    ``labels``: (page_id, good), good 1 or 0; a page with several is good if one says so, a null is no label. By
    default the rules label the pages that they fit: allowed is good, blocked is bad; as these are no sample of
    all pages, hosts are then smoothed towards PURITY, and a template is rejected only if it has labelled pages of
    its own. Without any label every template is allowed. A null url, and one without ``://``, has an empty host and path and is judged with the
    others like it. Of rules of one length that fit, the last in order of its text wins. Repeated rows are
    judged alike, one row each; urls of any length and depth are judged whole; other columns are passed over.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("shape", shape(F.col("path"))).withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    if labels is None:
        told = rows.withColumn("good", F.when(F.col("_rule.verdict") == "allow", 1).when(F.col("_rule.verdict") == "block", 0))
    else:
        good = labels.filter("page_id is not null and good in (0, 1)").groupBy("page_id").agg(F.max("good").alias("good"))
        told = rows.join(good, "page_id", "left")
    counts = told.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    judged = rows.join(templates(counts, PURITY if labels is None else None), ["host", "shape"])
    rejected = (F.col("purity") < PURITY) & (F.lit(labels is not None) | (F.col("labelled") > 0))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(rejected, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict. The pages that a rule fits are the labelled ones."""
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url"))
