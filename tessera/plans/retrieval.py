"""Vector, lexical and hybrid retrieval."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import retrieval as ret
from ..functions.text import tokens
from ..functions.vectors import cosine
from ..operators import windows as win
from ..operators.filters import public_or_any
from ..sources.vector_index import VectorIndex
from .registry import query
from .state import scratch

_COS = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6)"


def probes(t):
    """The vectors of the 25 nations' numbers: a fixed list of queries."""
    return t.nation.select(F.col("n_nationkey").alias("vec_id")).join(t.embeddings, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe"))


_PROBES = "(SELECT vec_id AS query_id, embedding FROM embeddings JOIN nation ON vec_id = n_nationkey)"


@query("vec_cosine", f"SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) p")
def vec_cosine(t):
    probe = t.embeddings.filter("vec_id = 1").select(F.col("embedding").alias("probe"))
    return t.embeddings.join(F.broadcast(probe)).select("vec_id", F.round(cosine("embedding", "probe"), 6).alias("score"))


@query("vec_search_dense", f"SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) p WHERE e.label % 2 = 0 AND {_COS} >= 0.1 ORDER BY score DESC, vec_id LIMIT 10")
def vec_search_dense(t):
    """The ten nearest to vector 0 that a user with the tags of even labels may see."""
    tagged = t.embeddings.withColumn("tags", F.array((F.col("label") % 2).cast("string")))
    probe = t.embeddings.filter("vec_id = 0").select(F.lit(0).alias("query_id"), F.col("embedding").alias("probe"))
    return ret.dense(probe, tagged, 10, 0.1, public_or_any(F.col("tags"), ["0"])).select("vec_id", "score")


@query("vec_search_entity_filter", f"SELECT e.vec_id, {_COS} AS score FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) p WHERE d.source = 'src3' ORDER BY score DESC, vec_id LIMIT 5")
def vec_search_entity_filter(t):
    rows = t.embeddings.join(t.documents.select(F.col("doc_id").alias("vec_id"), F.array("lang", "source").alias("tags")), "vec_id")
    probe = t.embeddings.filter("vec_id = 0").select(F.lit(0).alias("query_id"), F.col("embedding").alias("probe"))
    return ret.dense(probe, rows, 5, None, F.array_contains("tags", "src3")).select("vec_id", "score")


@query(
    "vec_search_overfetch_half",
    f"SELECT vec_id, score FROM (SELECT e.vec_id, {_COS} AS score, d.lang FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 2) p WHERE d.lang IN ('en', 'de') ORDER BY score DESC, vec_id LIMIT 20) WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT 10",
)
def vec_search_overfetch_half(t):
    """The embedded store's mode: twice the limit among rows with one of the tags, then the score, then the limit."""
    rows = t.embeddings.join(t.documents.select(F.col("doc_id").alias("vec_id"), F.array("lang", "source").alias("tags")), "vec_id")
    probe = t.embeddings.filter("vec_id = 2").select(F.lit(0).alias("query_id"), F.col("embedding").alias("probe"))
    first = ret.dense(probe, rows, 20, None, F.arrays_overlap("tags", F.array(F.lit("en"), F.lit("de"))))
    return first.filter("score >= 0.2").orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", "score")


@query("topk_vector", f"SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) p WHERE {_COS} >= 0.3 ORDER BY score DESC, vec_id LIMIT 8")
def topk_vector(t):
    probe = t.embeddings.filter("vec_id = 7").select(F.lit(0).alias("query_id"), F.col("embedding").alias("probe"))
    return ret.dense(probe, t.embeddings, 8, 0.3).select("vec_id", "score")


@query("topk_multi_query", f"SELECT query_id, vec_id, score FROM (SELECT query_id, e.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, e.vec_id) AS k FROM embeddings e, {_PROBES} p) WHERE k <= 15")
def topk_multi_query(t):
    return ret.dense(probes(t), t.embeddings, min(3 * 8, 15)).select("query_id", "vec_id", "score")


_TOK = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]{2,}'))"
_BM25 = f"""tk AS (SELECT doc_id, {_TOK} AS toks FROM documents), n AS (SELECT count(*) AS n, avg(len(toks)) AS mean_len FROM tk),
  q AS (SELECT item_id AS query_id, unnest(list_sort(list_distinct({_TOK}))) AS term FROM benchmark), ex AS (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM tk),
  po AS (SELECT term, doc_id, len, count(*) AS tf FROM ex WHERE term IN (SELECT term FROM q) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
  lex AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean_len))), 6) AS score FROM po JOIN dfs USING (term) JOIN q USING (term), n GROUP BY ALL)"""


def lexical(t, k=None):
    """BM25 of all tokens of each benchmark item; with ``k`` at least each item's k best."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), tokens("text").alias("terms"))
    return ret.bm25(t.documents, asked, "doc_id", "text", k=k)


@query("lex_sparse_bm25", f"WITH {_BM25} SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM lex) WHERE k <= 10")
def lex_sparse_bm25(t):
    return ret.top_k(lexical(t, 10), "query_id", "score", "doc_id", 10).select("query_id", "doc_id", "score")


_RRF = f"""WITH {_BM25}, l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM lex),
  d AS (SELECT query_id, e.vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, e.vec_id) AS k FROM embeddings e, (SELECT vec_id AS query_id, embedding FROM embeddings JOIN benchmark ON vec_id = item_id) p),
  f AS (SELECT query_id, doc_id, round(coalesce(1 / (60 + l.k), 0) + coalesce(1 / (60 + d.k), 0), 8) AS score FROM (SELECT * FROM l WHERE k <= 30) l FULL JOIN (SELECT * FROM d WHERE k <= 30) d USING (query_id, doc_id))"""


def hybrid(t, prefetch=30):
    lex = ret.top_k(lexical(t, prefetch), "query_id", "score", "doc_id", prefetch)
    own = t.benchmark.select(F.col("item_id").alias("vec_id")).join(t.embeddings, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe"))
    near = ret.dense(own, t.embeddings, prefetch).withColumnRenamed("vec_id", "doc_id")
    return ret.fuse(lex, near, "doc_id")


@query("hybrid_rrf_fusion", f"{_RRF} SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM f) WHERE k <= 10")
def hybrid_rrf_fusion(t):
    return ret.top_k(hybrid(t), "query_id", "score", "doc_id", 10).select("query_id", "doc_id", "score")


@query("score_minmax_normalize", f"{_RRF} SELECT query_id, doc_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score FROM f WINDOW w AS (PARTITION BY query_id)")
def score_minmax_normalize(t):
    return hybrid(t).withColumn("score", F.round(ret.min_max("score", "query_id"), 6))


@query(
    "hybrid_degraded_paths",
    f"""WITH {_BM25}, l AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM lex WHERE score > 3) WHERE k <= 30),
  d AS (SELECT * FROM (SELECT query_id, e.vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, e.vec_id) AS k FROM embeddings e, {_PROBES} p) WHERE k <= 30),
  f AS (SELECT query_id, doc_id, round(coalesce(1 / (60 + l.k), 0) + coalesce(1 / (60 + d.k), 0), 8) AS score, l.k AS lk, d.k AS dk FROM l FULL JOIN d USING (query_id, doc_id)),
  m AS (SELECT query_id, CASE WHEN count(dk) = 0 THEN 'lexical' WHEN count(lk) = 0 THEN 'dense' ELSE 'hybrid' END AS mode FROM f GROUP BY 1)
  SELECT query_id, doc_id, score, mode FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM f) JOIN m USING (query_id) WHERE k <= 10""",
)
def hybrid_degraded_paths(t):
    """Both lists where a query has hits in both, else the one that it has: without lexical hits the dense list, without a vector the lexical one."""
    lex = ret.top_k(lexical(t, 30).filter("score > 3"), "query_id", "score", "doc_id", 30)
    near = ret.dense(probes(t), t.embeddings, 30).withColumnRenamed("vec_id", "doc_id")
    both, mine = ret.fuse(lex, near, "doc_id", ranks=True).filter("query_id IS NOT NULL"), W.partitionBy("query_id")
    mode = F.when(F.count("rb").over(mine) == 0, "lexical").when(F.count("ra").over(mine) == 0, "dense").otherwise("hybrid")
    return ret.top_k(both.withColumn("mode", mode), "query_id", "score", "doc_id", 10).select("query_id", "doc_id", "score", "mode")


_RANKED = "SELECT o_orderkey, o_custkey, o_totalprice / 600000 AS s, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS y FROM orders"


@query(
    "rerank_recency",
    f"SELECT o_orderkey, round(CASE WHEN m IS NULL THEN s ELSE 0.85 * s + 0.15 * CASE WHEN y IS NULL THEN 0.5 ELSE greatest(0, 1 - 0.2 * (m - y)) END END, 4) AS score FROM (SELECT *, max(y) OVER (PARTITION BY o_custkey) AS m FROM ({_RANKED}))",
)
def rerank_recency(t):
    year = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate"))
    rows = t.orders.select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 600000).alias("s"), year.alias("y")).withColumn("m", F.max("y").over(W.partitionBy("o_custkey")))
    return rows.select("o_orderkey", F.round(ret.recency(F.col("s"), F.col("y"), F.col("m")), 4).alias("score"))


@query("rerank_intent_boost", "SELECT p_partkey, round(0.65 * p_size / 50 + 0.35 * ((p_type = 'PROMO')::INT + (p_brand = 'Brand#3')::INT) / 2, 6) AS score FROM part")
def rerank_intent_boost(t):
    preferred = F.array(F.lit("PROMO"), F.lit("Brand#3"))
    return t.part.select("p_partkey", F.round(ret.intent_boost(F.col("p_size") / 50, F.array("p_type", "p_brand"), preferred), 6).alias("score"))


#: Candidates up to this many are broadcast to the documents: about 50 MB.
BROADCAST_CANDIDATES = 500_000
#: Words that a question is also asked with.
SYNONYMS = (("the", "this"), ("of", "from"), ("is", "was"), ("que", "como"), ("und", "mit"), ("les", "des"))


def variants(t):
    """(query_id, item_id, terms): each item as it is, and with the synonyms of its words, as queries of their own."""
    own = tokens("text")
    more = F.array_compact(F.array(*[F.when(F.array_contains(own, a), F.lit(b)).when(F.array_contains(own, b), F.lit(a)) for a, b in SYNONYMS]))
    asked = t.benchmark.select("item_id", F.posexplode(F.array(own, F.array_union(own, more))).alias("v", "terms"))
    return asked.select((F.col("item_id") * 2 + F.col("v")).alias("query_id"), "item_id", "terms")


@query("retrieval_quality_pipeline")
def retrieval_quality_pipeline(t):
    """Each benchmark item's context. Variants of the question are searched, and their lists merged place by place (of texts
    that begin alike the first stays); rows of the item's form go before; recency and intent; a least score; no
    near-copies; two of a source, one more of a form; the eight best."""
    asked = variants(t)
    few = F.broadcast if t.benchmark.count() * (2 * 60 + 1) <= BROADCAST_CANDIDATES else lambda df: df  # an item has two lists and a form; whole texts stay where they are
    lex = ret.top_k(ret.bm25(t.documents, asked.select("query_id", "terms"), "doc_id", "text", k=60), "query_id", "score", "doc_id", 60)
    own = t.benchmark.select(F.col("item_id").alias("vec_id")).join(t.embeddings, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe"))
    near = ret.dense(own, t.embeddings, 60).select((F.explode(F.array(F.col("query_id") * 2, F.col("query_id") * 2 + 1))).alias("query_id"), F.col("vec_id").alias("doc_id"), "rank")
    fused = ret.top_k(ret.fuse(lex, near, "doc_id"), "query_id", "score", "doc_id", 60).withColumn("s", ret.min_max("score", "query_id"))
    docs = t.documents.select("doc_id", "text", "lang", "source")
    begins = docs.select("doc_id", F.md5(F.substring("text", 1, 200)).alias("begin"))
    listed = few(fused.join(asked.select("query_id", "item_id"), "query_id")).join(begins, "doc_id")
    merged = listed.groupBy("item_id", "begin").agg(F.min(F.struct("rank", "query_id", "doc_id", "s")).alias("m")).select("item_id", "m.doc_id", "m.s", F.lit(0).alias("form"))
    forms = t.benchmark.select("item_id").join(t.labels.filter("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("item_id")).distinct(), "item_id")
    forms = forms.select("item_id", F.col("item_id").alias("doc_id"), F.lit(0.95).alias("s"), F.lit(1).alias("form"))  # an item's form is the good document with its number
    rows = few(forms.unionByName(merged.join(forms.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti"))).join(docs, "doc_id").withColumn("y", 2018 + F.col("doc_id") % 7)
    rows = rows.withColumn("m", F.max("y").over(W.partitionBy("item_id")))
    rows = rows.withColumn("s", ret.recency(F.col("s"), F.col("y"), F.col("m"))).withColumn("s", ret.intent_boost(F.col("s"), F.array("lang", "source"), F.array(F.lit("en"))))
    rows = win.first_per_group(rows.filter("s >= 0.3"), ["item_id"], [F.desc("s"), F.asc("doc_id")], 15)
    rows = rows.withColumn("o", -F.round("s", 6)).withColumn("w", F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")))
    rows = win.greedy_distinct(rows, "item_id", ["o", "doc_id"], "doc_id", "w", 0.9, ["o", "source", "form"])
    place = F.row_number().over(W.partitionBy("item_id", "source").orderBy("o", "doc_id"))
    rows = rows.withColumn("place", place).filter(F.col("place") <= 2 + F.col("form"))
    return win.first_per_group(rows, ["item_id"], [F.col("o"), F.col("doc_id")], 8).select(F.col("item_id").alias("query_id"), "doc_id", (-F.col("o")).alias("score"))


_HELD = "SELECT vec_id, label, embedding, sha256(lower(trim(text))) AS h, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 10 AS INTEGER)) AS seen FROM embeddings JOIN documents ON vec_id = doc_id"


@query(
    "semantic_cache_lookup",
    f"""WITH held AS ({_HELD}), q AS (SELECT vec_id AS query_id, embedding, h FROM held JOIN nation ON vec_id = n_nationkey),
             one AS (SELECT query_id, min(vec_id) AS vec_id FROM q JOIN held USING (h) WHERE vec_id <> query_id AND label < 5 GROUP BY 1),
             c AS (SELECT p.query_id, e.vec_id, {_COS} AS s FROM q p, held e WHERE e.vec_id <> p.query_id AND e.label < 5),
             two AS (SELECT query_id, arg_max(vec_id, s * 1000000 - vec_id / 1000000) AS vec_id FROM c WHERE s > 0.35 GROUP BY 1),
             three AS (SELECT query_id, min(vec_id) AS vec_id FROM q JOIN held USING (h) WHERE vec_id <> query_id AND label >= 5 AND seen >= TIMESTAMP '2024-01-10' - INTERVAL 7 DAY GROUP BY 1)
        SELECT query_id, CASE WHEN one.vec_id IS NOT NULL THEN 1 WHEN two.vec_id IS NOT NULL THEN 2 WHEN three.vec_id IS NOT NULL THEN 3 END AS level, coalesce(one.vec_id, two.vec_id, three.vec_id) AS vec_id
        FROM q LEFT JOIN one USING (query_id) LEFT JOIN two USING (query_id) LEFT JOIN three USING (query_id)""",
)
def semantic_cache_lookup(t):
    """For each query the cached entry: one in memory with the same text, else the one there whose cosine is best and strictly above the threshold, else a stored one with the same text that was read in the last week."""
    seen = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 10 as int))")
    held = t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id")).select("vec_id", "label", "embedding", F.sha2(F.lower(F.trim("text")), 256).alias("h"), seen.alias("seen"))
    asked = held.join(t.nation.select(F.col("n_nationkey").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe"), "h")
    memory, stored = held.filter("label < 5"), held.filter("label >= 5 AND seen >= TIMESTAMP_NTZ '2024-01-10 00:00:00' - INTERVAL '7' DAY")
    same = lambda df, into: asked.join(df, "h").filter("vec_id <> query_id").groupBy("query_id").agg(F.min("vec_id").alias(into))
    near = ret.dense(asked.select("query_id", "probe"), memory, 2).filter("vec_id <> query_id AND score > 0.35")
    best = near.groupBy("query_id").agg(F.min_by("vec_id", "rank").alias("two"))
    rows = asked.select("query_id").join(same(memory, "one"), "query_id", "left").join(best, "query_id", "left").join(same(stored, "three"), "query_id", "left")
    level = F.when(F.col("one").isNotNull(), 1).when(F.col("two").isNotNull(), 2).when(F.col("three").isNotNull(), 3)
    return rows.select("query_id", level.alias("level"), F.coalesce("one", "two", "three").alias("vec_id"))


@query("backfill_sparse", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE len(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]{2,}')))) END AS n_terms, true AS sparse_indexed FROM documents")
def backfill_sparse(t):
    """Sparse terms for the rows that have none yet (here those whose id isn't a multiple of four); a second run changes nothing."""
    rows = t.documents.select("doc_id", "text", (F.col("doc_id") % 4 == 0).alias("sparse_indexed"))
    done, todo = rows.filter("sparse_indexed").select("doc_id", F.lit(0).cast("long").alias("n_terms")), rows.filter("not sparse_indexed")
    return done.unionByName(todo.select("doc_id", F.size(tokens("text")).cast("long").alias("n_terms"))).withColumn("sparse_indexed", F.lit(True))


_NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@query(
    "chunk_id_uuid5",
    f"""SELECT l_orderkey, l_linenumber, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][1 + (instr('0123456789abcdef', h[17:17]) - 1) % 4] || h[18:20] || '-' || h[21:32] AS chunk_id
        FROM (SELECT l_orderkey, l_linenumber, sha1(unhex('{_NAMESPACE.replace("-", "")}') || encode(l_orderkey || ':' || l_linenumber)) AS h FROM lineitem)""",
)
def chunk_id_uuid5(t):
    """Name-based ids of chunks: SHA-1 of a namespace and 'doc:chunk', with version and variant set."""
    from ..functions.ids import uuid5

    return t.lineitem.select("l_orderkey", "l_linenumber", uuid5(_NAMESPACE, F.concat_ws(":", "l_orderkey", "l_linenumber")).alias("chunk_id"))


@query(
    "plug_vector_backend",
    """WITH e AS (SELECT concat(label, '/', vec_id // 8) AS document_id, CAST(vec_id % 8 AS INT) AS chunk_index, label, embedding FROM embeddings),
            w AS (SELECT *, label = 3 AND chunk_index % 2 = 0 AS again, bool_or(label = 3 AND chunk_index % 2 = 0) OVER (PARTITION BY document_id) AS written FROM e),
            n AS (SELECT document_id, chunk_index, CASE label WHEN 7 THEN 'moved' ELSE CAST(label AS VARCHAR) END AS tag, CAST(CASE WHEN again THEN list_reverse(embedding) ELSE embedding END AS DOUBLE[]) AS v
                  FROM w WHERE label <> 5 AND (again OR NOT written)),
            p AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS probe FROM embeddings WHERE vec_id % 100 = 0),
            s AS (SELECT query_id, document_id, chunk_index, tag, round(list_cosine_similarity(v, probe), 6) AS score FROM n, p)
       SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, document_id, chunk_index, tag, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index) QUALIFY row_number() OVER w <= 10""",
)
def plug_vector_backend(t):
    """A stored index after writes, a second write of some documents, deletes and new tags: the ten nearest of every hundredth vector, all cells read."""
    chunks = t.embeddings.select("vec_id", "label", F.concat("label", F.lit("/"), F.floor(F.col("vec_id") / 8)).alias("document_id"), (F.col("vec_id") % 8).alias("chunk_index"), F.array(F.col("label").cast("string")).alias("tags"), "embedding")
    index = VectorIndex(t.spark, scratch(t), 64)
    index.upsert(chunks)
    index.upsert(chunks.filter("label = 3 AND chunk_index % 2 = 0").withColumn("embedding", F.reverse("embedding")))
    index.delete(chunks.filter("label = 5"))
    index.update_tags(chunks.filter("label = 7").withColumn("tags", F.array(F.lit("moved"))))
    probes = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe"))
    return index.search(probes, 10).select("query_id", "rank", "document_id", "chunk_index", F.col("tags")[0].alias("tag"), "score")
