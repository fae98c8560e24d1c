"""Chunking and table extraction."""

from pyspark.sql import functions as F

from ..functions import chunkers
from ..functions import text as tx
from ..operators import chunking as ch
from .registry import query

_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _recursive_sql(size: int, overlap: int) -> str:
    """Texts that are too long are split at the first separator they hold, and their long parts again; runs of short parts (r) are joined from part ``a`` to the part before ``j``."""
    length = lambda a, b: f"(sums[{b} + 1] - sums[{a}] + gap * ({b} - {a}))"  # noqa: E731  of parts a to b with their separators
    joined = " ".join(f"WHEN {mark} THEN array_to_string(parts[a:coalesce(j - 1, n)], {mark})" for mark in ("chr(10) || chr(10)", "chr(10)", "'. '", "' '"))
    return f"""WITH RECURSIVE n AS (
              SELECT doc_id, []::BIGINT[] AS path, text, 1 AS level, NULL::VARCHAR AS mark FROM documents
              UNION ALL
              SELECT doc_id, list_append(path, i), CASE WHEN cut = 5 THEN substr(text, i, {size}) ELSE string_split(text, own)[i] END, cut + 1, own FROM (
                SELECT doc_id, path, text, cut, own, unnest(CASE WHEN cut = 5 THEN range(1, length(text) + 1, {size - overlap}) ELSE range(1, len(string_split(text, own)) + 1) END) AS i FROM (
                  SELECT *, [chr(10) || chr(10), chr(10), '. ', ' ', ''][cut] AS own FROM (
                    SELECT *, CASE WHEN level <= 1 AND contains(text, chr(10) || chr(10)) THEN 1 WHEN level <= 2 AND contains(text, chr(10)) THEN 2 WHEN level <= 3 AND contains(text, '. ') THEN 3 WHEN level <= 4 AND contains(text, ' ') THEN 4 ELSE 5 END AS cut
                    FROM n WHERE length(text) > {size} AND level <= 5)))),
            p AS (SELECT doc_id, path[:-2] AS parent, path[-1] AS i, text, mark, length(text) AS size FROM n WHERE mark <> ''),
            q AS (SELECT *, count(*) FILTER (size > {size}) OVER (PARTITION BY doc_id, parent ORDER BY i) AS run FROM p),
            c AS (SELECT *, sum(size) OVER (PARTITION BY doc_id, parent, run ORDER BY i) AS upto FROM q WHERE size <= {size}),
            r AS (SELECT doc_id, list_append(parent, min(i)) AS path, length(any_value(mark)) AS gap, any_value(mark) AS mark, list(text ORDER BY i) AS parts, list_prepend(0, list(upto ORDER BY i)) AS sums, count(*) AS n FROM c GROUP BY doc_id, parent, run),
            j AS (SELECT *, 1::BIGINT AS a, list_min([x FOR x IN range(2, n + 1) IF {length("1", "x")} > {size}]) AS j FROM r
                  UNION ALL
                  SELECT * EXCLUDE (b), b, list_min([x FOR x IN range(b + 1, n + 1) IF {length("b", "x")} > {size}]) FROM (
                    SELECT * EXCLUDE (a, j), coalesce(list_min([x FOR x IN range(a + 1, j) IF {length("x", "(j - 1)")} <= {overlap} AND {length("x", "j")} <= {size}]), j) AS b FROM j WHERE j IS NOT NULL)),
            o AS (SELECT doc_id, path, a, trim(CASE mark {joined} END, {_SPACE}) AS chunk FROM j
                  UNION ALL SELECT doc_id, path, 0, text FROM n WHERE mark = '' OR (mark IS NULL AND length(text) <= {size} AND trim(text, {_SPACE}) <> ''))
       SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path, a) - 1 AS INT) AS chunk_index, chunk FROM o WHERE chunk <> ''"""


@query("chunk_recursive", _recursive_sql(512, 80))
def chunk_recursive(t):
    return ch.recursive(t.documents, "doc_id", "text", 512, 80)


_LINES = """l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text <> ''),
            r AS (SELECT doc_id, s, 1 AS i, 0 AS chunk, length(s[1]) AS open FROM l
                  UNION ALL SELECT doc_id, s, i + 1, CASE WHEN open + 1 + length(s[i + 1]) <= 3800 THEN chunk ELSE chunk + 1 END, CASE WHEN open + 1 + length(s[i + 1]) <= 3800 THEN open + 1 + length(s[i + 1]) ELSE length(s[i + 1]) END FROM r WHERE i < len(s))"""


@query(
    "plug_chunker",
    f"""WITH RECURSIVE {_LINES},
            w AS (SELECT doc_id, string_split_regex(trim(text, {_SPACE}), '[ \t\n\x0B\f\r]+') AS s FROM documents WHERE trim(text, {_SPACE}) <> '')
       SELECT 'recursive' AS chunker, doc_id, chunk_index, chunk, CAST(length(chunk) AS INT) AS place, CAST(NULL AS INT) AS n FROM ({_recursive_sql(512, 80)})
       UNION ALL SELECT 'sliding', doc_id, CAST(k AS INT), array_to_string(s[k * 96 + 1 : k * 96 + 128], ' '), CAST(k * 96 AS INT), CAST(least(128, len(s) - k * 96) AS INT)
         FROM (SELECT doc_id, s, unnest(range(0, CAST(greatest(0, ceil((len(s) - 128) / 96)) AS BIGINT) + 1)) AS k FROM w)
       UNION ALL SELECT 'lines', doc_id, CAST(chunk AS INT), string_agg(s[i], chr(10) ORDER BY i), CAST(min(i) - 1 AS INT), CAST(count(*) AS INT) FROM r GROUP BY doc_id, chunk""",
)
def plug_chunker(t):
    """Three chunkers by one table function, called by lateral joins; their own columns side by side."""
    chunkers.register(t.spark, {"chunker": "recursive"})
    t.documents.select("doc_id", "text").createOrReplaceTempView("chunked_documents")
    return t.spark.sql("""SELECT 'recursive' AS chunker, d.doc_id, c.chunk_index, c.chunk, c.n_chars AS place, CAST(NULL AS INT) AS n FROM chunked_documents d, LATERAL chunks(d.text) c
        UNION ALL SELECT 'sliding', d.doc_id, c.chunk_index, c.chunk, c.begin_word, c.n_words FROM chunked_documents d, LATERAL chunks(d.text, chunker => 'sliding') c
        UNION ALL SELECT 'lines', d.doc_id, c.chunk_index, c.chunk, c.first_line, c.n_lines FROM chunked_documents d, LATERAL chunks(d.text, chunker => 'lines') c""")


@query(
    "chunk_token_sliding",
    f"SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(i * 96 AS INTEGER) AS start, CAST(least(128, n - i * 96) AS INTEGER) AS n_words FROM (SELECT doc_id, n, unnest(range(0, CAST(greatest(0, ceil((n - 128) / 96)) AS BIGINT) + 1)) AS i FROM (SELECT doc_id, len({_WORDS}) AS n FROM documents) WHERE n > 0)",
)
def chunk_token_sliding(t):
    return ch.sliding(t.documents, "doc_id", "text", 128)


@query("chunk_size_by_tag", "SELECT doc_id, CASE WHEN source = 'src0' THEN 1024 WHEN lang = 'de' THEN 512 ELSE 768 END AS size FROM documents")
def chunk_size_by_tag(t):
    sizes = F.create_map(F.lit("src0"), F.lit(1024), F.lit("de"), F.lit(512))
    return t.documents.select("doc_id", F.coalesce(sizes[F.col("source")], sizes[F.col("lang")], F.lit(768)).alias("size"))


@query("chunk_filter_min_words", f"SELECT doc_id, i AS line FROM (SELECT doc_id, ls[i] AS text, i FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE len({_WORDS}) >= 5")
def chunk_filter_min_words(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    return lines.filter(F.size(tx.words("l")) >= 5).select("doc_id", (F.col("i") + 1).cast("long").alias("line"))


@query("chunk_stats", f"SELECT source, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, CAST(sum(len({_WORDS})) AS BIGINT) AS words FROM documents GROUP BY 1")
def chunk_stats(t):
    return t.documents.groupBy("source").agg(F.sum(F.expr("length(text) div 4")).alias("tokens"), F.sum(F.size(tx.words("text"))).alias("words"))


@query(
    "chunk_line_pack",
    """WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS n FROM documents),
            r AS (SELECT doc_id, n, 1 AS i, 0 AS chunk, n[1] AS open FROM l
                  UNION ALL SELECT doc_id, n, i + 1, CASE WHEN open + 1 + n[i + 1] <= 3800 THEN chunk ELSE chunk + 1 END, CASE WHEN open + 1 + n[i + 1] <= 3800 THEN open + 1 + n[i + 1] ELSE n[i + 1] END FROM r WHERE i < len(n))
       SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_index, CAST(max(open) AS INTEGER) AS n_chars FROM r GROUP BY ALL""",
)
def chunk_line_pack(t):
    packed = t.documents.select("doc_id", F.posexplode(ch.line_pack(F.col("text"), 3800)).alias("chunk_index", "chunk"))
    return packed.select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"))


@query(
    "chunk_section_rows",
    """WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
            s AS (SELECT *, sum((length(line) < 60)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l)
       SELECT doc_id, CAST(section AS BIGINT) AS section, min(i) - 1 AS begin, count(*) AS n FROM s WHERE section > 0 GROUP BY ALL HAVING count(*) >= 2""",
)
def chunk_section_rows(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return ch.sections(lines, "doc_id", "i", F.length("line") < 60).withColumn("begin", F.col("begin").cast("long"))


@query("chunk_csv_estimate", "SELECT l_orderkey, greatest(1, count(*) // 2) AS chunks FROM lineitem GROUP BY 1")
def chunk_csv_estimate(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.greatest(F.lit(1), F.expr("count(*) div 2")).alias("chunks"))


@query(
    "form_field_group",
    "SELECT name, CASE WHEN name LIKE '%name%' THEN 'Insured' WHEN name LIKE '%acctbal%' THEN 'Money' ELSE 'Other' END AS grp, count(*) AS n FROM (SELECT 's_name' AS name FROM supplier UNION ALL SELECT 's_acctbal' FROM supplier UNION ALL SELECT 's_suppkey' FROM supplier) GROUP BY ALL",
)
def form_field_group(t):
    """Cells of a wide form by the group of their field; blank cells and fields that start with _ are passed over."""
    wide = t.supplier.select(F.col("s_suppkey").cast("string").alias("F[0].P1[0].s_suppkey[0]"), F.col("s_name").alias("F[0].P1[0].s_name[0]"), F.col("s_acctbal").cast("string").alias("F[0].P1[0].s_acctbal[0]"), F.lit("x").alias("_ingest_key"))
    fields = [f"`{c}`" for c in wide.columns if not c.startswith("_")]
    cells = wide.unpivot(["_ingest_key"], [F.col(c) for c in fields], "field", "cell").filter("trim(cell) <> ''")
    name = F.regexp_replace(F.regexp_replace("field", r"^F\[\d+\]\.P\d+\[\d+\]\.", ""), r"\[\d+\]$", "")
    rows = cells.select(name.alias("name"))
    return rows.groupBy("name", ch.first_match(F.col("name"), [("Insured", "name"), ("Money", "acctbal")], "Other").alias("grp")).agg(F.count("*").alias("n"))


@query("form_label_humanize", "SELECT p_partkey, replace(regexp_replace(regexp_replace('Form_' || p_type || '_' || upper(p_name[1]) || substr(p_name, 2, 3) || 'Name', '^[^_]*_', ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ') AS label FROM part")
def form_label_humanize(t):
    field = F.concat(F.lit("Form_"), "p_type", F.lit("_"), F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 3), F.lit("Name"))
    return t.part.select("p_partkey", ch.humanized(field).alias("label"))


@query("form_intent_rows", "SELECT o_orderkey, grp, 9000 + i AS chunk_index, CASE WHEN i = 0 THEN 0.95 ELSE 0.9 END AS score, '[' || grp || '] order ' || o_orderkey AS chunk_text FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderstatus = 'F' THEN ['Policy', 'Insured'] ELSE ['Policy'] END) AS grp, unnest(CASE WHEN o_orderstatus = 'F' THEN [0, 1] ELSE [0] END) AS i FROM orders)")
def form_intent_rows(t):
    """Result rows for the groups that an intent asks for, with fixed scores and indexes."""
    groups = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("Policy"), F.lit("Insured"))).otherwise(F.array(F.lit("Policy")))
    rows = t.orders.select("o_orderkey", F.posexplode(groups).alias("i", "grp"))
    return rows.select("o_orderkey", "grp", (9000 + F.col("i")).alias("chunk_index"), F.when(F.col("i") == 0, 0.95).otherwise(0.9).alias("score"), F.format_string("[%s] order %d", "grp", "o_orderkey").alias("chunk_text"))


@query("form_aggregate_unique", "SELECT c_custkey, max(o_orderkey) AS o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def form_aggregate_unique(t):
    rows = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
    return rows.groupBy("c_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))


@query("table_extract_gate", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 3")
def table_extract_gate(t):
    """Tables (orders, with lines as rows) that still have two rows when the first has become the header."""
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).filter("n >= 2 AND n - 1 >= 2").select("l_orderkey")


@query("table_header_promote", "SELECT l_orderkey, bool_or(a.l_quantity > 25 AND b.l_orderkey IS NOT NULL) AS header FROM lineitem a LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 2) b USING (l_orderkey) WHERE a.l_linenumber = 1 GROUP BY 1")
def table_header_promote(t):
    """Is the first row all text and the second not? (Here first rows of large quantities have text in place of the number.)"""
    first = t.lineitem.filter("l_linenumber = 1").select("l_orderkey", F.array(F.when(F.col("l_quantity") > 25, F.col("l_linestatus")).otherwise(F.col("l_quantity").cast("string")), "l_returnflag").alias("cells"))
    second = t.lineitem.filter("l_linenumber = 2").select("l_orderkey", F.array(F.col("l_quantity").cast("string"), "l_returnflag").alias("under"))
    number = lambda x: x.try_cast("double").isNotNull()
    rows = first.join(second, "l_orderkey", "left")
    return rows.select("l_orderkey", (~F.exists("cells", number) & F.coalesce(F.exists("under", number), F.lit(False))).alias("header")).groupBy("l_orderkey").agg(F.bool_or("header").alias("header"))


@query("table_name_slug", "SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name || '/' || p_type), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g'), 1, 40) || '_' || substr(sha256(p_partkey || ':0'), 1, 8) AS name FROM part")
def table_name_slug(t):
    return t.part.select("p_partkey", tx.table_name(F.concat_ws("/", "p_name", "p_type"), F.concat(F.col("p_partkey").cast("string"), F.lit(":0"))).alias("name"))


@query(
    "row_value_samples",
    """WITH s AS (SELECT 'p_type' AS name, lower(trim(p_type)) AS value, min(p_partkey) AS k FROM part GROUP BY 2 UNION ALL SELECT 'p_brand', lower(trim(p_brand)), min(p_partkey) FROM part GROUP BY 2 UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), min(p_partkey) FROM part GROUP BY 2 UNION ALL SELECT 'p_retailprice', CAST(p_retailprice AS VARCHAR), min(p_partkey) FROM part GROUP BY 2)
       SELECT name, value FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k, value) AS r, count(*) OVER (PARTITION BY name) AS n FROM s) WHERE r <= 50 AND n <= 200""",
)
def row_value_samples(t):
    return ch.value_samples(t.part, "p_partkey", ["p_type", "p_brand", "p_size", "p_retailprice"])


@query("pl_table_detect", "SELECT c_nationkey, CAST(floor(c_acctbal / 500) AS BIGINT) AS level, len(list_intersect(list(DISTINCT lower(c_mktsegment)), ['building', 'machinery', 'revenue'])) >= 2 AS is_pl FROM customer GROUP BY 1, 2")
def pl_table_detect(t):
    signs = F.array(F.lit("building"), F.lit("machinery"), F.lit("revenue"))
    found = t.customer.groupBy("c_nationkey", F.floor(F.col("c_acctbal") / 500).alias("level")).agg(F.collect_set(F.lower("c_mktsegment")).alias("v"))
    return found.select("c_nationkey", "level", (F.size(F.array_intersect("v", signs)) >= 2).alias("is_pl"))


@query(
    "identifier_truncate_63",
    "SELECT p_partkey, CASE WHEN n = 1 THEN c ELSE substr(c, 1, 8 - length('_' || (n - 1))) || '_' || (n - 1) END AS short FROM (SELECT p_partkey, substr(p_name, 1, 8) AS c, row_number() OVER (PARTITION BY substr(p_name, 1, 8) ORDER BY p_partkey) AS n FROM part)",
)
def identifier_truncate_63(t):
    """With a limit of eight characters here, so that names do collide."""
    return ch.shortened(t.part, "p_name", "p_partkey", 8).select("p_partkey", "short")
