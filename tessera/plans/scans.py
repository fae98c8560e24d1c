"""Scans."""


from pyspark.sql import functions as F

from ..operators import structure
from ..sources import files, office
from .registry import query


@query("scan_html_text", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def scan_html_text(t):
    """The rule for pages that no parser reads: tags become blanks."""
    return t.pages.select("page_id", F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"\s+", " ")).alias("text"))


@query("scan_html_dom")
def scan_html_dom(t):
    """Text nodes of pages, one a line, scripts and styles left out."""
    import pandas as pd

    def parse(frames):
        for frame in frames:
            yield pd.DataFrame({"page_id": frame["page_id"], "text": frame["html"].fillna("").map(files.dom_text)})

    return t.pages.select("page_id", "html").mapInPandas(parse, "page_id long, text string")


@query("scan_csv_text", "SELECT string_agg(n_nationkey || ', ' || n_name || ', ' || n_regionkey, chr(10) ORDER BY n_nationkey) AS text FROM nation")
def scan_csv_text(t):
    line = F.concat_ws(", ", "n_nationkey", "n_name", "n_regionkey")
    listed = F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l"))))  # one file of lines
    return t.nation.agg(F.array_join(F.transform(listed, lambda x: x["l"]), "\n").alias("text"))


@query("csv_validate_gate", "SELECT CASE WHEN count(*) = 0 THEN 'csv_empty' WHEN count(*) FILTER (l_discount > 0.09) / count(*) > 0.05 THEN 'csv_bad_row_rate' END AS code FROM lineitem")
def csv_validate_gate(t):
    return files.gate(t.lineitem.withColumn("bad", F.col("l_discount") > 0.09), "bad", 3)


@query("scan_parquet_benchmark", "SELECT item_id, text AS question, sha256(text) AS checksum FROM benchmark")
def scan_parquet_benchmark(t):
    rows = files.benchmark(t.spark, f"{t.folder}/benchmark.parquet", ("item_id", "text"))
    return rows.select("item_id", F.col("text").alias("question"), F.sha2("text", 256).alias("checksum"))


@query(
    "scan_query_file",
    "SELECT doc_id, regexp_replace(regexp_replace(l, '^\\d+[\\.\\)\\-\\s]+', ''), '\\s+', ' ', 'g') AS line FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS l FROM documents) WHERE l <> '' AND NOT starts_with(l, '#') AND NOT starts_with(l, '//')",
)
def scan_query_file(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).select("doc_id", F.trim("l").alias("l"))
    kept = lines.filter((F.col("l") != "") & ~F.col("l").startswith("#") & ~F.col("l").startswith("//"))
    return kept.select("doc_id", F.regexp_replace(F.regexp_replace("l", r"^\d+[\.\)\-\s]+", ""), r"\s+", " ").alias("line"))


@query("scan_vector_scroll", "SELECT vec_id, label FROM embeddings WHERE label = 3")
def scan_vector_scroll(t):
    return t.embeddings.filter("label = 3").select("vec_id", "label")


@query("scan_registry", "SELECT 'nation' AS table_name, n_regionkey AS schema_id, count(*) AS n FROM nation GROUP BY ALL UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY ALL")
def scan_registry(t):
    first = t.nation.groupBy(F.col("n_regionkey").alias("schema_id")).agg(F.count("*").alias("n")).withColumn("table_name", F.lit("nation"))
    return first.unionByName(t.supplier.groupBy(F.col("s_nationkey").alias("schema_id")).agg(F.count("*").alias("n")).withColumn("table_name", F.lit("supplier")))


@query("scan_csv_structured", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def scan_csv_structured(t):
    """Suppliers written with semicolons, and read back by a reader that finds the delimiter out."""
    from .state import scratch

    path = scratch(t)
    t.supplier.select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).option("sep", ";").csv(path)
    return files.delimited(t.spark, path).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"))


def _structure_sql(limit: int) -> str:
    text = "regexp_replace(split_part(raw, chr(2), 2), '<[^>]*>', '', 'g')"
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{sign}')"
    above = ", ".join(f"max(CASE WHEN level BETWEEN 1 AND {k} THEN i END) OVER o AS at{k}, max(CASE WHEN level = {k} THEN i END) OVER o AS own{k}" for k in range(1, 7))
    crumbs = ", ".join(f"CASE WHEN own{k} = at{k} THEN titles[own{k}] END" for k in range(1, 7))  # a title stands until one of its level or above comes
    return f"""WITH RECURSIVE m AS (SELECT page_id, chr(2) || regexp_replace(regexp_replace(translate(html, chr(1) || chr(2), '  '), '{structure.HIDDEN}', ' ', 'g'), '{structure.BLOCKS}', chr(1) || '\\1' || chr(2), 'g') AS html FROM pages),
            r AS (SELECT page_id, i, string_split(html, chr(1))[i] AS raw FROM (SELECT page_id, html, unnest(range(1, len(string_split(html, chr(1))) + 1)) AS i FROM m)),
            e AS (SELECT page_id, i, CASE WHEN regexp_matches(lower(split_part(raw, chr(2), 1)), '^h[1-6]$') THEN CAST(split_part(raw, chr(2), 1)[2] AS INT) ELSE 0 END AS level, trim(regexp_replace({text}, '{structure.BLANKS}', ' ', 'g')) AS text FROM r),
            t AS (SELECT page_id, map_from_entries(list((i, text))) AS titles FROM e WHERE level > 0 AND text <> '' GROUP BY 1),
            s AS (SELECT *, {above}, count(*) FILTER (level > 0) OVER o AS section FROM e WHERE text <> '' WINDOW o AS (PARTITION BY page_id ORDER BY i)),
            c AS (SELECT page_id, i, section, string_split(text, ' ') AS words, list_filter([{crumbs}], lambda x: x IS NOT NULL) AS path FROM s LEFT JOIN t USING (page_id) WHERE level = 0),
            p AS (SELECT page_id, section, path, words[k * {limit} + 1 : (k + 1) * {limit}] AS words, row_number() OVER (PARTITION BY page_id, section ORDER BY i, k) AS turn FROM (SELECT *, unnest(range(0, (len(words) - 1) // {limit} + 1)) AS k FROM c)),
            f AS (SELECT page_id, section, turn, 0 AS chunk, len(words) AS n FROM p WHERE turn = 1
                  UNION ALL SELECT p.page_id, p.section, p.turn, CASE WHEN f.n + len(p.words) <= {limit} THEN chunk ELSE chunk + 1 END, CASE WHEN f.n + len(p.words) <= {limit} THEN f.n + len(p.words) ELSE len(p.words) END
                  FROM f JOIN p ON p.page_id = f.page_id AND p.section = f.section AND p.turn = f.turn + 1)
       SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY section, chunk) - 1 AS INT) AS chunk_index, CASE WHEN len(path) > 0 THEN array_to_string(path, ' > ') END AS breadcrumb, path[-1] AS section, text
       FROM (SELECT page_id, section, chunk, any_value(path) AS path, string_agg(array_to_string(words, ' '), chr(10) ORDER BY turn) AS text FROM f JOIN p USING (page_id, section, turn) GROUP BY ALL)"""


@query("scan_docling", _structure_sql(128))
def scan_docling(t):
    """Chunks of pages below their headings, at most 128 words each, with the trail of headings that leads there."""
    found = t.pages.select("page_id", F.posexplode(structure.chunks(structure.elements(F.col("html")), 128)).alias("chunk_index", "c"))
    return found.select("page_id", "chunk_index", "c.breadcrumb", "c.section", "c.text")


@query(
    "scan_xlsx_text",
    """SELECT c_nationkey AS nation, c_mktsegment AS sheet, CAST(1 + row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS INT) AS row, concat_ws(', ', c_custkey, c_name, CAST(round(c_acctbal * 100) AS BIGINT)) AS text FROM customer
       UNION ALL SELECT DISTINCT c_nationkey, c_mktsegment, 1, 'c_custkey, c_name, cents' FROM customer""",
)
def scan_xlsx_text(t):
    """Customers as workbooks, one a nation with a sheet for each segment, read back row by row."""
    rows = t.customer.withColumn("cents", F.round(F.col("c_acctbal") * 100).cast("long"))
    found = office.parsed(office.workbooks(rows, "c_nationkey", "c_mktsegment", ["c_custkey"], ["c_custkey", "c_name", "cents"]))
    return found.select(F.split_part("path", F.lit("-"), F.lit(1)).cast("int").alias("nation"), F.col("part").alias("sheet"), F.col("number").alias("row"), office.line(F.col("kind"), F.col("cells")).alias("text"))


_XML = "[^\\t\\n\\r\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]"


@query(
    "scan_pdf_docx_pptx",
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), p AS (SELECT doc_id, i, regexp_replace(replace(s[i], chr(13), chr(10)), '{_XML}', '', 'g') AS text FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM l))
       SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS number, text FROM p WHERE regexp_matches(text, '[^ \\t\\n\\r\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]')""",
)
def scan_pdf_docx_pptx(t):
    """Every document as a text processor's file, a paragraph for each line; its paragraphs read back."""
    import pandas as pd

    def write(frames):
        for frame in frames:
            yield pd.DataFrame({"path": frame["doc_id"].astype(str), "content": [office.letter(x.split("\n")) for x in frame["text"].fillna("")]})

    found = office.parsed(t.documents.select("doc_id", "text").mapInPandas(write, "path string, content binary"))
    return found.filter("kind = 'paragraph' OR error IS NOT NULL").select(F.col("path").cast("long").alias("doc_id"), "number", F.coalesce(F.col("cells")[0], "error").alias("text"))
