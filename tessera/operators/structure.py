"""Chunks that know where they stand: a page as a list of elements, a stack of headings over them, and texts packed below one heading.

All of it happens in the row of the page, by built-in functions: nothing is exploded or exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What holds no text of the page, and the tags that begin or end a block of text.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<title\b.*?</title>|<nav\b.*?</nav>"
BLOCKS = r"(?i)<(/?(?:h[1-6]|p|div|ul|ol|li|dl|dt|dd|table|tr|td|th|caption|article|section|main|aside|header|footer|form|pre|blockquote|body|hr|br))\b[^>]*>"
BLANKS = "[ \\t\\n\\r\\f]+"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
_BEGIN, _END = "\x01", "\x02"


def elements(html: Column) -> Column:
    """The blocks of a page in order, as (level, text): level 1 to 6 for a heading, 0 for other text. Blocks without text are left out; a null page has none."""
    marked = F.regexp_replace(F.regexp_replace(F.translate(html, _BEGIN + _END, "  "), HIDDEN, " "), BLOCKS, f"{_BEGIN}$1{_END}")
    first = F.concat(F.lit(_END), marked)  # what stands before the first tag has none

    def block(raw: Column) -> Column:
        tag, text = F.lower(F.substring_index(raw, _END, 1)), F.regexp_replace(F.substring_index(raw, _END, -1), "<[^>]*>", "")
        for entity, sign in _ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(sign))
        level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int")).otherwise(0)
        return F.struct(level.alias("level"), F.trim(F.regexp_replace(text, BLANKS, " ")).alias("text"))

    return F.coalesce(F.filter(F.transform(F.split(first, _BEGIN), block), lambda x: x["text"] != ""), F.array().cast("array<struct<level:int,text:string>>"))


def chunks(blocks: Column, limit: int, joined: str = " > ") -> Column:
    """(breadcrumb, section, text) of each chunk, in order.

    A heading takes the place of those of its level and below; ``breadcrumb`` joins the ones that are open, ``section`` is the last (both
    null before the first heading). Texts below one heading are joined, a line each, while the chunk has ``limit`` words
    at most; a text with more is cut into runs of ``limit`` words. A heading without text gives no chunk.
    """
    pieces = F.flatten(F.transform(blocks, lambda b: F.when(b["level"] > 0, F.array(F.struct(b["level"].alias("level"), b["text"].alias("text"), F.lit(0).alias("n")))).otherwise(_cut(b["text"], limit))))
    chunk = "struct<breadcrumb:string,section:string,text:string>"
    start = F.struct(
        F.array().cast("array<struct<level:int,text:string>>").alias("stack"), F.array().cast(f"array<{chunk}>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("words")
    )

    def closed(s: Column) -> Column:
        titles = F.transform(s["stack"], lambda h: h["text"])
        told = F.struct(F.when(F.size(titles) > 0, F.array_join(titles, joined)).alias("breadcrumb"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), titles), -1).alias("section"), s["open"].alias("text"))
        return F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(told)))

    def step(s: Column, p: Column) -> Column:
        heading = F.struct(
            F.concat(F.filter(s["stack"], lambda h: h["level"] < p["level"]), F.array(F.struct(p["level"].alias("level"), p["text"].alias("text")))).alias("stack"),
            closed(s).alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("words"),
        )
        more = F.struct(s["stack"].alias("stack"), s["done"].alias("done"), F.concat(s["open"], F.lit("\n"), p["text"]).alias("open"), (s["words"] + p["n"]).alias("words"))
        new = F.struct(s["stack"].alias("stack"), closed(s).alias("done"), p["text"].alias("open"), p["n"].alias("words"))
        return F.when(p["level"] > 0, heading).when(s["open"].isNotNull() & (s["words"] + p["n"] <= limit), more).otherwise(new)

    return F.aggregate(pieces, start, step, closed)


def _cut(text: Column, limit: int) -> Column:
    words = F.split(text, " ")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / limit).cast("int")), lambda i: F.slice(words, i * limit + 1, F.lit(limit)))
    return F.transform(runs, lambda r: F.struct(F.lit(0).alias("level"), F.array_join(r, " ").alias("text"), F.size(r).alias("n")))
