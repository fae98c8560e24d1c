"""Text as Columns: tokens, cleaning, matching, redaction, names."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words between characters that are neither letters, digits nor underscores, in any language.
_SPLIT = r"[^\p{L}\p{N}_]+"


def words(text: str | Column) -> Column:
    """Runs of non-blanks."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def ascii_tokens(text: str | Column, least: int = 1) -> Column:
    """Lower-case words of ASCII letters and digits alone, with repeats, of that length at least."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), _SPLIT), lambda x: x.rlike(f"^[a-z0-9]{{{least},}}$"))


def tokens(text: str | Column, least: int = 2) -> Column:
    """The distinct tokens of a text."""
    return F.array_distinct(ascii_tokens(text, least))


def key_terms(text: str | Column, stop: Sequence[str]) -> Column:
    """Distinct tokens of three letters or more that aren't stop words."""
    return F.array_except(tokens(text, 3), F.array(*[F.lit(w) for w in stop]))


def coverage(answer: Column, context: Column, gap: Column | None = None) -> Column:
    """The share of the answer's terms that the context has, gap terms left out; no terms: 0, gap terms only: 0.7."""
    left = answer if gap is None else F.array_except(answer, gap)
    share = F.size(F.array_intersect(left, context)) / F.size(left)
    return F.when(F.size(answer) == 0, 0.0).when(F.size(left) == 0, 0.7).otherwise(share)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; both empty: 0."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def slug(text: str | Column) -> Column:
    """Lower case; blanks and underscores become hyphens, other signs go, hyphens don't repeat or stand at an end."""
    text = F.col(text) if isinstance(text, str) else text
    out = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\s_]+", "-"), "[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-|-$", "")


def table_name(text: Column, key: Column) -> Column:
    """A name for a table: at most 40 of [a-z0-9_], and eight hex digits of a hash of the key."""
    base = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_|_$", "")
    return F.concat(F.substring(base, 1, 40), F.lit("_"), F.substring(F.sha2(key, 256), 1, 8))


def canonical(text: str | Column, stop: Sequence[str], least: int = 3, most: int = 80) -> Column:
    """A signal in canonical form: hyphens and underscores are blanks, blanks don't repeat; stop words and lengths outside become ''."""
    text = F.col(text) if isinstance(text, str) else text
    out = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, "[-_]", " "), r"\s+", " ")))
    return F.when(out.isin(list(stop)) | ~F.length(out).between(least, most), "").otherwise(out)


def redact(text: str | Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Each pattern's matches become [NAME], in order."""
    text = F.col(text) if isinstance(text, str) else text
    return reduce(lambda c, p: F.regexp_replace(c, p[1], f"[{p[0]}]"), patterns, text)


def phonetic(text: Column) -> Column:
    """A four-character sound code: H, W and vowels reset the code before, Y codes as 2; no letters: 0000."""
    letters = F.regexp_replace(F.upper(text), "[^A-Z]", "")
    codes = F.translate(letters, "AEIOUHWBFPVCGJKQSXZYDTLMNR", "00000001111222222222334556")
    kept = F.aggregate(
        F.split(F.substring(codes, 2, 10_000), ""),
        F.struct(F.lit("").alias("out"), F.substring(codes, 1, 1).alias("last")),
        lambda s, c: F.struct(F.when((c != "0") & (c != "") & (c != s["last"]), F.concat(s["out"], c)).otherwise(s["out"]).alias("out"), F.when(c == "", s["last"]).otherwise(c).alias("last")),
        lambda s: s["out"],
    )
    return F.when(letters == "", "0000").otherwise(F.substring(F.rpad(F.concat(F.substring(letters, 1, 1), kept), 4, "0"), 1, 4))


def any_of(text: Column, terms: Sequence[str]) -> Column:
    return reduce(Column.__or__, [text.contains(x) for x in terms], F.lit(False))


def all_of(text: Column, terms: Sequence[str]) -> Column:
    return reduce(Column.__and__, [text.contains(x) for x in terms], F.lit(True))


def parse_date(text: Column) -> Column:
    """month/day/year with four or two digits, or year-month-day; else null."""
    return F.coalesce(
        F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/yyyy")),
        F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(text, "M/d/yy")),
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d")),
    )


def html_text(html: str | Column) -> Column:
    """Text of a page by rule: scripts and styles go, tags become blanks, blanks don't repeat."""
    html = F.col(html) if isinstance(html, str) else html
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " "))


def variants(question: Column, synonyms: Sequence[tuple[str, Sequence[str]]], topics: Sequence[tuple[Sequence[str], str]]) -> Column:
    """What a question is searched as: itself, then what each group of ``synonyms`` and each of ``topics`` adds, in their order.

    A group is a term and its synonyms; a term matches if all of its tokens are tokens of the question. Where the term
    matches, its synonyms are added; else, for the first synonym that does, the term and the other synonyms. A topic's text is
    added if any of its words is anywhere in the question, in lower case. Variants may repeat; a null question has none.
    """
    own, low = tokens(question), F.lower(question)
    ascii_word = re.compile("[a-z0-9]+")

    def fits(term: str) -> Column:
        needed = [w for w in re.split(r"[^\w]+", term.lower()) if len(w) >= 2 and ascii_word.fullmatch(w)]
        return F.size(F.array_except(F.array(*[F.lit(w) for w in needed]), own)) == 0 if needed else F.lit(True)

    array = lambda texts: F.array(*[F.lit(x) for x in texts]).cast("array<string>")
    added = [F.array(question)]
    for term, others in synonyms:
        more = F.when(fits(term), array(others))
        for i, other in enumerate(others):
            more = more.when(fits(other), array([term, *others[:i], *others[i + 1 :]]))
        added.append(more.otherwise(array([])))
    for words_, text in topics:
        found = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words_])
        added.append(F.when(found, array([text])).otherwise(array([])))
    return F.when(question.isNotNull(), F.concat(*added))
