"""Tags by rules that are rows of a table, so that ten thousand rules cost one pass.

Columns of a table of rules: ``rule_id`` (their order), ``source`` (path, keyword, email), ``namespace``, ``value``; for paths ``level``,
``folder`` (a folder by name) or ``pattern`` and ``capture`` with ``transform``, ``parent`` (a pattern for the folder above); for
keywords ``any_of``, ``all_of``, ``case_sensitive`` and ``priority``; for mail ``pattern``. ``config.Strategy.rules()`` makes one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import slug

RULES = "rule_id int, source string, namespace string, value string, level int, folder string, pattern string, capture int, transform string, parent string, any_of array<string>, all_of array<string>, case_sensitive boolean, priority int"
#: Phrases of the rules of one pass, and bytes in them; more rules take more passes.
PHRASES, PHRASE_BYTES = 200_000, 16_000_000


def folders(path: Column, offset: int = 0) -> Column:
    """The folders of a path: backslashes count as slashes, a last part with a dot is a file, the first ``offset`` are passed over."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    parts = F.split(plain, "/")
    parts = F.when(F.element_at(parts, -1).contains("."), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.trim(path) == "", F.array().cast("array<string>")).otherwise(F.slice(parts, offset + 1, F.greatest(F.size(parts), F.lit(1))))


def path_tags(df: DataFrame, key: str, path: str, rules: DataFrame, offset: int = 0) -> DataFrame:
    """(key, namespace, value, rule_id) of each rule that a folder of the path satisfies.

    A rule with ``folder`` gives its value where the folder at its level has that name. Others give what their pattern captures
    (from the folder's start; without a pattern the folder itself) in the form that ``transform`` names: slugify, lowercase, nothing.
    A ``parent`` must fit the folder above, so it fits none at level 0. Each distinct folder meets the rules of its level once, however
    many paths hold it. A null path has no tags.
    """
    parts = folders(F.col(path), offset)
    steps = df.select(F.col(key).alias("_key"), F.posexplode(F.transform(parts, lambda x, i: F.struct(x.alias("folder"), F.when(i > 0, F.get(parts, i - 1)).alias("above")))).alias("_level", "_at"))
    steps = steps.select("_key", "_level", F.col("_at.folder").alias("_folder"), F.col("_at.above").alias("_above"))
    seen = steps.select("_level", "_folder", "_above").distinct()
    mine = rules.filter("source = 'path'")
    above = F.col("parent").isNull() | F.coalesce(F.regexp_like("_above", F.concat(F.lit("^(?:"), F.col("parent"), F.lit(")"))), F.lit(False))
    named = seen.join(mine.filter("folder IS NOT NULL"), (F.col("_level") == F.col("level")) & (F.col("_folder") == F.col("folder"))).filter(above)
    start = F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")"))
    free = seen.join(mine.filter("folder IS NULL"), F.col("_level") == F.col("level")).filter(above & (F.col("pattern").isNull() | F.regexp_like("_folder", start)))
    found = F.when(F.col("pattern").isNull(), F.col("_folder")).otherwise(F.call_function("regexp_extract", F.col("_folder"), start, F.coalesce("capture", F.lit(1))))
    found = F.when(F.col("transform") == "slugify", slug(found)).when(F.col("transform") == "lowercase", F.lower(found)).otherwise(found)
    cols = ["_level", "_folder", "_above", "namespace", "rule_id"]
    tags = named.select(*cols, "value").unionByName(free.select(*cols, found.alias("value"))).filter("value <> ''")
    tags = tags.withColumnsRenamed({"_level": "_l", "_folder": "_f", "_above": "_a"})
    same = (F.col("_level") == F.col("_l")) & (F.col("_folder") == F.col("_f")) & F.col("_above").eqNullSafe(F.col("_a"))
    return steps.join(tags, same).select(F.col("_key").alias(key), "namespace", "value", "rule_id")


def plain(text: str, case_sensitive: bool) -> str:
    """Composed, with one blank for each run of white space, and in capitals unless case counts."""
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).strip()
    return text if case_sensitive else text.upper()


class Phrases:
    """Keyword rules with one automaton for the phrases that ignore case and one for the others."""

    def __init__(self, rules: list) -> None:
        self.rules, self.need, self.of, self.number = [], [], [], ({}, {})
        for i, r in enumerate(sorted(rules, key=lambda r: (-(r.priority or 0), r.rule_id))):  # the first that holds wins
            self.rules.append((r.namespace, r.value, r.rule_id, r.priority or 0))
            case = bool(r.case_sensitive)
            some, each = ({self._number(x, case) for x in xs or ()} for xs in (r.any_of, r.all_of))
            self.need.append((some, each))
            for n in each or some:
                self.of[n].append(i)
        self.built = None

    def _number(self, phrase: str, case: bool) -> int:
        phrase = plain(phrase, case)
        if phrase not in self.number[case]:
            self.number[case][phrase] = len(self.of)
            self.of.append([])
        return self.number[case][phrase]

    def tags(self, text: str | None) -> list[tuple]:
        """(namespace, value, rule_id, priority) of the first rule of each namespace that holds."""
        if self.built is None:  # by each worker
            import ahocorasick

            self.built = []
            for case, number in enumerate(self.number):
                machine = ahocorasick.Automaton()
                for phrase, n in number.items():
                    if phrase:
                        machine.add_word(phrase, n)
                if len(machine):
                    machine.make_automaton()
                    self.built.append((bool(case), machine))
        seen = {number[""] for number in self.number if "" in number} if text else set()  # a phrase of blanks is in every text
        for case, machine in self.built:
            seen.update(n for _, n in machine.iter(plain(text or "", case)))
        best: dict[str, tuple] = {}
        for i in sorted({i for n in seen for i in self.of[n]}):
            some, each = self.need[i]
            if self.rules[i][0] not in best and each <= seen and (not some or some & seen):
                best[self.rules[i][0]] = self.rules[i]
        return list(best.values())

    def __getstate__(self) -> dict:
        return self.__dict__ | {"built": None}


def keyword_tags(df: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, namespace, value, rule_id): of each namespace the rule of highest priority that the whole text satisfies, the first of equal ones.

    A rule holds if all of ``all_of`` and, where there are any, one of ``any_of`` are in the text; a rule with neither never does. Texts go
    through one automaton of all phrases where they are read; nothing is exchanged unless the rules take more than one pass (then
    ``key`` must tell rows apart). A null or empty text has no tags.
    """
    mine = rules.filter((F.col("source") == "keyword") & (F.coalesce(F.size("any_of"), F.lit(0)) + F.coalesce(F.size("all_of"), F.lit(0)) > 0)).select("rule_id", "namespace", "value", "any_of", "all_of", "case_sensitive", "priority")
    words = F.concat(F.coalesce("any_of", F.array().cast("array<string>")), F.coalesce("all_of", F.array().cast("array<string>")))
    size = mine.agg(F.sum(F.size(words)).alias("n"), F.sum(F.octet_length(F.array_join(words, ""))).alias("bytes")).first()
    passes = max(1, -(-(size.n or 0) // PHRASES), -(-(size.bytes or 0) // PHRASE_BYTES))
    out = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("namespace", T.StringType()), T.StructField("value", T.StringType()), T.StructField("rule_id", T.IntegerType()), T.StructField("priority", T.IntegerType())])
    found = None
    for k in range(passes):
        some = mine.filter(F.pmod("rule_id", F.lit(passes)) == k).collect()  # PHRASES and PHRASE_BYTES bound them
        sent = df.sparkSession.sparkContext.broadcast(Phrases(some))

        def tag(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, tags = [], []
                for i, x in enumerate(batch.column(1).to_pylist()):
                    mine = sent.value.tags(x)
                    rows += [i] * len(mine)
                    tags += mine
                columns = [batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array([t[j] for t in tags], kind) for j, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, out.names)

        told = df.select(key, text).mapInArrow(tag, out)
        found = told if found is None else found.unionByName(told)
    if passes > 1:
        first = F.row_number().over(W.partitionBy(key, "namespace").orderBy(F.desc("priority"), "rule_id"))
        found = found.withColumn("_r", first).filter("_r = 1").drop("_r")
    return found.drop("priority")


def email_tags(df: DataFrame, key: str, subject: str, rules: DataFrame) -> DataFrame:
    """(key, namespace, value, rule_id): the tags of each pattern that is found in the subject, each tag once. Patterns meet each distinct subject once."""
    mine = rules.filter("source = 'email' AND pattern IS NOT NULL").select("rule_id", "namespace", "value", "pattern")
    subjects = df.select(F.col(subject).alias("_s")).filter("_s IS NOT NULL").distinct()
    tags = subjects.join(mine, F.regexp_like("_s", F.col("pattern"))).groupBy("_s", "namespace", "value").agg(F.min("rule_id").alias("rule_id"))
    return df.select(key, F.col(subject).alias("_own")).join(tags, F.col("_own") == F.col("_s")).select(key, "namespace", "value", "rule_id")


def document_type(said: Column, known: list[str]) -> Column:
    """The type that a model named if the strategy has it, else ``unknown``."""
    return F.when(F.lower(F.trim(said)).isin(known), F.lower(F.trim(said))).otherwise("unknown")
