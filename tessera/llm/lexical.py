"""Ranked lexical search by one automaton of all items' terms, run over the whole texts.

A term is found only between guards: signs that no term holds become blanks, ASCII capitals their small
letters, and the automaton's patterns have a blank on each side, so a match is a whole term. It reads the bytes
of the texts; what it tells for a document are the numbers of the terms that match, and how often each. No index
of the documents is kept: one scan counts in how many documents each term stands, a second one counts again and
scores. What an automaton tells is mapped to the items that ask for the term, and each task keeps the best of
each item. Terms are cut into shards of SHARD_TERMS terms and SHARD_BYTES bytes at most, so that an automaton has a
bounded size whatever the number of items; each shard's items are complete, and texts are scanned for each shard.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common, hashing

LIMIT = 20
#: Items of a shard hold so many terms, repeats included, and bytes of text at most; one item that holds more is a shard of its own.
SHARD_TERMS, SHARD_BYTES = 200_000, 4_000_000
#: Scores that a task holds before it drops those that are not among an item's best.
HELD = 400_000
_NO_ID = (1 << 63) - 1

_TERM = np.zeros(256, bool)
_TERM[0x80:] = True
for _first, _last in ("09", "AZ", "az"):
    _TERM[ord(_first) : ord(_last) + 1] = True
_NORMAL = bytes(i + 32 if 0x41 <= i <= 0x5A else i if _TERM[i] else 0x20 for i in range(256))


def normal(text: str | None) -> str:
    """The UTF-8 bytes of a text as one character each, with a blank for every sign between terms, and one at both ends."""
    return (b" %b " % (text or "").encode().translate(_NORMAL)).decode("latin-1")


def n_terms(guarded: str) -> int:
    ink = np.frombuffer(guarded.encode("latin-1"), np.uint8) != 0x20
    return int(np.count_nonzero(ink[1:] & ~ink[:-1]))


class Shard:
    """The terms of some items, their automaton, and which items ask for each term (a repeat counts again)."""

    def __init__(self, rows: list[int], texts: list[str | None]) -> None:
        self.items, self.rows = len(texts), np.array(rows, np.int64)
        number: dict[str, int] = {}
        asked: list[Counter] = []
        for text in texts:
            asked.append(Counter(number.setdefault(term, len(number)) for term in normal(text).split()))
        self.terms = list(number)
        pairs = sorted((term, item, times) for item, mine in enumerate(asked) for term, times in mine.items())
        self.item, self.times = np.array([p[1] for p in pairs], np.int64), np.array([p[2] for p in pairs], np.int64)
        self.first = np.searchsorted(np.array([p[0] for p in pairs], np.int64), np.arange(len(number) + 1))
        self.automaton = None

    def counts(self, guarded: str) -> Counter:
        """How often each term stands in a text, by its number."""
        if not self.terms:  # an automaton of nothing can't be run
            return Counter()
        if self.automaton is None:  # built by each worker
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for i, term in enumerate(self.terms):
                self.automaton.add_word(f" {term} ", i)
            self.automaton.make_automaton()
        return Counter(map(itemgetter(1), self.automaton.iter(guarded)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}


_built: dict[str, Shard] = {}


def _mine(name: str, shipped: Broadcast) -> Shard:
    """The shard of a broadcast by its name, with the automaton that this worker has built."""
    if name not in _built:
        _built.clear()
        _built[name] = shipped.value
    return _built[name]


def statistics(docs: DataFrame, name: str, shipped: Broadcast) -> DataFrame:
    """(term, n): documents that hold each term of the shard; at -1 those with any term at all, at -2 all their terms."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _mine(name, shipped)
        held, docs_seen, terms_seen = Counter(), 0, 0
        for batch in batches:
            for some in hashing.slices(batch):
                for text in some.column("text").to_pylist():
                    guarded = normal(text)
                    n = n_terms(guarded)
                    docs_seen, terms_seen = docs_seen + (n > 0), terms_seen + n
                    held.update(shard.counts(guarded).keys())
        found = [(-1, docs_seen), (-2, terms_seen), *sorted(held.items())]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["term", "n"])

    return docs.select("text").mapInArrow(scan, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def best(docs: DataFrame, name: str, shipped: Broadcast, weights: Broadcast, n_docs: int, n_all: int, limit: int) -> DataFrame:
    """(item, doc_id, score): of each task the ``limit`` best documents of each item of the shard."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, weight_of = _mine(name, shipped), weights.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        floor = np.ones(shard.items, np.int64)  # what a score must reach to matter: above 0, then the last of ``limit``

        def cut() -> None:
            item, doc, score = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, -score, item))
            item, doc, score = item[order], doc[order], score[order]
            begin = np.searchsorted(item, np.arange(shard.items + 1))
            rank = np.arange(len(item)) - begin[item]
            full = np.flatnonzero(rank == limit - 1)
            floor[item[full]] = score[full]
            kept = rank < limit
            held[:] = [(item[kept], doc[kept], score[kept])]

        size = 0
        for batch in batches:
            for some in hashing.slices(batch):
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    guarded = normal(text)
                    found = shard.counts(guarded)
                    if not found:
                        continue
                    m = 12 * (75 + 25 * n_terms(guarded) * n_docs // n_all)
                    term = np.fromiter(found.keys(), np.int64, len(found))
                    each = weight_of[term] * np.array([1_000_000_000 * tf // (1000 * tf + m) for tf in found.values()], np.int64)
                    first, number = shard.first[term], shard.first[term + 1] - shard.first[term]
                    pair = np.arange(number.sum()) + np.repeat(first - np.cumsum(number) + number, number)
                    score = np.zeros(shard.items, np.int64)
                    np.add.at(score, shard.item[pair], np.repeat(each, number) * shard.times[pair])
                    item = np.flatnonzero(score >= floor)
                    if len(item):
                        held.append((item, np.full(len(item), _NO_ID if doc_id is None else doc_id, np.int64), score[item]))
                        size += len(item)
                        if size > HELD:
                            cut()
                            size = len(held[0][0])
        if held:
            cut()
            item, doc, score = held[0]
            yield pa.RecordBatch.from_arrays([pa.array(shard.rows[item]), pa.array(doc, mask=doc == _NO_ID), pa.array(score)], ["row", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scan, "row long, doc_id long, score long")


def sharded(items: DataFrame) -> tuple[DataFrame, int]:
    """Rows of (row, text) with their shard, and the number of shards: as many as are needed for the bounds to hold."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    n = 1
    while True:
        out = items.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n)))
        sums = out.groupBy("shard").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.sum(F.ceil(size / 2)).alias("terms"))
        if not sums.filter((F.col("n") > 1) & ((F.col("bytes") > SHARD_BYTES) | (F.col("terms") > SHARD_TERMS))).limit(1).count():
            return out, n
        n *= 2


def rank(docs: DataFrame, items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """item_id, rank, doc_id, score: the ``limit`` documents of (doc_id, text, ...) with the highest score above 0 for each row of items (item_id, text, ...).

    Equal scores go by doc_id, nulls last. A null or empty text has no terms, so it finds nothing and is not found, nor counted.
    A repeated document is ranked as a row of its own, a repeated item is answered again. Texts of any length are
    read whole; a table without rows gives none; columns by other names are not read.
    """
    sc = docs.sparkSession.sparkContext
    docs = common.fresh(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = common.fresh(items, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked, n = sharded(common.written(asked.withColumn("row", F.monotonically_increasing_id()), "items"))
    found = []
    for k in range(n):
        rows = asked.filter(F.col("shard") == k).select("row", "text").orderBy("row").collect()  # SHARD_BYTES at most, or one item
        if not rows:
            continue
        shard = Shard([r.row for r in rows], [r.text for r in rows])
        name, shipped = uuid.uuid4().hex, sc.broadcast(shard)
        seen = dict(map(tuple, statistics(docs, name, shipped).collect()))  # a number for each term of the shard
        n_docs, n_all = seen.pop(-1, 0), seen.pop(-2, 0)
        weights = sc.broadcast(np.array([weight(n_docs, seen.get(i, 0)) for i in range(len(shard.terms))], np.int64))
        found.append(best(docs, name, shipped, weights, n_docs, n_all, limit))
    if not found:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = W.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return top.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return rank(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""WITH words AS MATERIALIZED (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_all FROM docs),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs),
parts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_all))) AS part FROM tf JOIN weights USING (term), total),
scores AS (SELECT item_id, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY ALL HAVING sum(times * part) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20"""


