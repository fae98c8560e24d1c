"""BM25 in two scans of the documents: one counts in how many of them each term stands, the other scores.

The queries' terms go to the workers; a document is scored where it is read, against all queries that ask for its
terms, so neither its terms nor its scores are exchanged. Queries come in shards of SHARD_TERMS terms and
SHARD_QUERIES queries, each with scans of its own. Rows with one key are one document, which takes an exchange: only
keys that occur more than once go that way, with the counts of their terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ascii_tokens

#: Pairs of a query and one of its terms, and queries, that a worker holds at once.
SHARD_TERMS, SHARD_QUERIES = 500_000, 20_000
#: Keys up to this many are broadcast to the documents.
BROADCAST_KEYS = 500_000
#: Tokens that are looked up at once, and sums that a worker holds at once.
LOOKED_UP, CELLS = 250_000, 500_000
#: Scores that a task holds before it drops those that are not among a query's best.
HELD = 400_000


class Asked:
    """The terms of some queries, and which queries ask for each: those of term i are query[first[i] : first[i + 1]]."""

    def __init__(self, pairs: pa.Table) -> None:
        term, query = (pairs.column(c).combine_chunks().dictionary_encode("encode") for c in ("term", "query_id"))
        self.terms, self.ids = term.dictionary, query.dictionary
        term, query = term.indices.to_numpy(), query.indices.to_numpy().astype(np.int64)
        order = np.lexsort((query, term))
        self.query, self.first = query[order], np.searchsorted(term[order], np.arange(len(self.terms) + 1))

    def occurrences(self, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The length of each list; (row, term, times) of the tokens that are terms, by row and term."""
        length = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
        flat = tokens.flatten()
        number = pc.fill_null(pc.index_in(flat, value_set=self.terms.cast(flat.type)), -1).to_numpy()
        known = np.flatnonzero(number >= 0)
        row = np.repeat(np.arange(len(length)), length)[known]
        at, times = np.unique(row * len(self.terms) + number[known], return_counts=True)
        return length, at // len(self.terms), at % len(self.terms), times


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about LOOKED_UP tokens."""
    total = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy().astype(np.int64))
    for begin, end in _runs(total // LOOKED_UP):
        yield batch.slice(begin, end - begin)


def _runs(of: np.ndarray) -> list[tuple[int, int]]:
    """The runs of equal values."""
    edge = np.flatnonzero(np.diff(of)) + 1
    return list(zip([0, *edge.tolist()], [*edge.tolist(), len(of)], strict=True)) if len(of) else []


def _statistics(docs: DataFrame, shipped: Broadcast) -> DataFrame:
    """(term, n): documents that hold each term; at -1 all of them, at -2 those with a text, at -3 their tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        held, seen = np.zeros(len(asked.terms), np.int64), np.zeros(3, np.int64)
        for batch in batches:
            for some in _slices(batch):
                tokens = some.column("tokens")
                length, _, term, _ = asked.occurrences(tokens)
                held += np.bincount(term, minlength=len(held))
                seen += (len(tokens), len(tokens) - tokens.null_count, length.sum())
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1, -2, -3], some))), pa.array(np.concatenate((seen, held[some])))], ["term", "n"])

    return docs.select("tokens").mapInArrow(scan, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Halves go up; nothing is below 0."""
    x = x * 10**digits
    whole = np.floor(x)
    return (whole + (x - whole >= 0.5)) / 10**digits


class Best:
    """The k best of each query, by score and key; a null key is the least."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.held, self.size, self.most = k, [], 0, max(HELD, 2 * k * queries)
        self.floor = np.zeros(queries)  # what a score must reach to matter

    def add(self, query: np.ndarray, score: np.ndarray, row: np.ndarray, key: pa.Array) -> None:
        good = np.flatnonzero(score >= self.floor[query])
        if len(good):
            self.held.append(pa.table({"query": query[good], "score": score[good], "key": key.take(pa.array(row[good]))}))
            self.size += len(good)
        if self.size > self.most:
            self.cut()

    def cut(self) -> pa.Table:
        table = pa.concat_tables(self.held)
        table = table.take(pc.sort_indices(table, [("query", "ascending"), ("score", "descending"), ("key", "ascending")], null_placement="at_start"))
        query, score = table.column("query").to_numpy(), table.column("score").to_numpy()
        rank = np.arange(len(query)) - np.searchsorted(query, np.arange(len(self.floor)))[query]
        last = rank == self.k - 1
        self.floor[query[last]] = score[last]
        table = table.filter(pa.array(rank < self.k))
        self.held, self.size = [table], table.num_rows
        return table


def _scores(docs: DataFrame, shipped: Broadcast, weights: Broadcast, mean: float, k1: float, b: float, k: int | None, kinds: T.StructType) -> DataFrame:
    """(query_id, key, score) of each document and query with a term in common; with ``k`` those of each task's k best of a query."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, idf = shipped.value, weights.value
        n, fan = len(asked.ids), np.diff(asked.first)
        best = None if k is None else Best(n, k)
        answer = lambda query, key, score: pa.RecordBatch.from_arrays([asked.ids.take(pa.array(query)), key, pa.array(score)], names=kinds.names)
        for batch in batches:
            for some in _slices(batch):
                key = some.column(0)
                length, row, term, tf = asked.occurrences(some.column("tokens"))
                weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / mean))
                for begin, end in _runs(np.cumsum(np.bincount(row, fan[term], len(length)) + n) // CELLS):
                    mine = slice(*np.searchsorted(row, (begin, end)))
                    times = fan[term[mine]]
                    pair = np.arange(times.sum()) + np.repeat(asked.first[term[mine]] - np.cumsum(times) + times, times)
                    sums = np.bincount(np.repeat((row[mine] - begin) * n, times) + asked.query[pair], np.repeat(weight[mine], times), (end - begin) * n)
                    cell = np.flatnonzero(sums)
                    if not len(cell):
                        continue
                    query, at, score = cell % n, begin + cell // n, _rounded(sums[cell])
                    if best:
                        best.add(query, score, at, key)
                    else:
                        yield answer(query, key.take(pa.array(at)), score)
        if best and best.held:
            for found in best.cut().combine_chunks().to_batches():
                yield answer(found.column("query").to_numpy(), found.column("key"), found.column("score").to_numpy())

    return docs.mapInArrow(scan, kinds)


def _postings(docs: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """(term, key, len, tf) by exchange: rows of one key and length are one document."""
    each = docs.select(key, F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    return each.join(F.broadcast(wanted), "term").groupBy("term", key, "len").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, k1: float = 1.2, b: float = 0.75, k: int | None = None) -> DataFrame:
    """(query_id, key, score) of (query_id, terms); the textbook weights.

    With ``k`` rows that are not among the k best of a query, by score and key, may be missing, so that top_k() gets
    few rows from each task. A null text is a document that has no length.
    """
    docs = docs.select(key, text)
    terms = queries.select("query_id", F.explode("terms").alias("term")).filter("term IS NOT NULL").distinct()
    n_pairs, n_queries = terms.select(F.count("*"), F.count_distinct(F.struct("query_id"))).first()
    n_shards = max(1, -(-n_pairs // SHARD_TERMS), -(-n_queries // SHARD_QUERIES))
    again = docs.groupBy(key).count().filter("count > 1").select(F.col(key).alias("_again"))
    n_again = again.limit(BROADCAST_KEYS + 1).count()
    once, shared = docs, None
    if n_again > BROADCAST_KEYS:
        once, shared = None, docs
    elif n_again:
        same = docs[key].eqNullSafe(again["_again"])
        once, shared = docs.join(F.broadcast(again), same, "left_anti"), docs.join(F.broadcast(again), same, "left_semi")
    tokenised = lambda df: df and df.select(key, ascii_tokens(text, 2).alias("tokens"))
    once, shared = tokenised(once), tokenised(shared)
    kinds = T.StructType([T.StructField("query_id", terms.schema["query_id"].dataType), T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType())])
    found = docs.sparkSession.createDataFrame([], kinds)
    for shard in range(n_shards):
        mine = terms if n_shards == 1 else terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_shards)) == shard)
        found = found.unionByName(_shard(once, shared, mine, key, k1, b, k, kinds))
    return found


def _shard(once: DataFrame | None, shared: DataFrame | None, terms: DataFrame, key: str, k1: float, b: float, k: int | None, kinds: T.StructType) -> DataFrame:
    """The scores of one shard's queries; ``once`` are the documents whose key no other has, ``shared`` the others."""
    spark = terms.sparkSession
    asked = Asked(terms.toArrow())
    shipped = spark.sparkContext.broadcast(asked)
    n_docs = n_texts = n_tokens = 0
    held = np.zeros(len(asked.terms), np.int64)
    if once is not None:
        seen = dict(map(tuple, _statistics(once, shipped).collect()))  # a number for each term of the shard
        n_docs, n_texts, n_tokens = (seen.pop(i, 0) for i in (-1, -2, -3))
        held[list(seen)] = list(seen.values())
    if shared is not None:
        numbered = spark.createDataFrame(pa.table({"term": asked.terms, "number": np.arange(len(held))}))
        postings = _postings(shared, key, numbered.select("term"))
        more = shared.agg(F.count("*"), F.count("tokens"), F.coalesce(F.sum(F.when(F.col("tokens").isNotNull(), F.size("tokens"))), F.lit(0))).first()
        n_docs, n_texts, n_tokens = n_docs + more[0], n_texts + more[1], n_tokens + more[2]
        for number, n in postings.groupBy("term").agg(F.count("*").alias("n")).join(numbered, "term").select("number", "n").collect():
            held[number] += n
    idf, mean = np.log(1 + (n_docs - held + 0.5) / (held + 0.5)), n_tokens / max(1, n_texts) or 1.0
    parts = []
    if once is not None:
        parts.append(_scores(once, shipped, spark.sparkContext.broadcast(idf), mean, k1, b, k, kinds))
    if shared is not None:
        weights = spark.createDataFrame(pa.table({"term": asked.terms, "idf": idf}))
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
        parts.append(postings.join(F.broadcast(weights), "term").join(terms, "term").groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
