"""Approximate nearest neighbours in learned partitions.

On a bounded sample (the SAMPLE vectors with the least hashes) a graph of nearest neighbours is built and cut
into equal parts by recursive bisection. A small neural classifier learns the parts of each vector's
neighbours. Every row is indexed in its likeliest part; a query goes to its ``probes`` likeliest, so many that
for vectors of the sample that were held out of graph and classifier they hold RECALL of the true neighbours, and
is compared exactly with all that is there. How few probes do depends on the vectors: a few where they lie in
clusters, nearly all where they lie alike in all directions of a space with many.

Equal vectors are one candidate with its K + 1 least ids, more can't be among K nearest; equal queries are one
query. Vectors lie in LANES lanes, a small part in one and a large one in several; queries of like parts make up a
round. A round's queries wait in a task for each lane while the vectors of the parts that they probe stream by, and
leave it with their K + 1 nearest there: at most LANES times so many rows for each query, however many parts it probes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

K, SAMPLE, GRAPH, HIDDEN, PART_ROWS, MAX_PARTS, BLOCK, RECALL = 10, 4096, 10, 128, 125, 256, 4000, 0.95
#: The share of the sample on which probes are chosen.
HELD_OUT = 0.25
#: Lanes of the vectors, components of all queries in a round, pairs compared at once.
LANES, ROUND, PAIRS = 16, 1 << 21, 1 << 18


def nearest(x: np.ndarray, k: int, of: np.ndarray | None = None) -> np.ndarray:
    """The k nearest other rows of each row of ``x`` with a number in ``of`` (all by default)."""
    of = np.arange(len(x)) if of is None else of
    norms, out = (x * x).sum(1), np.empty((len(of), k), np.int64)
    for at in range(0, len(of), 512):
        own = of[at : at + 512]
        d = norms[None, :] - 2 * (x[own] @ x.T)
        d[np.arange(len(d)), own] = np.inf
        out[at : at + len(d)] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def bisected(nodes: np.ndarray, edges: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each of ``nodes``, all of one size but for one node, that cuts few of ``edges`` (pairs of places in nodes)."""
    n = len(nodes)
    if parts == 1:
        return np.zeros(n, np.int64)
    a, b = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    v = rng.standard_normal(n)
    for _ in range(60):  # towards the second eigenvector of the random walk
        v = v - (v * degree).sum() / degree.sum()
        v = 0.5 * v + 0.5 * np.bincount(a, v[b], n) / degree
        v = v / max(np.linalg.norm(v), 1e-12)
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(10):  # swap the pairs that gain most
        gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), n)
        left, right = (np.flatnonzero(side == s) for s in (False, True))
        left, right = (x[np.argsort(-gain[x], kind="stable")] for x in (left, right))
        m = min(len(left), len(right))
        good = np.flatnonzero(gain[left[:m]] + gain[right[:m]] > 2)[: max(1, n // 20)]
        if not len(good):
            break
        side[left[good]], side[right[good]] = True, False
    out = np.zeros(n, np.int64)
    for s, base in ((False, 0), (True, parts // 2)):
        own = np.flatnonzero(side == s)
        place = np.full(n, -1)
        place[own] = np.arange(len(own))
        inner = place[edges]
        out[own] = base + bisected(nodes[own], inner[(inner >= 0).all(1)], parts // 2, rng)
    return out


def scores(model: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, scale, w1, b1, w2, b2 = model
    return np.maximum((x - mean) / scale @ w1 + b1, 0) @ w2 + b2


def fit(x: np.ndarray, parts: int, recall: float = RECALL) -> tuple[list[np.ndarray], int]:
    """The classifier of ``parts`` parts (a power of two) and the number of probes."""
    rng = np.random.default_rng(7)
    every = x.astype(np.float32)
    held = rng.permutation(len(every))[: int(HELD_OUT * len(every))]
    x = np.delete(every, held, axis=0)
    k = min(GRAPH, len(x) - 1)
    near = nearest(x, k)
    edges = np.stack([np.repeat(np.arange(len(x)), k), near.reshape(-1)], 1)
    part = bisected(np.arange(len(x)), edges, parts, rng)
    target = np.zeros((len(x), parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(len(x)), k + 1), part[np.c_[np.arange(len(x)), near]].reshape(-1)), 1 / (k + 1))
    mean, scale = x.mean(0), x.std() + np.float32(1e-9)
    z = (x - mean) / scale
    weights = [rng.standard_normal((x.shape[1], HIDDEN)).astype(np.float32) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN, np.float32), rng.standard_normal((HIDDEN, parts)).astype(np.float32) * np.sqrt(1 / HIDDEN), np.zeros(parts, np.float32)]
    weights = [w.astype(np.float32) for w in weights]
    first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(40):  # Adam on the cross entropy
        for own in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(z[own] @ weights[0] + weights[1], 0)
            o = h @ weights[2] + weights[3]
            p = np.exp(o - o.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - target[own]) / len(own)
            dh = (d @ weights[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((z[own].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - np.float32(0.003) * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    model = [mean, scale, *weights]
    order = np.argsort(-scores(model, every), axis=1, kind="stable")
    home, rank = order[:, 0], np.argsort(order[held], axis=1)
    near = nearest(every, k, held)
    needed = np.sort(rank[np.repeat(np.arange(len(held)), k), home[near.reshape(-1)]])  # how far down the list the neighbours' parts are
    return model, int(needed[min(len(needed) - 1, int(recall * len(needed)))]) + 1


def _likeliest(model: list[np.ndarray] | None, frame: pd.DataFrame, n: int) -> np.ndarray:
    """The ``n`` likeliest parts of each row."""
    if model is None:
        return np.zeros((len(frame), 1), np.int32)
    s = scores(model, np.stack(frame["embedding"].to_numpy()).astype(np.float32))
    return np.argsort(-s, axis=1, kind="stable")[:, :n].astype(np.int32)


def _homes(model: list[np.ndarray] | None):
    def homes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(part=_likeliest(model, frame, 1)[:, 0])

    return homes


def _probes(model: list[np.ndarray] | None, n: int, lanes: np.ndarray):
    """Adds ``home``, the likeliest part, ``probed``, a bit for each part, and the ``lanes`` (a row of marks for each part) of the ``n`` likeliest."""

    def probes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            likeliest = _likeliest(model, frame, n)
            probed = np.zeros((len(frame), len(lanes)), bool)
            np.put_along_axis(probed, likeliest.astype(np.int64), True, axis=1)
            where = probed.astype(np.float32) @ lanes.astype(np.float32) > 0
            yield frame.assign(home=likeliest[:, 0], lanes=[np.flatnonzero(w).astype(np.int32) for w in where], probed=[b.tobytes() for b in np.packbits(probed, axis=1)])

    return probes


def _bits(probed: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(probed), np.uint8).reshape(len(probed), -1), axis=1).astype(bool)


def _met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The parts that queries of each round probe."""
    for frame in frames:
        for number, probed in frame.groupby("round")["probed"]:
            parts = np.flatnonzero(_bits(probed.tolist()).any(0))
            yield pd.DataFrame({"part": parts.astype(np.int32), "round": np.full(len(parts), number, np.int32)})


def _components(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)


class _Round:
    """The queries of a round, and the ``k`` nearest of each among the vectors that have streamed by."""

    def __init__(self, k: int):
        self.k, self.asked, self.y = k, [], None

    def ask(self, rows: pa.RecordBatch) -> None:
        self.asked.append(rows)

    def _begin(self) -> None:
        self.q = np.concatenate([r.column("ids").flatten().to_numpy(zero_copy_only=False) for r in self.asked])
        self.probed = np.concatenate([_bits(r.column("probed").to_pylist()) for r in self.asked])
        self.y, self.asked = np.concatenate([_components(r) for r in self.asked]), []
        self.norms = (self.y * self.y).sum(1)
        self.score, self.id = np.full((len(self.q), self.k), np.inf), np.full((len(self.q), self.k), np.iinfo(np.int64).max)

    def meet(self, part: int, rows: pa.RecordBatch) -> None:
        if self.y is None:
            self._begin()
        x, queries = _components(rows), np.flatnonzero(self.probed[:, part])
        norms, column = (x * x).sum(1), rows.column("ids")
        ids, first = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
        step = max(1, PAIRS // len(x))
        for at in range(0, len(queries), step):
            own = queries[at : at + step]
            d = norms[None, :] - 2 * (self.y[own] @ x.T)
            slack = 1e-9 * (norms.max() + self.norms[own] + 1)
            edge = self.score[own, -1] ** 2 - self.norms[own] + slack
            near = ~(d > edge[:, None])  # what overflows is compared, too
            if near.sum() > 4 * self.k * len(own) and len(x) > self.k:
                near &= ~(d > (np.partition(d, self.k - 1, axis=1)[:, self.k - 1] + slack)[:, None])
            a, b = np.nonzero(near)
            true = np.empty(len(a))
            for i in range(0, len(a), 1 << 14):
                true[i : i + (1 << 14)] = np.sqrt(((x[b[i : i + (1 << 14)]] - self.y[own[a[i : i + (1 << 14)]]]) ** 2).sum(1))
            self._keep(own[a], true, ids, first[b], first[b + 1] - first[b])

    def _keep(self, queries: np.ndarray, true: np.ndarray, ids: np.ndarray, first: np.ndarray, copies: np.ndarray) -> None:
        """Each query's least (score, id) of those it has and the new ones."""
        if not len(queries):
            return
        changed, k = np.unique(queries), self.k
        place = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        q = np.r_[np.repeat(changed, k), np.repeat(queries, copies)]
        score = np.r_[self.score[changed].reshape(-1), np.repeat(true, copies)]
        number = np.r_[self.id[changed].reshape(-1), ids[np.repeat(first, copies) + place]]
        order = np.lexsort((number, score, q))
        q, score, number = q[order], score[order], number[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < k
        self.score[q[kept], rank[kept]], self.id[q[kept], rank[kept]] = score[kept], number[kept]

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.y is not None:
            a, b = np.nonzero(np.isfinite(self.score) | (self.id < np.iinfo(np.int64).max))
            yield pa.RecordBatch.from_arrays([pa.array(self.q[a]), pa.array(self.id[a, b]), pa.array(self.score[a, b])], names=["q", "vec_id", "score"])


def _streamed(k: int):
    """The ``k`` nearest of each round's queries in a lane; the queries (part -1) come before the vectors, part by part."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, _Round(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("round", "lane", "part")], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if key != tuple(at[start, :2]):
                    yield from own.found()
                    key, own = tuple(at[start, :2]), _Round(k)
                if at[start, 2] < 0:
                    own.ask(batch.slice(start, end - start))
                    continue
                for first in range(start, end, BLOCK):
                    own.meet(int(at[start, 2]), batch.slice(first, min(BLOCK, end - first)))
        yield from own.found()

    return streamed


def search(vectors: DataFrame, queries: DataFrame, k: int = K, part_rows: int = PART_ROWS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row of ``queries``, among ``vectors`` (both vec_id, embedding).

    Euclidean distance in double precision on the vectors as they are; ties to the smaller vec_id; a row with the query's vec_id is its
    own. Null vectors, zero ones, ones with null, NaN or infinite components, ones without id, and ones that
    aren't as long as most take no part; a repeated row counts once.
    """
    spark = vectors.sparkSession
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).filter(ok)
    rows = clean(vectors)
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows, asked = (df.filter(F.size("embedding") == (length.d if length else 0)) for df in (rows, clean(queries)))
    least = W.partitionBy("embedding").orderBy("vec_id")
    distinct = rows.withColumn("_r", F.dense_rank().over(least)).filter(F.col("_r") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    distinct = common.written(distinct, "vectors")
    n = distinct.count()
    parts = 1 << max(0, int(np.log2(max(1, min(MAX_PARTS, n / part_rows)))))
    model, probes = None, 1
    if parts > 1:
        some = distinct.orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).select("embedding").collect()
        model, probes = fit(np.array([r.embedding for r in some], np.float32), parts, recall)
    indexed = common.written(distinct.mapInPandas(_homes(model), f"embedding {kind}, ids array<long>, part int"), "index")
    sizes = {r.part: r["count"] for r in indexed.groupBy("part").count().collect()}
    blocks = [min(LANES, max(1, -(-sizes.get(p, 0) // BLOCK))) for p in range(parts)]
    lanes = np.array([[(lane - p) % LANES < b for lane in range(LANES)] for p, b in enumerate(blocks)])
    asked = common.written(asked.distinct(), "queries")
    one = common.written(asked.select("embedding").distinct().withColumn("q", F.monotonically_increasing_id()), "asked")
    routed = common.written(one.mapInPandas(_probes(model, probes, lanes), f"embedding {kind}, q long, home int, lanes array<int>, probed binary"), "routed")
    # queries in the order of their likeliest parts, cut into rounds of one size
    homes = {r.home: r["count"] for r in routed.groupBy("home").count().collect()}
    counts = [homes.get(p, 0) for p in range(parts)]
    of = lambda values, at: F.lit(values)[F.col(at)]
    place = of([int(b) for b in np.cumsum([0, *counts[:-1]])], "home") + F.pmod(F.xxhash64("q"), of([max(1, c) for c in counts], "home"))
    routed = routed.withColumn("round", F.floor(place / max(1, ROUND // (length.d if length else 1))).cast("int"))
    met = F.broadcast(routed.select("round", "probed").mapInPandas(_met, "part int, round int").distinct())
    lane = F.pmod(F.col("part") + F.pmod(F.xxhash64("embedding"), of(blocks, "part")), F.lit(LANES)).cast("int")
    vectors = indexed.join(met, "part").select("round", lane.alias("lane"), "part", "embedding", "ids", F.lit(None).cast("binary").alias("probed"))
    waiting = routed.select("round", F.explode("lanes").alias("lane"), F.lit(-1).alias("part"), "embedding", F.array("q").alias("ids"), "probed")
    streams = waiting.unionByName(vectors).repartition("round", "lane").sortWithinPartitions("round", "lane", "part")
    found = streams.mapInArrow(_streamed(k + 1), "q long, vec_id long, score double")
    best = found.withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy("score", "vec_id"))).filter(F.col("_r") <= k + 1).drop("_r")
    own = asked.join(one, "embedding").select(F.col("vec_id").alias("query_id"), "q")
    out = own.join(best, "q").filter("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each vector whose id is divisible by 100, among all others."""
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.filter("vec_id % 100 = 0"))
