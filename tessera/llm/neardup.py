"""Near-duplicate documents by DartMinHash signatures, banded joins and exact verification.

A document is the set of its shingles (runs of five words; all its words if there are fewer), each with a
weight of one however often it occurs, so that signatures estimate the similarity that is verified. Darts are
thrown on the plane of weight and rank of each shingle: the plane is cut along the weight into regions [0, 1), [1, 2), [2, 4), ...; in a region darts
fall in order of rank, at exponential distances, all from hashes of the shingle, the region and the number of
the dart. A dart counts if its weight lies below the shingle's; so many ranks are looked at that each of the
signature's coordinates is hit, and each keeps its earliest dart. Work is the number of shingles plus that of
darts. Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.

Documents that agree in a band meet in a bucket. No bucket is compared pair by pair: a leader, the member that
meets most others in all its buckets, is compared with the rest by exact Jaccard similarity of shingle sets. This
goes on with other leaders for ROUNDS rounds; leaders, and buckets whose members are all joined, leave. The
members of buckets that are still mixed, texts that are nearly but not quite alike, are compared exactly in blocks
of BLOCK, within the groups that such buckets connect. Links become classes by star
contraction of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, ROUNDS, BLOCK = 25, 5, 2, 400


def shingles(words: hashing.Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted."""
    at, h = words.grams(n)
    row = words.row[at]
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    whole = hashing.mix(hashing.spans(hashing.mix(words.hash, 9), words.first[short], words.first[short + 1]), 9)
    row, h = np.r_[row, short], np.r_[h, whole]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
    return row[first], h[first]


def darts(row: np.ndarray, element: np.ndarray, weight: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, rank, dart) of the darts below each element's weight with a rank below the row's reach."""
    found = []
    low, region = 0.0, 0
    while len(element := element[heavy := weight > low]):
        row, weight = row[heavy], weight[heavy]
        width = max(low, 1.0)
        live, rank, turn = np.arange(len(element)), np.zeros(len(element)), 0
        while len(live):
            seed = (region << 32) + 3 * turn
            rank = rank - np.log(hashing.uniform(hashing.mix(element[live], seed))) / width
            near = rank < reach[row[live]]
            live, rank = live[near], rank[near]
            dart = hashing.mix(element[live], seed + 1)
            hit = low + width * hashing.uniform(hashing.mix(dart, 2)) < weight[live]
            found.append((row[live[hit]], rank[hit], dart[hit]))
            turn += 1
        low, region = low + width, region + 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """(n, size) earliest darts; the rows of documents without elements are 0."""
    out = np.zeros((n, size), np.uint64)
    total = np.bincount(row, weight, n)
    wanted = total > 0
    scale = size * (np.log(size) + 3)
    while wanted.any():
        use = wanted[row]
        r, rank, dart = darts(row[use], element[use], weight[use], np.divide(scale, total, out=np.zeros(n), where=total > 0))
        cell = r * size + (hashing.mix(dart, 5) % np.uint64(size)).astype(np.int64)
        order = np.lexsort((rank, cell))
        cell, dart = cell[order], dart[order]
        first = np.flatnonzero(np.r_[True, np.diff(cell) != 0])
        out.reshape(-1)[cell[first]] = dart[first]
        full = np.bincount(cell[first] // size, minlength=n) == size
        wanted &= ~full
        scale *= 2
    return out


def _bands(bands: int, rows: int):
    kind = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("size", pa.int32()), ("bands", pa.list_(pa.int64()))])

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in hashing.slices(batch):
                row, h = shingles(hashing.Words(some.column("text")))
                n = some.num_rows
                signed = signatures(row, h, np.ones(len(h)), n, bands * rows).reshape(n * bands, rows)
                keys = hashing.spans(hashing.mix(signed.reshape(-1), 6), np.arange(n * bands) * rows, (np.arange(n * bands) + 1) * rows)
                keys = hashing.mix(keys + np.tile(np.arange(bands, dtype=np.uint64), n), 7)
                has = np.zeros(n, bool)
                has[row] = True
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(has, bands, 0))], pa.int32()), pa.array(keys.reshape(n, bands)[has].reshape(-1).view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("node"), pa.array(np.bincount(row, minlength=n), pa.int32()), lists], schema=kind)

    return banded


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in hashing.slices(batch):
            row, h = shingles(hashing.Words(some.column("text")))
            cuts = np.searchsorted(row, np.arange(some.num_rows + 1))
            yield pa.RecordBatch.from_arrays([some.column("node"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(h.view(np.int64), pa.int64()))], ["node", "set"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those (a, b) whose sets have that Jaccard similarity or more."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    na, nb = F.size("sa"), F.size("sb")
    both = both.filter((F.least(na, nb) >= similarity * F.greatest(na, nb) - 1e-9)).withColumn("m", F.size(F.array_intersect("sa", "sb")))
    return both.filter(F.col("m") >= similarity * (na + nb - F.col("m")) - 1e-9).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's connected component, for the nodes of (a, b).

    Large-star and small-star steps in turn; each writes its edges, so no lineage grows. Stars form after a
    number of rounds that grows with the logarithm of the component.
    """
    pairs = common.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        small = common.written(small, "small-star")
        # stars: a node with a neighbour below has one, and none below that
        roles = small.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(small.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        roles = roles.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if roles.filter("below > 1 or (below = 1 and above = 1)").count() == 0:
            return small.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        pairs = small


def joined_to(found: DataFrame) -> DataFrame:
    """(node, la): for each node of verified (a, b) the least node that it is known to be joined to, itself included."""
    both = found.select(F.col("b").alias("node"), F.least("a", "b").alias("la")).unionByName(found.select(F.col("a").alias("node"), F.least("a", "b").alias("la")))
    return both.groupBy("node").agg(F.min("la").alias("la"))


def mixed_buckets(bucket: DataFrame, label: DataFrame) -> DataFrame:
    """The rows of those buckets whose members aren't all joined."""
    told = bucket.join(label, "node", "left").withColumn("la", F.coalesce("la", "node"))
    mixed = told.groupBy("bucket").agg(F.min("la").alias("x"), F.max("la").alias("y")).filter("x <> y").select("bucket")
    return bucket.join(mixed, "bucket", "left_semi")


def links(docs: DataFrame, nodes: DataFrame, similarity: float, rounds: int) -> DataFrame:
    """Verified (a, b) of (node, least, size, bands); ``docs`` has their (doc_id, node, text)."""
    placed = nodes.select("node", "least", "size", F.explode("bands").alias("bucket"))
    size = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    bucket = common.written(placed.join(size, "bucket"), "buckets")
    wanted = bucket.select("node", "least").distinct()
    texts = docs.join(wanted.select("node", F.col("least").alias("doc_id")), ["node", "doc_id"], "left_semi")
    null_ids = docs.filter(F.col("doc_id").isNull()).join(wanted.filter(F.col("least").isNull()), "node", "left_semi")
    sets = texts.unionByName(null_ids).select("node", "text").mapInArrow(_sets, "node binary, set array<bigint>").dropDuplicates(["node"])
    sets = common.written(sets, "sets")
    found, turn = None, 0
    while not bucket.isEmpty() and turn < rounds:
        # the leader is the member that meets most others: the text that copies were made from meets all of them
        sized = bucket.join(bucket.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
        meets = sized.groupBy("node").agg(F.sum("n").alias("meets"))
        order = F.struct((-F.col("meets")).alias("meets"), "least", "node", "size")
        leader = bucket.join(meets, "node").groupBy("bucket").agg(F.min(order).alias("first")).select("bucket", F.col("first.node").alias("a"), F.col("first.size").alias("a_size"))
        led = common.written(bucket.join(leader, "bucket").filter("node <> a"), "led")
        alike = F.least("size", "a_size") >= similarity * F.greatest("size", "a_size") - 1e-9  # no set is alike to one that is much larger
        pairs = led.filter(alike).select("a", F.col("node").alias("b")).distinct()
        if found is not None:
            pairs = pairs.join(label.select(F.col("node").alias("a"), F.col("la").alias("x")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("la").alias("y")), "b", "left")
            pairs = pairs.filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")
        new = common.written(verified(pairs, sets, similarity), "links")
        found = new if found is None else found.unionByName(new)
        label = joined_to(found)
        bucket, turn = common.written(mixed_buckets(led.drop("a", "a_size"), label), "buckets"), turn + 1
    if found is None or bucket.isEmpty():
        return found if found is not None else bucket.select(F.col("node").alias("a"), F.col("node").alias("b"))
    label = components(found).withColumnRenamed("label", "la")
    bucket = common.written(mixed_buckets(bucket, label), "buckets")
    if bucket.isEmpty():
        return found
    group = components(bucket.join(bucket.groupBy("bucket").agg(F.min("node").alias("a")), "bucket").select("a", F.col("node").alias("b"))).withColumnRenamed("label", "group")
    rest = sets.join(group, "node").join(label, "node", "left").withColumn("la", F.coalesce("la", "node"))
    return found.unionByName(common.written(in_blocks(common.written(rest, "rest"), similarity), "links"))


def in_blocks(rest: DataFrame, similarity: float) -> DataFrame:
    """(a, b) with that similarity or more in one ``group`` of (node, group, la, set), with different ``la``: each block of nodes against each other block.

    Of the links of one node to the nodes of one la the first is returned. A task holds two blocks.
    """
    size = rest.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rest.join(size, "group").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "la", "set")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame.own == frame.i.iat[0]], frame[frame.own == frame.j.iat[0]]
        sides = []
        for f in (left, right):
            lengths = f["set"].map(len).to_numpy()
            sides.append((np.repeat(np.arange(len(f)), lengths), np.concatenate([np.asarray(x, np.int64) for x in f["set"]] or [np.zeros(0, np.int64)]), lengths))
        shared = np.intersect1d(sides[0][1], sides[1][1])
        both = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, len(shared), 4096):
            part = []
            for (row, h, _), n in zip(sides, both.shape, strict=True):
                m, k = np.zeros((n, 4096), np.float32), np.searchsorted(shared[at : at + 4096], h)
                hit = np.flatnonzero((k < len(shared[at : at + 4096])) & (shared[at + np.minimum(k, len(shared) - at - 1)] == h))
                m[row[hit], k[hit]] = 1
                part.append(m)
            both += part[0] @ part[1].T
        x, y = np.nonzero(both >= similarity * (sides[0][2][:, None] + sides[1][2][None, :] - both) - 1e-6)
        out = pd.DataFrame({"a": left["node"].to_numpy()[x], "b": right["node"].to_numpy()[y], "x": left["la"].to_numpy()[x], "y": right["la"].to_numpy()[y]})
        return out[out.x != out.y].drop_duplicates(["a", "y"])[["a", "b"]]

    return dealt.groupBy("group", "i", "j").applyInPandas(compare, "a binary, b binary").distinct()


def classes(rows: DataFrame, similarity: float, bands: int, per_band: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes) of (doc_id, text, node): (doc_id, node) of each row, and (node, least, label) of each text."""
    signed = common.written(rows.select("doc_id", "node", "text").mapInArrow(_bands(bands, per_band), "doc_id long, node binary, size int, bands array<bigint>"), "signatures")
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = common.written(nodes, "nodes")
    found = common.written(links(rows, nodes, similarity, rounds), "links")
    told = nodes.select("node", "least").join(components(found), "node", "left")
    return signed.select("doc_id", "node"), told.select("node", "least", F.coalesce("label", "node").alias("label"))


def _with_node(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("node", F.unhex(F.md5("text")))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, per_band: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, class_id of each row of (doc_id, text, ...): the least doc_id of the row's class.

    Equal texts, and texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more, are in
    one class, and so on from text to text. A null text is in a class of its own (its doc_id); a text without
    words only with texts equal to it. A class in which no row has a doc_id has a null class_id. A text of any length is
    compared as a whole; columns by other names are not read.
    """
    rows, nodes = classes(_with_node(docs.select("doc_id", "text")), similarity, bands, per_band, rounds)
    named = nodes.groupBy("label").agg(F.min("least").alias("class_id"))
    out = rows.join(nodes.join(named, "label").select("node", "class_id"), "node", "left")
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, per_band: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """One row of each class of near_duplicates, that with the least doc_id, with all its columns; rows with a null text stay.

    Columns may have any names: they travel in one column of their own. A text of any length is compared as a whole. Of
    rows that are the same in text and doc_id one stays.
    """
    own = _with_node(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")))
    _, nodes = classes(own, similarity, bands, per_band, rounds)
    stays = nodes.groupBy("label").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("m")).select(F.col("m.node").alias("node"), F.col("m.least").alias("_least"))
    chosen = own.join(stays, "node").filter(F.col("doc_id").eqNullSafe(F.col("_least"))).dropDuplicates(["node"])
    return chosen.select("_row.*").unionByName(docs.filter("text is null"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id of every document."""
    return near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = f"""
WITH RECURSIVE texts AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS (
    SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(words) - {SHINGLE - 2}, 2)), lambda i: array_to_string(words[i : i + {SHINGLE - 1}], ' ')))) AS shingle FROM texts WHERE len(words) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
meets AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM sets x JOIN sets y USING (shingle) WHERE x.doc_id < y.doc_id GROUP BY ALL),
edges AS (
    SELECT a, b FROM meets JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE m >= {SIMILARITY} * (x.n + y.n - m) - 1e-9
    UNION SELECT x.doc_id, y.doc_id FROM texts x JOIN texts y ON x.text = y.text AND x.doc_id < y.doc_id
), either AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reached AS (SELECT doc_id, doc_id AS other FROM texts UNION SELECT doc_id, b FROM reached JOIN either ON other = a)
SELECT doc_id, min(other) AS class_id FROM reached GROUP BY doc_id
"""
