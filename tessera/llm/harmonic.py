"""Harmonic packing: pieces by reciprocals of the capacity, a fixed number of pieces in each sequence of a class.

A piece of l tokens is of class k = capacity // l, and k pieces of class k fill a sequence whatever their exact
lengths are. What such a sequence may waste is bounded by the cut: a document's rest (its ids beyond whole
sequences) stays whole if k times its length is at least the capacity less SLACK of it, or if it is shorter than
that share twice over; else a piece of capacity // (k + 1) tokens, which fills its class's sequences nearly
exactly, is cut from it, and so on with what is left. Each worker fills the sequences of its classes on its own
from the pieces that it reads: no exchange, and the place of a piece is known as soon as it is cut. Only pieces
in sequences that are not full when a worker ends (fewer than k for each class and worker) are moved: all
workers' are ranked by class and fill sequences of k again. The last ones, fewer than k for each class however
large the corpus is (some 9,000 short pieces at 2048 tokens), are packed first-fit by falling length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.taskcontext import TaskContext

from . import bytelevel, common, hashing

CAPACITY, END, SLACK = 2048, 1, 1 / 64
#: About so many bytes of text are cut into units before the units are looked up.
LOOKED_UP = 4_000_000
#: No more counts of classes and workers than this are broadcast.
BROADCAST_COUNTS = 100_000
_PLACED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("class", pa.int32()), ("part", pa.int32()), ("turn", pa.int32())])
_PLACED_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class int, part int, turn int"


def rests(capacity: int, slack: float = SLACK) -> list[list[int]]:
    """The lengths of the pieces that a rest of 0, 1, ... capacity - 1 tokens is cut into."""
    found: list[list[int]] = [[]]
    for rest in range(1, capacity):
        k = capacity // rest
        if k * rest >= capacity * (1 - slack) or rest <= 2 * slack * capacity:
            found.append([rest])
        else:
            piece = capacity // (k + 1)
            found.append([piece, *found[rest - piece]])
    return found


def placed(docs: DataFrame, path: str, capacity: int, slack: float) -> DataFrame:
    """The pieces of each row of (doc_id, text), with their places in full sequences; those in a class's last sequence of a task have no place."""
    cuts = rests(capacity, slack)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, opened = TaskContext.get().partitionId(), 0
        filling: dict[int, list[tuple]] = {}  # of each class the pieces of its sequence that isn't full
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _PLACED, strict=True)], schema=_PLACED)
            out.clear()
            return rows

        for batch in batches:
            for many in hashing.slices(batch, size=LOOKED_UP):
                some = list(hashing.slices(many))
                for own, (ids, ends) in zip(some, bytelevel.encoded([x.column("text") for x in some], path, END), strict=True):
                    raw, at = memoryview(ids).cast("B"), 0
                    for doc_id, end in zip(own.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                        begin, tokens = at, end - at
                        for length in [capacity] * (tokens // capacity) + cuts[tokens % capacity]:
                            k = capacity // length
                            mine = filling.setdefault(k, [])
                            mine.append((doc_id, at - begin, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), tokens))
                            at += length
                            if len(mine) == k:
                                offset = 0
                                for turn, piece in enumerate(mine):
                                    out.append((*piece, part << 36 | opened, offset, k, part, turn))
                                    offset += piece[2]
                                mine.clear()
                                opened += 1
                    if len(out) >= 20_000:
                        yield told()
        out.extend((*piece, None, None, k, part, turn) for k, mine in filling.items() for turn, piece in enumerate(mine))
        if out:
            yield told()

    return docs.mapInArrow(place, _PLACED_DDL)


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece, first-fit by falling length."""
    used: list[int] = []
    found = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        where = next((s for s, n in enumerate(used) if n + lengths[i] <= capacity), len(used))
        if where == len(used):
            used.append(0)
        found[i] = (where, used[where])
        used[where] += lengths[i]
    return found


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of (doc_id, text, ...).

    The ids of a document are those of its text (null: none) and the end id, so an empty document is one piece of
    one token. A repeated row is packed as a document of its own; a text of any length is cut whole; a table
    without rows gives none; columns by other names are not read. ``path``: a file that bytelevel.tokenizer() takes.
    """
    path = path or bytelevel.default_vocabulary()
    bytelevel.tokenizer(path)
    rows = common.fresh(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    every = common.written(placed(rows, path, capacity, slack), "pieces")
    names = [f.name for f in _PLACED][:7]
    full, rest = every.filter(F.col("sequence_id").isNotNull()).select(names), every.filter(F.col("sequence_id").isNull())
    counts = rest.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("class").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    moved = counts.select(F.col("class").alias("_k"), F.col("part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"), F.sum("n").over(W.partitionBy("class")).alias("_n"))
    moved = common.written(moved, "counts")
    moved = F.broadcast(moved) if moved.count() <= BROADCAST_COUNTS else moved
    ranked = rest.join(moved, (F.col("class") == F.col("_k")) & (F.col("part") == F.col("_p"))).withColumn("_rank", F.col("_before") + F.col("turn"))
    ranked = ranked.withColumn("_bin", F.floor(F.col("_rank") / F.col("class"))).withColumn("_last", F.col("_bin") == F.floor(F.col("_n") / F.col("class")))
    ahead = W.partitionBy("class", "_bin").orderBy("_rank").rowsBetween(W.unboundedPreceding, -1)
    again = ranked.filter(~F.col("_last")).withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    again = again.withColumn("sequence_id", -1 - (F.shiftleft(F.col("class").cast("long"), 44) + F.col("_bin"))).select(names)

    def finish(last: pd.DataFrame) -> pd.DataFrame:
        last = last.sort_values(["class", "_rank"])
        where = first_fit(last["length"].tolist(), capacity)
        return last.assign(sequence_id=[-1 - s for s, _ in where], offset=[o for _, o in where])[names]

    ended = ranked.filter("_last").groupBy().applyInPandas(finish, ", ".join(_PLACED_DDL.split(", ")[:7]))  # fewer than k pieces of each class
    return full.unionByName(again).unionByName(ended)


def op12_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens with little padding."""
    return pack(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
