"""Best-fit packing of documents into sequences, in bulk-synchronous steps.

Documents are cut into pieces of at most ``capacity`` tokens. Pieces of one length are alike, so are sequences
with one gap: sorted by length and by gap, the ranges of pieces and of gaps are these classes, of which there
are at most ``capacity``. A step takes all pieces of one length, longest first. A sweep goes up the gaps from
that length (the successor of a piece is the smallest gap that holds it); where more pieces than sequences
want a gap, the pieces of lowest rank get it and the others go on; gaps are updated and the sweep is repeated
until no gap is left, then sequences are opened. What the sweep reads is the number of pieces of each length,
what it yields is intervals of ranks; neither grows with the corpus. Ranks of pieces, and the sequence and
place that each piece gets from its rank, are worked out by Spark for all pieces at once. Where documents come
in windows, each window is packed on its own, and the sweeps of all windows run beside each other.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.taskcontext import TaskContext

from . import common, hashing, tokens

CAPACITY = 4096
END = 1
_END_BYTES = struct.pack("<I", END)
#: When a worker holds the ids of more units than so many, it forgets those that aren't in the texts at hand.
HELD = 100_000
#: About so many bytes of text are cut into units before the units are looked up.
LOOKED_UP = 4_000_000
#: No more intervals than this are broadcast, 8 MB; one window has about 30,000 at 4096 tokens, however many pieces.
BROADCAST_INTERVALS = 100_000
_PIECE = "doc_id long, window long, piece int, start long, length long, ids_crc32 long, part int, turn long"


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """The pieces of each row of (doc_id, window, text); turn: how many pieces of that window and length came before in the task ``part``."""
    fields = pa.schema([("doc_id", pa.int64()), ("window", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("turn", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turns = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for many in hashing.slices(batch, size=LOOKED_UP):
                some = list(hashing.slices(many))
                for own, (ids, ends) in zip(some, encoded([x.column("text") for x in some], path), strict=True):
                    rows = []
                    raw, begin = memoryview(ids).cast("B"), 0
                    for doc_id, window, end in zip(own.column("doc_id").to_pylist(), own.column("window").to_pylist(), ends.tolist(), strict=True):
                        for k, at in enumerate(range(begin, end, capacity)):
                            length = min(capacity, end - at)
                            rows.append((doc_id, window, k, at - begin, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), part, turns[window, length]))
                            turns[window, length] += 1
                        begin = end
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return docs.mapInArrow(cut, _PIECE)


_ids: dict[str, dict[str, bytes]] = {}  # of each vocabulary


def encoded(columns: list[pa.StringArray], path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text column (ids of all texts, each with the end id behind it; where each text ends). Units that were met before are looked up, the library gets the others."""
    known = _ids.setdefault(path, {})
    cut = [tokens.units(x) for x in columns]
    code = pa.concat_arrays([units for units, _ in cut]).dictionary_encode()
    distinct = code.dictionary.to_numpy(zero_copy_only=False).tolist()
    found = list(map(known.get, distinct))
    if len(known) > HELD:
        known.clear()
        known.update((u, x) for u, x in zip(distinct, found, strict=True) if x is not None)
    new = [i for i, x in enumerate(found) if x is None]
    for i, own in zip(new, tokens.encode([distinct[i] for i in new], path), strict=True):
        found[i] = known[distinct[i]] = own
    found.append(_END_BYTES)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat, begins, codes, at = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes, code.indices.to_numpy(), 0
    for _, first in cut:
        own = np.insert(codes[at : at + first[-1]], first[1:], len(found) - 1)
        size, at = sizes[own], at + first[-1]
        end = np.cumsum(size)
        ids = flat[np.arange(end[-1]) + np.repeat(begins[own] - end + size, size)]
        yield ids, end[first[1:] + np.arange(len(first) - 1)]


def sweeps(count: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, place in the sequence): piece ``rank`` of that length goes to sequence ``first sequence + rank - first rank``."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, number)
    order: list[int] = []  # the gaps, ascending
    found, opened = [], 0

    def add(gap: int, run: tuple[int, int]) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(order, gap)
        gaps[gap].append(run)

    for length in sorted(count, reverse=True):
        rank, end = 0, count[length]
        while rank < end:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                number = -(-(end - rank) // (capacity // length))
                add(capacity, (opened, number))
                opened += number
                continue
            gap = order[at]
            first, number = gaps[gap].pop()
            took = min(number, end - rank)
            if took < number:
                gaps[gap].append((first + took, number - took))
            if not gaps[gap]:
                del gaps[gap], order[at]
            found.append((length, rank, rank + took, first, capacity - gap))
            rank += took
            if gap > length:
                add(gap - length, (first, took))
    return found


def _swept(capacity: int):
    def swept(counts: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(sweeps(dict(zip(counts["length"].tolist(), counts["n"].tolist(), strict=True)), capacity), columns=["_length", "first", "end", "to", "offset"])
        return found.assign(_window=counts["window"].iat[0])

    return swept


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, window: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of (doc_id, text, ...).

    The ids of a document are those of its text (null: none) and the end id, so an empty document is one piece
    of one token. A repeated row is packed as a document of its own. Only a document over ``capacity`` is cut.
    ``window``: a column of whole numbers from 0; sequences hold documents of one window only, those of a later window
    have larger numbers. A null is window 0, and so are all rows by default. ``path``: a file that tokens.tokenizer() takes.
    """
    path = path or tokens.default_vocabulary()
    tokens.tokenizer(path)
    rows = common.fresh(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")) if window is None else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(window).cast("long").alias("window"))
    rows = rows.withColumn("window", F.lit(0).cast("long") if window is None else F.coalesce("window", F.lit(0)))
    cut = common.written(pieces(rows.select("doc_id", "window", "text"), path, capacity), "pieces")
    counts = cut.groupBy("window", "length", "part").agg(F.count("*").alias("n"))
    lengths = counts.groupBy("window", "length").agg(F.sum("n").alias("n"))
    plan = common.written(lengths.groupBy("window").applyInPandas(_swept(capacity), "_length long, first long, end long, to long, offset long, _window long"), "intervals")  # ``capacity`` rows in a group at most
    before = W.partitionBy("window", "length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    moved = counts.select(F.col("window").alias("_w"), F.col("length").alias("_l"), F.col("part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    placed = cut.join(moved, (F.col("window") == F.col("_w")) & (F.col("length") == F.col("_l")) & (F.col("part") == F.col("_p"))).withColumn("_rank", F.col("_before") + F.col("turn"))
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_INTERVALS else plan
    placed = placed.join(plan, (F.col("window") == F.col("_window")) & (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("end")))
    sequence = F.shiftleft("window", 32) + F.col("to") + F.col("_rank") - F.col("first")  # a window of 17 trillion tokens would be too large
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
