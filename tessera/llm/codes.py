"""Vector codes: each part of an integer vector as the number of its nearest codebook entry.

Components become integers once and are kept as dictionary codes: for a block of rows the distinct integers of
each dimension, and for each row and dimension the place of its integer among them. A round tabulates, for each
dimension, the squared differences of every distinct integer to all entries; the distance of a part to an entry
is then a gather and an add for each of its dimensions, with no multiplication for a row. Blocks are written to
the shared folder, and each round reads them from there; a round sends out the codebooks (PARTS x ENTRIES
entries) and brings back counts and sums for them, nothing else. All arithmetic is in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of a block.
BLOCK = 8_192
#: Integers may be so large: squared differences of 1,024 of them are summed without overflow.
LARGEST = 1 << 25
#: No more labels than this are broadcast with their errors.
BROADCAST_LABELS = 100_000
_BLOCK = pa.schema([("rows", pa.int32()), ("vec_id", pa.binary()), ("label", pa.list_(pa.string())), ("values", pa.list_(pa.list_(pa.int64()))), ("codes", pa.binary())])
_BLOCK_DDL = "rows int, vec_id binary, label array<string>, values array<array<bigint>>, codes binary"


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of rows of (vec_id, label, v): each dimension as distinct integers and codes; shorter vectors are padded with zeros to ``width``."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                n, column = some.num_rows, some.column("v")
                lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = column.flatten().to_numpy(zero_copy_only=False)
                whole = np.zeros((n, width), np.int64)
                whole[np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
                if np.abs(whole).max(initial=0) > LARGEST:
                    raise ArithmeticError(f"components beyond {LARGEST} after scaling: their distances would not fit in 64 bits")
                values, codes = [], np.empty((width, n), np.uint16)
                for d in range(width):
                    distinct, codes[d] = np.unique(whole[:, d], return_inverse=True)
                    values.append(distinct.tolist())
                ids = some.column("vec_id").fill_null(0).to_numpy().astype("<i8").tobytes() + some.column("vec_id").is_valid().to_numpy(zero_copy_only=False).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([ids]), pa.array([some.column("label").to_pylist()], _BLOCK.field("label").type), pa.array([values], _BLOCK.field("values").type), pa.array([codes.tobytes()])], schema=_BLOCK)

    return rows.select("vec_id", "label", "v").mapInArrow(coded, _BLOCK_DDL)


def assigned(values: list[list[int]], codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part and row; codes: dimensions x rows, books: parts x entries x positions."""
    parts, entries, positions = books.shape
    n = codes.shape[1]
    nearest, least = np.empty((parts, n), np.int64), np.empty((parts, n), np.int64)
    for part in range(parts):
        total = np.zeros((n, entries), np.int64)
        for position in range(positions):
            d = part * positions + position
            table = (np.array(values[d], np.int64)[:, None] - books[part, :, position]) ** 2
            total += table[codes[d]]
        nearest[part] = total.argmin(1)  # the first of the least
        least[part] = total[np.arange(n), nearest[part]]
    return nearest, least


def _read(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray]]:
    for i in range(batch.num_rows):
        block = batch.slice(i, 1).to_pylist()[0]
        yield block, np.frombuffer(block["codes"], np.uint16).reshape(-1, block["rows"])


def moved(known: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: the floors of the means of the parts that each entry is nearest to."""
    parts, entries, positions = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, positions + 1), np.int64)
        for batch in batches:
            for block, codes in _read(batch):
                nearest, _ = assigned(block["values"], codes, books)
                for part in range(parts):
                    total[part, :, 0] += np.bincount(nearest[part], minlength=entries)
                    for position in range(positions):
                        d = part * positions + position
                        pairs = np.bincount(nearest[part] * len(block["values"][d]) + codes[d], minlength=entries * len(block["values"][d]))  # how often each distinct integer is at each entry
                        total[part, :, position + 1] += pairs.reshape(entries, -1) @ np.array(block["values"][d], np.int64)
        used = total[:, :, 0] > 0
        cell = np.flatnonzero(used.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total.reshape(-1, positions + 1)[cell].tolist(), pa.list_(pa.int64()))], ["cell", "sums"])

    told = known.select("rows", "values", "codes").mapInArrow(sums, "cell int, sums array<bigint>")
    summed = told.groupBy("cell").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(positions + 1)])
    after = books.copy()
    for row in summed.collect():  # PARTS x ENTRIES rows at most
        part, entry = divmod(row[0], entries)
        after[part, entry] = [s // row[1] for s in row[2:]]
    return after


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of each kept row of (vec_id, embedding, label, ...), the final codebooks: parts x entries x positions).

    Rows whose vector is null or holds nulls or non-finite components are dropped. Shorter vectors count as filled
    up with zeros to the longest, and that to a multiple of ``parts``. Codebooks start from the smallest vec_ids
    (nulls last, then by components); with fewer rows than ``entries`` they have so many entries. A repeated row is a
    row of its own; ties go to the lower index; without rows there are no entries and no result. A component that
    exceeds LARGEST after scaling is an error, not a wrong distance. ``label`` is kept as text.
    """
    if entries > 256:
        raise ValueError("codes are two hex digits: 256 entries at most")
    rows = common.fresh(vectors, "vec_id", "embedding", "label").filter(usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), integers(F.col("embedding"), scale).alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    positions = -(-longest // parts)
    heads = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.zeros((len(heads), parts * positions), np.int64)
    for i, row in enumerate(heads):
        books[i, : len(row.v)] = row.v
    books = books.reshape(len(heads), parts, positions).transpose(1, 0, 2).copy()
    known = common.written(blocks(rows, parts * positions), "vector-blocks")
    for _ in range(rounds if len(heads) else 0):
        books = moved(known, books)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, codes in _read(batch):
                n = block["rows"]
                nearest, least = assigned(block["values"], codes, books)
                raw = np.ascontiguousarray(nearest.T.astype(np.uint8)).tobytes().hex()
                ids = pa.array(np.frombuffer(block["vec_id"], "<i8", n), pa.int64(), mask=~np.frombuffer(block["vec_id"], bool, n, 8 * n))
                yield pa.RecordBatch.from_arrays([ids, pa.array(block["label"], pa.string()), pa.array([raw[i : i + 2 * parts] for i in range(0, len(raw), 2 * parts)], pa.string()), pa.array(least.sum(0), pa.int64())], ["vec_id", "label", "code", "error"])

    return known.mapInArrow(final, "vec_id long, label string, code string, error long"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every usable vector, the error of its label, and a digest of the codebooks."""
    found, books = compress(common.table(spark, sf_dir, "embeddings"))
    found = common.written(found, "vector-codes")
    labels = common.written(found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels
    digest = F.sha2(F.lit(",".join(map(str, books.ravel().tolist()))), 256)
    return found.join(labels, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _sql() -> str:
    rows = f"""kept AS MATERIALIZED (
  SELECT vec_id, label, [CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v, len(v) // {PARTS} AS positions FROM kept),
parts AS MATERIALIZED (
  SELECT r, p AS part, v[p * positions + 1 : (p + 1) * positions] AS x FROM numbered, range({PARTS}) AS t(p)),
books0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS e FROM parts WHERE r <= {ENTRIES})"""
    steps = [rows]
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT part, r, any_value(x) AS x, min(d * {ENTRIES} + entry) AS best FROM (
    SELECT part, r, x, entry, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, e)]) AS BIGINT) AS d
    FROM parts JOIN books{k} USING (part)) GROUP BY part, r)""")
        if k < ROUNDS:
            steps.append(f"""books{k + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m, e) AS e FROM books{k} LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
      SELECT part, best % {ENTRIES} AS entry, i, sum(x[i]) AS s, count(*) AS n FROM near{k}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL)
    GROUP BY part, entry) USING (part, entry))""")
    return "WITH " + ",\n".join(steps) + f""",
digest AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS h FROM books{ROUNDS}),
coded AS (
  SELECT r, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN numbered USING (r), digest"""


SQL = _sql()
