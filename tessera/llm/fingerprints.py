"""Document fingerprints by consistent weighted sampling.

The terms of a document are its words and its pairs of neighbouring words, weighted by how often they occur.
For each term and sample r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1) come from hashes of both; with
t = floor(ln w / r + b) the sample keeps the term with the least ln c - r (t - b) - r, a number that tells the
term and t. Two documents agree in a sample with the probability of the generalised Jaccard similarity of
their weights. The variates come from all 64 bits of a term's hash, by the quantiles of their distributions; each
distinct term of a slice of text has them drawn once, those of TERMS terms at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing

SAMPLES, TERMS = 64, 1 << 14
#: Parts that the rows are cut into by doc_id, at most. They are streamed, so a longer one takes no more memory.
MAX_PARTS = 10_000
#: Terms whose variates are drawn in one go, times samples; cells (a term of a text) that are valued in one go.
DRAWN, CELLS = 1 << 15, 5_000


def _quantiles() -> np.ndarray:
    """The Gamma(2, 1) variates at the middles of 2 ** 16 equal shares: where 1 - (1 + x) exp(-x) is that much, by Newton's method on the logarithm of x."""
    share = (np.arange(1 << 16) + 0.5) / (1 << 16)
    y = np.log(np.sqrt(2 * share) - np.log1p(-share))
    for _ in range(30):
        x = np.exp(y)
        y -= (-np.expm1(-x) - x * np.exp(-x) - share) / (x * x * np.exp(-x))
    return np.exp(y)


#: r, and the logarithm of c, by 16 bits of a hash.
_R = _quantiles().astype(np.float32)
_LOG_C = np.log(_quantiles()).astype(np.float32)


def _drawn(terms: np.ndarray, samples: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, r, ln c, b) of some terms at a time, in single precision: each from 16 bits of a 64-bit hash of term and sample."""
    sample = hashing.mix(np.arange(samples, dtype=np.uint64), 20)
    step = max(1, DRAWN // samples)
    for at in range(0, len(terms), step):
        own = slice(at, at + step)
        x = hashing.mix(terms[own], 21)[:, None] + sample
        moved = np.empty_like(x)
        for shift, factor in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
            x ^= np.right_shift(x, np.uint64(shift), out=moved)
            x *= np.uint64(factor)
        x ^= np.right_shift(x, np.uint64(32), out=moved)
        bits = x.view(np.uint16)
        b = bits[:, 2::4].astype(np.float32)
        b += np.float32(0.5)
        b *= np.float32(2.0**-16)
        yield own, _R.take(bits[:, 0::4], mode="clip"), _LOG_C.take(bits[:, 1::4], mode="clip"), b


def variates(terms: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """r and b of each term (a 64-bit hash) and sample."""
    r, b = (np.empty((len(terms), samples), np.float32) for _ in range(2))
    for own, r[own], _, b[own] in _drawn(terms, samples):
        pass
    return r, b


def at_one(terms: np.ndarray, samples: int) -> np.ndarray:
    """The value of each term and sample at weight 1."""
    out = np.empty((len(terms), samples), np.float32)
    for own, r, log_c, b in _drawn(terms, samples):
        b -= np.float32(1)
        b *= r
        np.add(log_c, b, out=out[own])
    return out


def sampled(texts: pa.StringArray, samples: int = SAMPLES, terms: int = TERMS) -> np.ndarray:
    """(rows, samples) of 16-bit marks of the kept terms; a text without words has zeros."""
    words = hashing.Words(texts)
    at, pair = words.grams(2, 11)
    row, n = np.r_[words.row, words.row[at]], len(words.count)
    distinct, term = np.unique(np.r_[hashing.mix(words.hash, 12), pair], return_inverse=True)
    # cells in the order of blocks of terms, then of rows
    cell, times = np.unique((term // terms * n + row) * terms + term % terms, return_counts=True)
    row, term = cell // terms % n, cell % terms
    cuts = np.searchsorted(cell, np.arange(0, len(distinct) + terms, terms) * n)
    least = np.full((n, samples), np.inf, np.float32)
    for i, (begin, end) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        block = distinct[i * terms : (i + 1) * terms]
        one = at_one(block, samples)
        often, place = np.unique(term[begin:end][times[begin:end] > 1], return_inverse=True)  # terms that some text has more than once
        r, b = variates(block[often], samples)
        done = 0
        for at in range(begin, end, CELLS):
            own = slice(at, min(end, at + CELLS))
            value = one[term[own]]
            if len(many := np.flatnonzero(times[own] > 1)):
                k = place[done : done + len(many)]
                done += len(many)
                value[many] -= r[k] * np.floor(np.log(times[own][many]).astype(np.float32)[:, None] / r[k] + b[k])
            first = np.flatnonzero(np.r_[True, np.diff(row[own]) != 0])
            rows = row[own][first]
            least[rows] = np.minimum(least[rows], np.minimum.reduceat(value, first, axis=0))
    out = (hashing.mix(least.view(np.uint32).astype(np.uint64), 13) & np.uint64(0xFFFF)).astype(np.uint16)
    out[words.count == 0] = 0
    return out


def hexes(marks: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in marks]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first as many characters of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _pairs(samples: int, terms: int):
    kind = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def rows(part: list[int], ids: list, guest: list[bool], texts: list[str]) -> pa.RecordBatch | None:
        """The rows but for the last, each with the row after it."""
        use = [i for i in range(len(texts) - 1) if part[i] == part[i + 1] and not guest[i]]
        if not use:
            return None
        changed = [edited(texts[i], texts[i + 1]) for i in use]
        if sum(map(len, texts)) <= 2 * hashing.SLICE_BYTES:  # together, as an edited text has most terms of its own
            own, new = np.split(sampled(pa.array(texts + changed, pa.string()), samples, terms), [len(texts)])
        else:
            own, new = (sampled(pa.array(x, pa.string()), samples, terms) for x in (texts, changed))
        following = own[np.array(use) + 1]
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in changed]
        cols = [[ids[i] for i in use], [len(texts[i]) for i in use], sha, hexes(own[use]), hexes(new), likeness(own[use], new), likeness(own[use], following)]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, kind, strict=True)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            for some in hashing.slices(batch):
                for have, name in zip(held, ("part", "doc_id", "guest", "text"), strict=True):
                    have += some.column(name).fill_null("").to_pylist() if name == "text" else some.column(name).to_pylist()
                if (out := rows(*held)) is not None:
                    yield out
                held = tuple(x[-1:] for x in held)

    return run


def fingerprints(docs: DataFrame, samples: int = SAMPLES, terms: int = TERMS, rows_per_part: int = 4_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of (doc_id, text, ...).

    The next row is that with the next doc_id (after the last: the first); nulls come first, rows with one
    doc_id are in the order of a hash of their texts. A null text counts as empty. Texts without words are
    alike. Rows are cut at quantiles of doc_id into parts of about ``rows_per_part`` (MAX_PARTS parts at most), and
    the first row of each part is also sent to the part before it, so no order over all rows is needed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = rows.count()
    parts = min(MAX_PARTS, max(1, n // rows_per_part))
    found = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], min(50_000, 20 * parts + 1000)).alias("c")).first().c if n else None
    cuts = np.array(sorted(set(found or [])) if parts > 1 else [], np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), "right").astype(np.int32))

    least = F.lit(-(1 << 63))
    keyed = rows.withColumn("part", part_of(F.coalesce("doc_id", least))).withColumn("_order", F.xxhash64("text"))
    first = keyed.groupBy("part").agg(F.min(F.struct(F.coalesce("doc_id", least).alias("d"), F.col("_order").alias("o"))).alias("f")).orderBy("part").collect()
    before = [(r.part, r.f.d, r.f.o, first[i - 1].part) for i, r in enumerate(first)]
    heads = F.broadcast(spark.createDataFrame(before, "part int, d long, o long, to int"))  # MAX_PARTS rows at most
    guests = keyed.join(heads, "part").filter((F.coalesce("doc_id", least) == F.col("d")) & (F.col("_order") == F.col("o")))
    guests = guests.dropDuplicates(["part"]).select("doc_id", "text", F.col("to").alias("part"), "_order", F.lit(True).alias("guest"))
    all_rows = keyed.withColumn("guest", F.lit(False)).unionByName(guests)
    placed = all_rows.repartition(common.shuffle_partitions(spark), "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "_order")
    return placed.select("part", "doc_id", "guest", "text").mapInArrow(_pairs(samples, terms), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
