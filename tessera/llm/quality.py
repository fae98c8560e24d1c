"""A quality classifier by compression.

Two zstandard dictionaries are trained, on good and on bad labelled text. A whole text is compressed with
each, in chunks of CHUNK bytes, so that a long text doesn't become its own dictionary. The difference of the
compressed sizes over the size of the text becomes a score by isotonic calibration: the share of good texts
among labelled texts with about that difference, never falling as the difference speaks more for good.
Dictionaries are trained on the whole texts of at most SAMPLE labelled documents of either kind, the
calibration on the differences of at most CALIBRATION other labelled documents, both those with the least
hashes. Labelled documents are dealt to the two by a hash of doc_id, as a dictionary compresses the texts it was trained on too well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing

SAMPLE, CALIBRATION, CHUNK, DICTIONARY, LEVEL = 1500, 4000, 1024, 256 << 10, 3
THRESHOLD = 0.3


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples' own text where zstandard finds too few of them to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def _sizes(good: bytes, bad: bytes, keep: list[str]):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_dict_id=False) for d in (good, bad)]
        for d in tools if good and bad else ():
            d.compress(b"")
        for batch in batches:
            for some in hashing.slices(batch):
                raw, at = hashing.text_bytes(some.column("text"))
                raw, out = raw.tobytes(), []
                for i in range(some.num_rows):
                    chunks = [raw[b : min(b + CHUNK, at[i + 1])] for b in range(at[i], at[i + 1], CHUNK)]
                    out.append([sum(len(t.compress(c)) for c in chunks) for t in tools])
                out = np.array(out, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in keep], pa.array(np.diff(at), pa.int64()), pa.array(out[:, 0]), pa.array(out[:, 1])], [*keep, "n_bytes", "with_good", "with_bad"])

    return sizes


def difference(n: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """How many bytes fewer, for each byte of text, the good dictionary needs; 0 for an empty text."""
    return (bad - good) / np.maximum(n, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the non-decreasing function of x that is nearest to y (1 or 0), by pooling neighbours that are out of order.

    It is level from the first to the last place of a pool, straight between pools; each pool's share is drawn a little to a half.
    """
    x, at, counts = np.unique(x, return_inverse=True, return_counts=True)
    pools: list[list[float]] = []  # sum, number, first x, last x
    for place, total, n in zip(x, np.bincount(at, y, len(x)), counts, strict=True):
        pools.append([total, n, place, place])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total, n, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + total, pools[-1][1] + n, pools[-1][2], last]
    return np.array([p[2:] for p in pools]).reshape(-1), np.repeat(np.maximum.accumulate([(p[0] + 0.5) / (p[1] + 1) for p in pools]), 2)


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, n_bytes, with_good, with_bad (compressed sizes) and score of each row of (doc_id, text, ...).

    ``labels``: (doc_id, label) to learn from, label 1 or 0; those with a null, and those of null texts, are
    passed over; a repeated one counts once. A null text counts as empty, one of any length is compressed whole,
    a repeated row has a score of its own, and equal texts have equal scores. If either label is missing, every
    score is the share of label 1, or a half. The documents to learn from are picked by their ids, so no text is shuffled.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    usable = labels.filter("label in (0, 1)").select("doc_id", "label").distinct().join(docs.filter("text is not null").select("doc_id"), "doc_id", "left_semi")
    usable = usable.withColumns({"h": F.xxhash64("doc_id", "label"), "trains": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0})
    first = lambda rows, n: rows.orderBy("h", "doc_id", "label").limit(n).select("doc_id", "label", "h").collect()
    fetched = lambda rows: texts.join(F.broadcast(spark.createDataFrame(rows, "doc_id long, label int, h long")), "doc_id")  # noqa: E731  SAMPLE or CALIBRATION rows
    trained = [r for k in (0, 1) for r in first(usable.filter(F.col("trains") & (F.col("label") == k)), SAMPLE)]
    rows = fetched(trained).select("label", "h", "text").collect()
    by = {k: [r.text.encode() for r in sorted(rows, key=lambda r: (r.h, r.text)) if r.label == k and r.text] for k in (0, 1)}
    good, bad = (dictionary(by[k]) if by[k] else b"" for k in (1, 0))
    kinds = "n_bytes long, with_good long, with_bad long"
    told, seen = first(usable.filter(~F.col("trains")), CALIBRATION), []
    if by[0] and by[1] and told:
        seen = fetched(told).select("label", "text").mapInArrow(_sizes(good, bad, ["label"]), "label int, " + kinds).collect()
    y = np.array([r.label for r in seen], float)
    if len(set(y)) == 2:
        places, values = isotonic(difference(*(np.array([r[c] for r in seen], float) for c in ("n_bytes", "with_good", "with_bad"))), y)
    else:
        share = float(np.mean([r.label for r in [*trained, *told]] or [0.5]))
        places, values = np.zeros(1), np.array([min(max(share, 0.01), 0.99)])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sizes(good, bad, list(keep))(batches):
            d = difference(*(batch.column(c).to_numpy() for c in ("n_bytes", "with_good", "with_bad")))
            yield batch.append_column("score", pa.array(np.interp(d, places, values), pa.float64()))

    schema = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(scored, ", ".join(f"`{c}` {schema[c]}" for c in keep) + ", " + kinds + ", score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    fold = lambda c: F.crc32(c.cast("string")) % 5
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label")).filter("doc_id is not null").distinct()
    rows = docs.withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)))
    found = score(rows, labels.filter(fold(F.col("doc_id")) != 0), ("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
