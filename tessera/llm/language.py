"""Language identification: first the family, then one-versus-one linear SVMs inside it.

Features are hashed pairs and triples of letters (bytes from 0x80 up, and ASCII letters in lower case; all else
is a blank), as shares of the text's. The machines are fitted on a bounded sample: of each language the whole
texts of the SAMPLE training documents with the least hashes of doc_id. Texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common, hashing

SAMPLE, CELLS = 300, 1 << 13
UNKNOWN = "und"
#: About so many bytes of text are scored in one go: each takes four for each machine.
SCORED = 250_000
#: ISO 639-1 codes of some families; any other language is a family of its own.
FAMILIES = {"germanic": "en de nl sv da no is", "romance": "fr es it pt ro ca", "slavic": "ru pl cs sk uk bg sr hr sl", "uralic": "fi et hu", "turkic": "tr az kk"}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_MAP = np.full(256, 0x20, np.uint8)
_MAP[0x80:] = np.arange(0x80, 0x100)
_MAP[ord("a") : ord("z") + 1] = _MAP[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TABLE = [(hashing.mix(np.arange(256, dtype=np.uint64), seed) % np.uint64(CELLS)).astype(np.int32)[_MAP] for seed in range(31, 36)]
_LETTER = _MAP != 0x20


def cells(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For pairs and for triples of bytes the feature of each place; CELLS where it counts for nothing."""
    a, b, c, d, e = (t[raw] for t in _TABLE)
    letter = _LETTER[raw]
    last = np.zeros(len(raw) + 1, bool)
    last[at] = True
    out = []
    if len(raw) > 1:
        pair = a[:-1] ^ b[1:]
        pair[~(letter[:-1] | letter[1:]) | last[1:-1]] = CELLS
        out.append(np.r_[pair, np.int32(CELLS)])
    if len(raw) > 2:
        triple = c[:-2] ^ d[1:-1] ^ e[2:]
        triple[~(letter[:-2] & letter[1:-1] | letter[1:-1] & letter[2:]) | last[1:-2] | last[2:-1]] = CELLS
        out.append(np.r_[triple, np.full(2, CELLS, np.int32)])
    return out


def margins(texts: pa.StringArray, weights: np.ndarray) -> np.ndarray:
    """(rows, machines): the mean weight over the features of each text; ``weights`` has a last column of ones for their count."""
    raw, at = hashing.text_bytes(texts)
    total = np.zeros((len(at) - 1, weights.shape[1]), np.float64)
    full = np.flatnonzero(np.diff(at))
    for cell in cells(raw, at):
        total[full] += np.add.reduceat(weights[cell], at[full], axis=0, dtype=np.float64)
    return total[:, :-1] / np.maximum(total[:, -1:], 1)


def features(texts: pa.StringArray) -> np.ndarray:
    out, done = np.zeros((len(texts), CELLS + 1), np.float32), 0
    for some in hashing.slices(pa.RecordBatch.from_arrays([texts], ["text"])):
        raw, at = hashing.text_bytes(some.column("text"))
        row = np.repeat(np.arange(done, done + some.num_rows), np.diff(at))
        for cell in cells(raw, at):
            np.add.at(out, (row, cell), 1)
        done += some.num_rows
    return out[:, :-1] / np.maximum(out[:, :-1].sum(1, keepdims=True), 1)


def svm(kernel: np.ndarray, y: np.ndarray, steps: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """A linear SVM with squared hinge loss, by accelerated gradient descent: the share of each row in the weights.

    kernel: inner products of the rows. y: 1 or -1; both sides have the same weight.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    a = v = np.zeros(len(y))
    rate = 1 / (2 * float((share * np.diag(kernel)).sum()) + penalty)
    for t in range(steps):
        gap = np.maximum(0, 1 - y * (kernel @ v)) * share * y
        new = v - rate * (penalty * v - 2 * gap)
        v = new + t / (t + 3) * (new - a)
        a = new
    return a


def fit(langs: list[str], texts: list[str]) -> dict:
    """families, pairs: names of the machines, in the order of the columns of ``weights``; slopes: of their logistic curves."""
    x, langs_of = features(pa.array(texts, pa.string())) * 100, np.array(langs)
    kernel = x @ x.T + 1.0  # the one is the bias
    known = sorted(set(langs))
    family = {k: _FAMILY.get(k, k) for k in known}
    family_of = np.array([family[k] for k in langs])
    families = sorted(set(family.values()))
    pairs = [(a, b) for a, b in combinations(known, 2) if family[a] == family[b]]
    columns, slopes = [], []

    def machine(use: np.ndarray, positive: np.ndarray) -> None:
        y = np.where(positive[use], 1.0, -1.0).astype(np.float32)
        if abs(y.sum()) < len(y):
            a = svm(kernel[np.ix_(use, use)].astype(np.float64), y)
            w = np.r_[a.astype(np.float32) @ x[use], np.float32(a.sum())]
        else:  # one side only
            w = np.r_[np.zeros(CELLS, np.float32), np.float32(1)]
        m = x[use] @ w[:-1] + w[-1]
        slope = 1.0
        for _ in range(50):  # of the logistic curve, by gradient ascent on a log scale
            p = 1 / (1 + np.exp(-np.clip(slope * m * y, -30, 30)))
            slope = float(np.clip(slope * np.exp(0.5 * np.mean((1 - p) * m * y)), 0.1, 20))
        columns.append(w)
        slopes.append(slope)

    every = np.ones(len(langs), bool)
    for f in families:
        machine(every, family_of == f)
    for a, b in pairs:
        machine((langs_of == a) | (langs_of == b), langs_of == a)
    found = np.stack(columns, 1) if columns else np.zeros((CELLS + 1, 0), np.float32)
    weights = np.zeros((CELLS + 1, found.shape[1] + 1), np.float32)
    weights[:CELLS, :-1] = found[:-1] * 100 + found[-1]  # shares sum to one, so the bias is part of each weight
    weights[:CELLS, -1] = 1
    return {"families": families, "members": [[k for k in known if family[k] == f] for f in families], "pairs": pairs, "weights": weights, "slopes": np.array(slopes)}


def decide(model: dict, margin: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language of each row and how sure the machines on the way are together."""
    sure = 1 / (1 + np.exp(-np.clip(margin * model["slopes"], -30, 30)))
    n = len(model["families"])
    best = margin[:, :n].argmax(1)
    score = sure[np.arange(len(margin)), best]
    out = np.empty(len(margin), object)
    for f, members in enumerate(model["members"]):
        rows = np.flatnonzero(best == f)
        votes, worst = np.zeros((len(rows), len(members))), np.ones((len(rows), len(members)))
        for j, (a, b) in enumerate(model["pairs"]):
            if a in members:
                p = sure[rows, n + j]
                for name, q in ((a, p), (b, 1 - p)):
                    k = members.index(name)
                    votes[:, k] += (q >= 0.5) + q * 1e-3
                    worst[:, k] = np.minimum(worst[:, k], q)
        won = votes.argmax(1)
        out[rows] = np.array(members, object)[won]
        score[rows] *= worst[np.arange(len(rows)), won]
    return out.tolist(), score


def sampled(train: DataFrame, sample: int) -> list[tuple[str, int, str]]:
    """(lang, hash, text) of at most ``sample`` rows of each language, those with the least hashes of doc_id.

    Only ids are ranked, and of these only about four times as many as are wanted: rows whose hash lies above
    what their language's count asks for are dropped where they are read. Texts come by a join with what is left.
    """
    usable = train.filter("text is not null and lang is not null and doc_id is not null").withColumn("h", F.xxhash64("doc_id"))
    counts = F.broadcast(usable.groupBy("lang").agg(F.count("*").alias("n")))  # a row for each language, of which the model has ``sample`` texts
    share = F.least(F.lit(1.0), F.lit(4.0 * sample + 100) / F.col("n"))
    near = usable.select("lang", "h", "doc_id").join(counts, "lang").filter(F.shiftrightunsigned("h", 11) * 2.0**-53 < share)
    picked = near.select("lang", "h", "doc_id").distinct().withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("k") <= sample).drop("k")
    rows = sorted(tuple(r) for r in picked.collect())  # ``sample`` for each language
    if not rows:
        return []
    wanted = F.broadcast(train.sparkSession.createDataFrame(rows, "lang string, h long, doc_id long"))
    found = train.filter("text is not null").join(wanted, ["lang", "doc_id"]).select("lang", "h", "text").collect()
    return sorted(tuple(r) for r in found)


def identify(docs: DataFrame, train: DataFrame, sample: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """lang_pred, score, and the columns in ``keep`` (text always), of each row of (text, ...).

    ``train``: (doc_id, text, lang); rows with a null are passed over. A null text and one without a letter are
    ``und`` with score 0, as is every text if there is nothing to learn from. A text of any length is scored
    whole, a repeated row like the first; ties, of families and of votes, go to the name that sorts first.
    """
    rows = sampled(train, sample)
    model = fit([r[0] for r in rows], [r[2] for r in rows]) if rows else None
    names = list(dict.fromkeys(["text", *keep]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in hashing.slices(batch, size=SCORED):
                if model:
                    langs, score = decide(model, margins(some.column("text"), model["weights"]))
                else:
                    langs, score = [UNKNOWN] * some.num_rows, np.zeros(some.num_rows)
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in names], pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    found = docs.select(*names).mapInArrow(predict, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", lang_pred string, score double")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.withColumn("lang_pred", F.when(letters, F.col("lang_pred")).otherwise(UNKNOWN)).withColumn("score", F.when(letters, F.col("score")).otherwise(0.0))


def fold(docs: DataFrame, folds: int = 3) -> DataFrame:
    return docs.withColumn("_fold", F.crc32(F.col("doc_id").cast("string")) % folds)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = fold(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", "text", F.coalesce(F.col("_fold") == 1, F.lit(False)).alias("held_out"))
    return identify(rows, docs.filter("_fold <> 1"), keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")
