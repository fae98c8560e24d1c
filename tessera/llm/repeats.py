"""Substring dedup by repeated-phrase automata.

A word goes if it lies in a window of ``window`` words that also starts in a document with a smaller doc_id.

1. Recurring phrases. In each run of ``window`` words the phrase of ``phrase`` words with the least hash is its
   anchor (ties: the first), so two documents that share a window share its anchor. Each document is reduced to
   the hashes of its anchors, each with one place. Anchors of two different texts are kept, with their places. A
   copy (by a 128-bit digest of the text) of a document with a smaller id goes whole and takes no further part.
2. Automata. Documents are dealt to shards of about SHARD. Each shard compiles its documents' kept phrases to an
   Aho-Corasick automaton, and its documents are streamed through, whole: every place where a phrase occurs is
   found, whatever its anchor there is. A document is in one shard, so no text is read by more than one
   automaton, and an automaton grows with its shard's texts only. Documents without a kept phrase share nothing.
3. Windows. Each window that holds an occurrence is told by a 128-bit digest of its words. A digest that occurs
   under two doc_ids covers its windows in all documents but that with the least. Of what a task has in hand all
   but the documents with the least doc_id are decided there; one row for each digest goes on to meet those of
   other tasks, so a passage that very many documents share is no larger a group than there are tasks.
4. Covered windows go back to their documents, and the words that are left are put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import common, hashing

WINDOW, PHRASE = 50, 20
#: Documents in a shard, about; windows that a task has in hand at a time, about.
SHARD, IN_HAND = 500, 100_000
_NEVER = (1 << 63) - 1


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """For each i with i + width <= len(x) the position of the least of x[i:i + width]; ties: the first."""
    if len(x) < width:
        return np.zeros(0, np.int64)
    best, step = np.arange(len(x)), 1
    while step < width:
        move = min(step, width - step)
        left, right = best[: len(best) - move], best[move:]
        best = np.where(x[right] < x[left], right, left)
        step += move
    return best


def anchors(words: hashing.Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the anchors of all texts, each hash once for a text, places counted in all words of the column, ascending."""
    at, h = words.grams(phrase)
    every = np.full(len(words.begin), np.iinfo(np.uint64).max, np.uint64)
    every[at] = h
    starts = np.flatnonzero(np.arange(len(words.begin)) + window <= words.first[1:][words.row]) if len(words.begin) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.unique(sliding_least(every, window - phrase + 1)[starts])
    place = np.sort(place[np.unique(np.stack([words.row[place].astype(np.uint64), every[place]]), axis=1, return_index=True)[1]])
    return every[place], place


def _outline(window: int, phrase: int):
    kind = pa.schema([("order", pa.int64()), ("key", pa.int64()), ("same", pa.binary()), ("anchor", pa.list_(pa.int64())), ("place", pa.list_(pa.int32()))])

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in hashing.slices(batch):
                words = hashing.Words(some.column("text"))
                h, place = anchors(words, window, phrase)
                cuts = pa.array(np.searchsorted(place, words.first), pa.int32())  # places ascend, and so do their rows
                inside = place - words.first[words.row[place]] if len(place) else place
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v, t)) for v, t in ((h.view(np.int64), pa.int64()), (inside, pa.int32()))]
                out = pa.RecordBatch.from_arrays([*[some.column(c) for c in ("order", "key", "same")], *lists], schema=kind)
                yield out.filter(pa.array(words.count >= window))

    return outline


def located(automaton: ahocorasick.Automaton, words: list[bytes], window: int, phrase: int) -> np.ndarray:
    """First words of all windows that hold one of the automaton's phrases, ascending."""
    line = f" {b' '.join(words).decode()} "
    ends = np.fromiter((end for end, _ in automaton.iter(line)), np.int64)
    if not len(ends):
        return ends
    blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 0x20)  # one before each word, one at the end
    first = np.searchsorted(blanks, ends) - phrase  # words where the occurrences begin
    steps = np.zeros(len(words) + 2, np.int64)
    np.add.at(steps, np.maximum(first + phrase - window, 0), 1)
    np.add.at(steps, first + 1, -1)
    starts = np.flatnonzero(np.cumsum(steps) > 0)
    return starts[starts <= len(words) - window]


def digests(words: list[bytes], starts: np.ndarray, window: int) -> np.ndarray:
    """(starts, 2): the halves of a 128-bit digest of the words of each window."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begin = np.cumsum(size) - size
    view, ends = memoryview(b" ".join(words)), (begin + size - 1)[starts + window - 1].tolist()
    found = b"".join([hashlib.blake2b(view[b:e], digest_size=16).digest() for b, e in zip(begin[starts].tolist(), ends, strict=True)])
    return np.frombuffer(found, "<i8").reshape(-1, 2)


def _streamed(window: int, phrase: int, in_hand: int):
    """The windows of all texts that are covered or to be compared. Rows come shard by shard, in each the places of kept phrases and the keys of copies before the texts.

    ``at``: the first word, or -1 - it if that window comes again in the document. ``covered``: that is known
    here; high and low are those of the document then, so that such rows spread.
    """
    names = ["order", "key", "at", "high", "low", "covered"]

    def windows(texts: list[tuple[int, int, list[bytes], list[int]]]) -> Iterator[np.ndarray]:
        """(5, windows) of each text: order, key, at, high, low."""
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for _, _, words, places in texts:
            for p in places:
                if len(own := words[p : p + phrase]) == phrase:
                    automaton.add_word(f" {b' '.join(own).decode()} ")
        automaton.make_automaton()
        for order, key, words, _ in texts if len(automaton) else []:
            starts = located(automaton, words, window, phrase)
            halves, first, times = np.unique(digests(words, starts, window), axis=0, return_index=True, return_counts=True)
            at = starts[first]
            yield np.stack([np.full(len(at), order), np.full(len(at), key), np.where(times > 1, -1 - at, at), halves[:, 0], halves[:, 1]])

    def decided(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held, axis=1)
        rows = rows[:, np.lexsort((rows[0], rows[4], rows[3]))]
        new = np.r_[True, (rows[3:, 1:] != rows[3:, :-1]).any(0)]
        least = rows[0][np.flatnonzero(new)][np.cumsum(new) - 1]
        covered = rows[0] > least
        rows[3:, covered] = rows[:2, covered]
        together = np.lexsort((rows[1], rows[0]))  # rows of a document side by side take less room in the exchange
        rows, covered = rows[:, together], covered[together]
        return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(x), pa.int32() if k == 2 else pa.int64()) for k, x in enumerate(rows.astype(np.int64))], pa.array(covered)], names)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, wanted, done, texts, held = None, {}, set(), [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for own, doc, order, key, text, places in zip(*[batch.column(c).slice(at, 200).to_pylist() for c in ("shard", "doc", "order", "key", "text", "places")], strict=True):
                    if own != shard:
                        held += windows(texts) if texts else []
                        shard, wanted, done, texts = own, {}, set(), []
                        if sum(x.shape[1] for x in held) > in_hand:
                            yield decided(held)
                            held = []
                    if places is not None and key is None:
                        wanted[doc] = places
                    elif places is not None:
                        done.add((order, key))
                    elif (order, key) not in done and doc in wanted:
                        done.add((order, key))
                        texts.append((order, key, text.encode().split(), wanted[doc]))
        held += windows(texts) if texts else []
        if any(x.shape[1] for x in held):
            yield decided(held)

    return streamed


def covered_windows(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard: int = SHARD, in_hand: int = IN_HAND) -> tuple[DataFrame, DataFrame]:
    """(copies, covered) of (order, key, text): (order, key) of whole copies, and (order, key, at) of the covered windows of the others, ``at`` as _streamed tells it."""
    texts = docs.select("order", "key", "text").filter("text is not null")
    outline = texts.withColumn("same", F.unhex(F.md5("text"))).mapInArrow(_outline(window, phrase), "order long, key long, same binary, anchor array<long>, place array<int>")
    outline = common.written(outline, "outline")
    least = outline.groupBy("same").agg(F.min("order").alias("least"), F.max("order").alias("most")).filter("least < most").select("same", "least")
    copies = common.written(outline.select("order", "key", "same").join(least, "same").filter("order > least").select("order", "key").distinct(), "copies")
    doc = F.coalesce(F.nullif("order", F.lit(_NEVER)), "key").alias("doc")  # should two texts have one, each gets the places of both, and that does no harm
    places = outline.select(doc, "key", F.inline(F.arrays_zip("anchor", "place")))
    shared = places.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a < b").select("anchor")
    wanted = places.select("doc", "anchor", "place").join(shared, "anchor").groupBy("doc").agg(F.collect_set("place").alias("places"))  # no more than the document has
    n_shards = max(1, outline.count() // shard)
    dealt = F.pmod(F.xxhash64("doc"), F.lit(n_shards)).cast("int").alias("shard")
    none = F.lit(None).cast("long")
    no_text, no_places = F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<int>").alias("places")
    every = wanted.select("doc", none.alias("order"), none.alias("key"), no_text, "places").unionByName(copies.select(doc, "order", "key", no_text, F.array().cast("array<int>").alias("places")))
    every = every.unionByName(texts.select(doc, "order", "key", "text", no_places)).withColumn("shard", dealt)
    every = every.repartition(min(n_shards, common.shuffle_partitions(docs.sparkSession)), "shard").sortWithinPartitions("shard", F.col("places").isNull())
    windows = every.mapInArrow(_streamed(window, phrase, in_hand), "order long, key long, at int, high long, low long, covered boolean")
    least = F.min("order").over(W.partitionBy("high", "low"))  # a few rows for each task at most
    return copies, windows.withColumn("least", least).filter("covered or order > least").select("order", "key", "at")


def _kept(names: list[str], window: int, verbatim: bool):
    def left(words: list[bytes], found: list[int]) -> list[int]:
        """The words outside the covered windows."""
        at = np.array(found, np.int64)
        if len(again := -1 - at[at < 0]):
            starts = np.arange(len(words) - window + 1)
            every = list(map(bytes, digests(words, starts, window)))
            those = set(map(bytes, digests(words, again, window)))
            at = np.r_[at[at >= 0], [s for s, d in zip(starts.tolist(), every, strict=True) if d in those]]
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + window, -1)
        return np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in hashing.slices(batch):
                rows = []
                for text, copy, found in zip(*[some.column(c).to_pylist() for c in ("text", "copy", "found")], strict=True):
                    words = (text or "").encode().split()
                    n = len(words)
                    if copy:
                        rows.append((n, n, ""))
                    elif not found:
                        rows.append((n, 0, (text or "") if verbatim else b" ".join(words).decode()))
                    else:
                        stay = left(words, found)
                        rows.append((n, n - len(stay), b" ".join(map(words.__getitem__, stay)).decode()))
                out = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in names], *out], [*names, "n_words", "n_removed", "kept"])

    return kept


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard: int = SHARD, in_hand: int = IN_HAND, keep: tuple[str, ...] = (), verbatim: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of each row of (doc_id, text, ...), and the columns in ``keep``.

    Words are runs without ASCII white space. A null text has none. A null doc_id counts as larger than any;
    rows with one doc_id don't cover each other. Each row is judged on the input as it is; a repeated row is
    judged as often as it stands there. A text of any length is read whole. ``verbatim``: a text that loses
    nothing keeps its white space. Kept columns may have any names; one that is called like a column of the result
    comes back with ``given_`` before its name.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*([F.col(f"`{c}`") for c in keep] or [F.lit(0)])).alias("row")).withColumn("order", F.coalesce("doc_id", F.lit(_NEVER))).withColumn("key", F.xxhash64("text"))
    copies, covered = covered_windows(rows, window, phrase, shard, in_hand)
    merged = covered.groupBy("order", "key").agg(F.collect_list("at").alias("found")).withColumn("copy", F.lit(False))  # no more than the document has words
    gone = merged.unionByName(copies.select("order", "key", F.lit(None).cast("array<int>").alias("found"), F.lit(True).alias("copy")))
    joined = rows.join(gone, ["order", "key"], "left")
    names = ["doc_id", "row"]
    own = T.StructType([*[rows.schema[n] for n in names], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    found = joined.select(*names, "text", "copy", "found").mapInArrow(_kept(names, window, verbatim), own)
    taken = {"doc_id", "n_words", "n_removed", "kept"}
    return found.select("doc_id", *[F.col(f"row.`{c}`").alias(f"given_{c}" if c in taken else c) for c in keep], "n_words", "n_removed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    found = remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS own FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM texts)),
least AS (SELECT own, min(doc_id) AS first FROM windows GROUP BY own HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM windows JOIN least USING (own) WHERE doc_id > first) GROUP BY doc_id),
held AS (
    SELECT doc_id, words, CASE WHEN places IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda p: NOT list_contains(places, p)), lambda p: words[p]) END AS kept
    FROM texts LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(words) AS n_words, len(words) - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM held
"""
