"""Token counts and ids, one distinct pre-token at a time.

A text is cut into units that the tokenizer treats one by one, so its tokens are those of its units. The
tokenizer here drops white space, and neither its pieces nor its special strings run over white space: each
word (between blanks, tabs and line ends) is a unit on its own. A word of plain characters (ASCII without the
apostrophe, and the Latin-1 letters) is cut further, into runs of letters, digits and runs of other signs, as
the pre-tokenizer does it; lower-casing changes none of its tokens. A word with any other character, an
apostrophe or the start of a special string stays whole, and the library cuts it. That holds for one
normaliser and pre-tokenizer: files with others are refused.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import common, hashing

LIMIT = 2048
#: Units that are looked up without a shuffle: so many, no longer than this many bytes each.
HEAD_UNITS, HEAD_BYTES = 50_000, 32
#: And no rarer than one in so many units of the corpus.
SHARE = 2_000_000
#: Distinct units that a task holds before it passes their counts on; plain units that the library gets in one string.
HELD, JOINED = 200_000, 256
#: The normaliser and the pre-tokenizer that units() is true to.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")

_BLANK, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x20:0x7F] = _SIGN
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = _BLANK
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = _LETTER
_CLASS[ord("'")] = _ODD
_LATIN, _TIMES, _DIVIDED, _LAST_UPPER = 0xC3, 0x97, 0xB7, 0x9E  # in UTF-8 the Latin-1 letters are this byte and another; two of them are signs


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def units(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """(units of all texts, in order; first): those of row i are first[i] to first[i + 1]. A null text has none."""
    raw, at = hashing.text_bytes(texts)
    kind = _CLASS[raw]
    latin = np.flatnonzero(raw == _LATIN)
    second = raw[latin + 1]
    kind[latin + 1] = kind[latin] = np.where((second == _TIMES) | (second == _DIVIDED), _ODD, _LETTER)
    kind[:-1][(raw[:-1] == ord("<")) & (raw[1:] == ord("|"))] = _ODD
    low = raw.copy()
    low[(raw >= ord("A")) & (raw <= ord("Z"))] += 32
    low[latin[(second <= _LAST_UPPER) & (second != _TIMES)] + 1] += 32
    ink = kind != _BLANK
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    edge[1:-1] |= ~ink[:-1]
    word = ink & edge[:-1]
    start = kind == _DIGIT
    start[1:] |= kind[1:] != kind[:-1]
    start = ink & (start | word)
    if (odd := np.flatnonzero(kind == _ODD)).size:
        number = np.cumsum(word, dtype=np.int32)
        whole = np.zeros(int(number[-1]) + 1, bool)
        whole[number[odd]] = True
        whole = whole[number]
        start &= ~whole | word
        low[whole] = raw[whole]
    begin = np.flatnonzero(start[ink])
    first = np.searchsorted(begin, np.r_[0, np.cumsum(ink)][at])
    data = low[ink]
    offsets = np.r_[begin, len(data)].astype(np.int32)
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data)), first


def is_plain(unit: str) -> bool:
    """Whether a unit has plain characters only, so that it is one pre-token whatever stands beside it behind a blank."""
    return _PLAIN.fullmatch(unit) is not None and "<|" not in unit


_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer in a file, if units() cuts as it does; else a ValueError."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        normalizers = [x["type"] for x in (said.get("normalizer") or {}).get("normalizers", [])]
        cuts = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = cuts[0].get("pattern", {}).get("Regex") if cuts else None
        if normalizers != NORMALIZERS or pattern != PATTERN or said["model"].get("end_of_word_suffix") != WORD_END:
            raise ValueError(f"{path}: texts are cut for a tokenizer that lower-cases, drops white space and ends words with {WORD_END}")
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


_ends: dict[str, np.ndarray] = {}


def encode(found: list[str], path: str) -> list[bytes]:
    """The ids of each unit, four bytes each (little-endian). Plain units go to the library many at a time, in one string, and word ends tell them apart."""
    t = tokenizer(path)
    if path not in _ends:
        vocabulary = t.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for piece, i in vocabulary.items() if piece.endswith(WORD_END)]] = True
        _ends[path] = ends
    plain = [i for i, u in enumerate(found) if is_plain(u)]
    groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
    out: list[bytes] = [b""] * len(found)
    for group, e in zip(groups, t.encode_batch_fast([" ".join(map(found.__getitem__, g)) for g in groups], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, "<u4")
        ends = (np.flatnonzero(_ends[path][ids]) + 1) * 4
        if len(ends) != len(group):
            raise ValueError(f"{path}: {len(group)} pre-tokens have {len(ends)} word ends")
        raw, begin = ids.tobytes(), 0
        for i, end in zip(group, ends.tolist(), strict=True):
            out[i], begin = raw[begin:end], end
    others = sorted(set(range(len(found))).difference(plain))
    for i, e in zip(others, t.encode_batch_fast([found[i] for i in others], add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, "<u4").tobytes()
    return out


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """(unit, n, pieces): each distinct unit of the corpus, how often it occurs and its number of tokens."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("unit").aggregate([("n", "sum")]).rename_columns(["unit", "n"])

        for batch in batches:
            for some in hashing.slices(batch):
                code = units(some.column("text"))[0].dictionary_encode()
                held.append(pa.table({"unit": code.dictionary, "n": pa.array(np.bincount(code.indices.to_numpy(), minlength=len(code.dictionary)), pa.int64())}))
                if sum(x.num_rows for x in held) > 2 * HELD:
                    held = [summed()]
                    if held[0].num_rows > HELD:
                        yield from held[0].combine_chunks().to_batches()
                        held = []
        if held:
            yield from summed().combine_chunks().to_batches()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                some = batch.slice(at, 20_000)
                pieces = [len(x) // 4 for x in encode(some.column("unit").to_pylist(), path)]
                yield pa.RecordBatch.from_arrays([some.column("unit"), some.column("n"), pa.array(pieces, pa.int32())], ["unit", "n", "pieces"])

    counted = docs.select("text").mapInArrow(seen, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return common.written(counted.mapInArrow(cut, "unit string, n long, pieces int"), "vocabulary")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, head_units: int = HEAD_UNITS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of (doc_id, text, ...).

    Pieces are counted once for each distinct unit. Frequencies of units in a document meet those counts by
    join; the ``head_units`` commonest short units, of bounded size, meet them where the text is read, so no
    common unit is shuffled. A null text counts as empty; a repeated row is counted as a row of its own. A text
    of any length is counted whole, in one go. ``path``: a file that tokenizer() takes.
    """
    path = path or default_vocabulary()
    tokenizer(path)
    known = vocabulary(docs, path)
    total = known.agg(F.sum("n")).first()[0] or 0
    often = known.filter((F.octet_length("unit") <= HEAD_BYTES) & (F.col("n") >= total // SHARE))  # SHARE units at most, so few rows reach the driver
    head = {r.unit: r.pieces for r in often.orderBy(F.desc("n"), "unit").limit(head_units).collect()}
    shipped = docs.sparkSession.sparkContext.broadcast(head)
    kind = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n", pa.int64()), ("unit", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_units = shipped.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in hashing.slices(batch):
                n = some.num_rows
                cut, first = units(some.column("text"))
                code = cut.dictionary_encode()
                pieces = np.fromiter((common_units.get(u, -1) for u in code.dictionary.to_pylist()), np.int64, len(code.dictionary))
                place, own = np.repeat(np.arange(n), np.diff(first)), code.indices.to_numpy()
                often = pieces[own] >= 0
                sums = np.bincount(place[often], pieces[own[often]], n).astype(np.int64)
                cells, times = np.unique(place[~often] * max(1, len(pieces)) + own[~often], return_counts=True)
                cuts = pa.array(np.searchsorted(cells, np.arange(n + 1) * max(1, len(pieces))), pa.int32())
                rest = code.dictionary.take(pa.array(cells % max(1, len(pieces)), pa.int32()))
                size = pc.fill_null(pc.binary_length(some.column("text")), 0)
                lists = [pa.ListArray.from_arrays(cuts, x) for x in (rest, pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + n), pa.int64()), some.column("doc_id").cast(pa.int64()), size.cast(pa.int64()), pa.array(sums), *lists], schema=kind)
                row += n

    parts = common.written(common.fresh(docs, "doc_id", "text").mapInArrow(frequencies, "row long, doc_id long, n_bytes long, n long, unit array<string>, times array<int>"), "frequencies")
    rare = parts.select("row", F.explode(F.arrays_zip("unit", "times")).alias("u")).select("row", F.col("u.unit").alias("unit"), F.col("u.times").alias("times"))
    rare = rare.join(known.select("unit", "pieces"), "unit").select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), (F.col("times") * F.col("pieces")).cast("long").alias("n"))
    every = parts.select("row", "doc_id", "n_bytes", "n").unionByName(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return every.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document: doc_id, n_bytes, n_tokens, over_limit."""
    return count_tokens(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
