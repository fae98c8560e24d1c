"""Chunkers by name behind one table function: which one cuts, and with what options, is said in the call.

    register(spark, {"chunker": "recursive", "size": 512})
    SELECT d.doc_id, c.* FROM documents d, LATERAL chunks(d.text) c
    SELECT d.doc_id, c.* FROM documents d, LATERAL chunks(d.text, chunker => 'sliding', size => 128) c

The columns are those of the chunker that is named: Spark asks the function for them when it analyses the query.
Options that a call leaves out or sets to null are those of the session, and then the chunker's own. ``size`` and ``overlap`` may be
columns, so that each text can have its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.chunking import split_text

FIRST = (T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk", T.StringType()))


@dataclass(frozen=True)
class Chunker:
    """A way to cut a text: what it is asked with, and which columns each chunk has besides its number and its text."""

    split: Callable[[str, int, int], Iterator[tuple]]
    size: int
    overlap: int
    more: tuple[T.StructField, ...] = ()


def recursive(text: str, size: int, overlap: int) -> Iterator[tuple]:
    """Pieces of at most ``size`` characters at the coarsest separator that serves."""
    for piece in split_text(text, size, overlap):
        yield piece, len(piece)


def sliding(text: str, size: int, overlap: int) -> Iterator[tuple]:
    """Windows of ``size`` words; each begins ``size - overlap`` words after the one before, and the last one holds the last word."""
    words = text.split()
    step = max(1, size - overlap)
    for begin in range(0, max(1, len(words) - size + step), step):
        if part := words[begin : begin + size]:
            yield " ".join(part), begin, len(part)


def lines(text: str, size: int, overlap: int) -> Iterator[tuple]:
    """Whole lines while they have ``size`` characters at most, line ends between them counted; a longer line is a chunk of its own."""
    held: list[str] = []
    length = first = 0
    for n, line in enumerate(text.split("\n") if text else []):
        if held and length + 1 + len(line) > size:
            yield "\n".join(held), first, len(held)
            held, length, first = [], 0, n
        length += len(line) + (1 if held else 0)
        held.append(line)
    if held:
        yield "\n".join(held), first, len(held)


def _column(name: str) -> T.StructField:
    return T.StructField(name, T.IntegerType())


BUILT_IN = {
    "recursive": Chunker(recursive, 512, 80, (_column("n_chars"),)),
    "sliding": Chunker(sliding, 128, 32, (_column("begin_word"), _column("n_words"))),
    "lines": Chunker(lines, 3800, 0, (_column("first_line"), _column("n_lines"))),
}


@dataclass
class Chosen(AnalyzeResult):
    name: str = field(default="")


def register(spark: SparkSession, settings: dict[str, object] | None = None, chunkers: dict[str, Chunker] | None = None, name: str = "chunks") -> None:
    """Makes the table function ``name`` (text, chunker, size, overlap) known to the session.

    ``settings``: what calls that don't say so take; ``chunkers``: others than the three here, by name. A chunker that no one
    knows, and one that no call and no setting names, is an error when the query is analysed. A null or empty text has no chunks.
    """
    known, given = BUILT_IN | (chunkers or {}), dict(settings or {})

    class Chunks:
        @staticmethod
        def analyze(text: AnalyzeArgument, chunker: AnalyzeArgument | None = None, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
            if chunker is not None and not chunker.isConstantExpression:
                raise ValueError("the chunker's name must be a constant: the columns depend on it")
            asked = (chunker.value if chunker else None) or given.get("chunker")
            if asked not in known:
                raise ValueError(f"no chunker named {asked}; there are {sorted(known)}")
            return Chosen(schema=T.StructType([*FIRST, *known[asked].more]), name=asked)

        def __init__(self, chosen: Chosen) -> None:
            self.chunker = known[chosen.name]

        def eval(self, text: str, chunker: str | None = None, size: int | None = None, overlap: int | None = None):  # noqa: A003
            n = size if size is not None else given.get("size", self.chunker.size)
            shared = overlap if overlap is not None else given.get("overlap", min(self.chunker.overlap, n // 4))
            if n < 1 or shared < 0:
                raise ValueError(f"chunks of {n} that share {shared}")
            for i, found in enumerate(self.chunker.split(text or "", n, shared)):
                yield i, *found

    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(Chunks))
