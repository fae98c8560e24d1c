"""Workbooks, documents and slides in zipped XML, read and written with the standard library.

The XML of a part is read as a stream, so memory follows a row, a paragraph or a slide (and a workbook's shared strings), not
the file. A file that can't be read, or a part of it, becomes a row with an error; the job goes on.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: kind: sheet, paragraph, table, header, slide; part: the sheet's name or the part's number; number: the row's, or the place in the part.
ROWS = "path string, kind string, part string, number int, cells array<string>, error string"
_FIELDS = pa.schema([("path", pa.string()), ("kind", pa.string()), ("part", pa.string()), ("number", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())])
#: What XML can't hold.
_FOREIGN = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
#: A part may unpack to so many bytes; a larger one is an error, not a full disk or memory.
LARGEST = 2_000_000_000


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _relation(element: ElementTree.Element) -> str:
    """The id of the part that an element stands for."""
    return next((v for k, v in element.attrib.items() if k.endswith("}id")), "")


def _stream(book: zipfile.ZipFile, name: str, wanted: str) -> Iterator[ElementTree.Element]:
    """Each outermost element of that name, freed after it was looked at."""
    if book.getinfo(name).file_size > LARGEST:
        raise ValueError(f"{name} unpacks to {book.getinfo(name).file_size} bytes")
    with book.open(name) as f:
        stack, inside = [], 0
        for event, element in ElementTree.iterparse(f, ("start", "end")):
            mine = _tag(element) == wanted
            if event == "start":
                stack.append(element)
                inside += mine
                continue
            stack.pop()
            inside -= mine
            if mine and not inside:
                yield element
            if not inside:
                element.clear()
                if stack:
                    del stack[-1][:]


def _related(book: zipfile.ZipFile, name: str) -> dict[str, str]:
    """The parts that a part points to, by id."""
    folder, base = posixpath.split(name)
    rels = f"{folder}/_rels/{base}.rels".lstrip("/")
    if rels not in book.namelist():
        return {}
    found = {}
    for r in ElementTree.fromstring(book.read(rels)):
        target = r.get("Target", "")
        found[r.get("Id", "")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
    return found


def _text(element: ElementTree.Element) -> str:
    """The text runs of an element; tabs and breaks as themselves."""
    out = []
    for x in element.iter():
        if _tag(x) == "t":
            out.append(x.text or "")
        elif _tag(x) in ("br", "cr"):
            out.append("\n")
        elif _tag(x) == "tab" and len(x) == 0 and not x.attrib:
            out.append("\t")
    return "".join(out)


def _column(reference: str) -> int:
    n = 0
    for sign in reference:
        if not sign.isalpha():
            break
        n = 26 * n + ord(sign.upper()) - 64
    return n - 1


def sheets(book: zipfile.ZipFile) -> Iterator[tuple]:
    """(kind, part, number, cells, error): the rows of each sheet that hold anything, in the workbook's order; gaps between cells are empty strings."""
    names = book.namelist()
    shared = [_text(x) for x in _stream(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
    parts = _related(book, "xl/workbook.xml")
    for sheet in _stream(book, "xl/workbook.xml", "sheet"):
        title, part = sheet.get("name", ""), parts.get(_relation(sheet), "")
        if part not in names:
            yield "sheet", title, None, None, f"KeyError: no part {part}"
            continue
        number = 0
        for row in _stream(book, part, "row"):
            number = int(row.get("r") or number + 1)
            cells: list[str] = []
            for cell in row:
                at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
                cells += [""] * (at + 1 - len(cells))
                value = next((x.text or "" for x in cell if _tag(x) == "v"), "")
                kind = cell.get("t", "n")
                cells[at] = shared[int(value)] if kind == "s" and value else _text(cell) if kind == "inlineStr" else {"1": "True", "0": "False"}.get(value, value) if kind == "b" else value
            if any(cells):
                yield "sheet", title, number, cells, None


def document(book: zipfile.ZipFile) -> Iterator[tuple]:
    """Paragraphs of a document that aren't blank, then the rows of its tables, then headers and footers."""
    tables: list[tuple] = []
    n = 0

    def body() -> Iterator[ElementTree.Element]:
        with book.open("word/document.xml") as f:
            path: list[ElementTree.Element] = []
            for event, element in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    path.append(element)
                    continue
                path.pop()
                if path and _tag(path[-1]) == "body":
                    yield element
                    del path[-1][:]

    for block in body():
        if _tag(block) == "p":
            text = _text(block)
            if text.strip():
                n += 1
                yield "paragraph", "body", n, [text], None
        elif _tag(block) == "tbl":
            number = len({t[1] for t in tables}) + 1
            rows = [[_paragraphs(cell).strip() for cell in row if _tag(cell) == "tc"] for row in block if _tag(row) == "tr"]
            tables += [("table", str(number), i, row, None) for i, row in enumerate(rows, 1) if any(row)]
    yield from tables
    for name in sorted(x for x in book.namelist() if re.fullmatch(r"word/(header|footer)\d*\.xml", x)):
        for i, p in enumerate((x for x in _stream(book, name, "p") if _text(x).strip()), 1):
            yield "header", posixpath.basename(name)[:-4], i, [_text(p)], None


def _paragraphs(element: ElementTree.Element) -> str:
    return "\n".join(_text(x) for x in element.iter() if _tag(x) == "p")


def slides(book: zipfile.ZipFile) -> Iterator[tuple]:
    """The texts of each slide's shapes that aren't blank, in the order of the show."""
    parts = _related(book, "ppt/presentation.xml")
    order = [parts.get(_relation(x), "") for x in _stream(book, "ppt/presentation.xml", "sldId")]
    for slide, part in enumerate(order, 1):
        if part not in book.namelist():
            yield "slide", str(slide), None, None, f"KeyError: no part {part}"
            continue
        n = 0
        for shape in _stream(book, part, "sp"):
            text = _paragraphs(shape)
            if text.strip():
                n += 1
                yield "slide", str(slide), n, [text], None


READERS = {"xl/workbook.xml": sheets, "word/document.xml": document, "ppt/presentation.xml": slides}


def parts(content: bytes) -> Iterator[tuple]:
    """(kind, part, number, cells, error) of a file, by what is in it, whatever its name is."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            reader = next((r for name, r in READERS.items() if name in book.namelist()), None)
            if reader is None:
                raise ValueError("neither a workbook nor a document nor slides")
            yield from reader(book)
    except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, IndexError, EOFError, NotImplementedError, RuntimeError, OSError, UnicodeError) as problem:
        yield None, None, None, None, f"{type(problem).__name__}: {problem}"


def parsed(files: DataFrame) -> DataFrame:
    """ROWS of (path, content): a row for each row of a sheet, paragraph, row of a table or shape of a slide. What was read before an error stays. A null content is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = []
                for row in parts(content or b""):
                    held.append((path, *row))
                    if len(held) >= 10_000:
                        yield _batch(held)
                        held = []
                yield _batch(held)

    return files.select("path", "content").mapInArrow(read, ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)], schema=_FIELDS)


def files(spark: SparkSession, path: str) -> DataFrame:
    """parsed() of the files below ``path``; Spark's reader passes over those of no bytes."""
    return parsed(spark.read.format("binaryFile").load(path))


def line(kind: Column, cells: Column) -> Column:
    """A row as a line of text: a sheet's cells with commas, a table's with bars."""
    return F.when(kind == "table", F.array_join(cells, " | ")).otherwise(F.array_join(cells, ", "))


# writing

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def xml_text(text: str) -> str:
    """Text as XML holds it; signs that it can't hold are left out."""
    return escape(_FOREIGN.sub("", text))


def _packed(parts: Iterable[tuple[str, Iterable[str]]], types: str, root: tuple[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:

        def put(name: str, pieces: Iterable[str]) -> None:
            with book.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w") as f:  # no time: the same rows give the same bytes
                f.write(_HEAD.encode())
                for piece in pieces:
                    f.write(piece.encode())

        put("[Content_Types].xml", [f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>'])
        put("_rels/.rels", [f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="{root[0]}"/></Relationships>'])
        for name, pieces in parts:
            put(name, pieces)
    return out.getvalue()


def workbook(tables: dict[str, Iterable[list[object]]]) -> bytes:
    """A workbook with a sheet for each name (31 characters of it at most, signs that names can't have as blanks, later equal ones numbered); numbers as numbers, all else as text, None as no cell."""
    office = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    titles: list[str] = []
    for name in tables:
        base, n = re.sub(r"[\[\]:*?/\\]", " ", name)[:31] or "Sheet", 1
        title = base
        while title.lower() in (t.lower() for t in titles):
            n += 1
            title = f"{base[: 31 - len(str(n)) - 1]}_{n}"
        titles.append(title)

    def sheet(rows: Iterable[list[object]]) -> Iterator[str]:
        yield f'<worksheet xmlns="{_MAIN}"><sheetData>'
        for r, row in enumerate(rows, 1):
            cells = []
            for c, value in enumerate(row):
                if value is None:
                    continue
                at, k = "", c + 1
                while k:
                    k, rest = divmod(k - 1, 26)
                    at = chr(65 + rest) + at
                number = isinstance(value, int | float) and not isinstance(value, bool) and value == value and abs(value) != float("inf")
                cells.append(f'<c r="{at}{r}"><v>{value!r}</v></c>' if number else f'<c r="{at}{r}" t="inlineStr"><is><t xml:space="preserve">{xml_text(str(value))}</t></is></c>')
            yield f'<row r="{r}">{"".join(cells)}</row>'
        yield "</sheetData></worksheet>"

    listed = "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, t in enumerate(titles, 1))
    rels = "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(titles) + 1))
    types = f'<Override PartName="/xl/workbook.xml" ContentType="{office}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{office}.worksheet+xml"/>' for i in range(1, len(titles) + 1))
    whole = [("xl/workbook.xml", [f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>']), ("xl/_rels/workbook.xml.rels", [f'<Relationships xmlns="{_PACKAGE}/relationships">{rels}</Relationships>'])]
    return _packed([*whole, *((f"xl/worksheets/sheet{i}.xml", sheet(rows)) for i, rows in enumerate(tables.values(), 1))], types, ("xl/workbook.xml", ""))


def letter(paragraphs: Iterable[str]) -> bytes:
    """A document of paragraphs."""
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"

    def pieces() -> Iterator[str]:
        yield f'<w:document xmlns:w="{_WORD}"><w:body>'
        for p in paragraphs:
            yield f'<w:p><w:r><w:t xml:space="preserve">{xml_text(p)}</w:t></w:r></w:p>'
        yield "</w:body></w:document>"

    return _packed([("word/document.xml", pieces())], f'<Override PartName="/word/document.xml" ContentType="{kind}"/>', ("word/document.xml", ""))


def workbooks(df: DataFrame, book: str, sheet: str, order: list[str], columns: list[str], rows_a_file: int = 100_000) -> DataFrame:
    """(path, content): workbooks ``<book>-<n>.xlsx`` with a sheet for each value of ``sheet`` that has a header and the rows in ``order``.

    A value of ``book`` may have any number of rows: they are dealt to files of about ``rows_a_file``, each of which one task writes; files get
    rows by a hash, so each sheet of each file is in order, not the row of files. A null name is an empty one.
    """
    from pyspark.sql import types as T

    sizes = df.groupBy(F.coalesce(F.col(book).cast("string"), F.lit("")).alias("_of")).agg(F.ceil(F.count("*") / rows_a_file).alias("_files"))
    rows = df.select(F.coalesce(F.col(book).cast("string"), F.lit("")).alias("_book"), F.coalesce(F.col(sheet).cast("string"), F.lit("")).alias("_sheet"), F.xxhash64(*order).alias("_h"), F.struct(*order).alias("_o"), F.struct(*columns).alias("_r"))
    rows = rows.join(sizes, F.col("_book") == F.col("_of")).withColumn("_file", F.pmod("_h", F.col("_files"))).drop("_h", "_of", "_files")

    def write(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("_sheet", "ascending")])
        tables: dict[str, list] = {}
        for name, o, r in zip(group.column("_sheet").to_pylist(), group.column("_o").to_pylist(), group.column("_r").to_pylist(), strict=True):
            tables.setdefault(name, []).append((tuple(o.values()), list(r.values())))
        content = workbook({name: [columns, *(r for _, r in sorted(found, key=lambda x: [(v is None, v) for v in x[0]]))] for name, found in tables.items()})
        return pa.table({"path": pa.array([f"{key[0].as_py()}-{key[1].as_py()}.xlsx"]), "content": pa.array([content], pa.binary())})

    return rows.groupBy("_book", "_file").applyInArrow(write, T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())]))
