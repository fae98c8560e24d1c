"""Zipped XML: what is written comes back, foreign files are read, broken ones are rows with an error."""

import io
import zipfile

from pyspark.sql import functions as F

from tessera.sources import office

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
SHOW = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(**targets):
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


BOOK = packed({
    "xl/workbook.xml": f'<workbook {MAIN}><sheets><sheet name="Second" sheetId="2" r:id="b"/><sheet name="First" sheetId="1" r:id="a"/><sheet name="Gone" sheetId="3" r:id="c"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": rels(a="worksheets/sheet1.xml", b="/xl/worksheets/sheet2.xml", c="worksheets/sheet3.xml"),
    "xl/sharedStrings.xml": f"<sst {MAIN}><si><t>one</t></si><si><r><t>t</t></r><r><t xml:space='preserve'>wo </t></r></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {MAIN}><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="AA2"><v>1.5</v></c></row><row r="3"><c r="A3"/></row><row r="5"><c t="b"><v>1</v></c><c t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": f'<worksheet {MAIN}><sheetData><row><c><f>1+1</f><v>2</v></c></row></sheetData></worksheet>',
})
LETTER = packed({
    "word/document.xml": f"<w:document {WORD}><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>there</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t> a </w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc/></w:tr></w:tbl><w:p><w:r><w:t>Bye</w:t><w:br/></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>z</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
    "word/header1.xml": f"<w:hdr {WORD}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>",
})
SLIDES = packed({
    "ppt/presentation.xml": f'<p:presentation {SHOW}><p:sldIdLst><p:sldId id="257" r:id="y"/><p:sldId id="256" r:id="x"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": rels(x="slides/slide1.xml", y="slides/slide2.xml"),
    "ppt/slides/slide1.xml": f"<p:sld {SHOW}><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>Old</a:t></a:r></a:p></p:txBody></p:sp><p:sp/></p:spTree></p:cSld></p:sld>",
    "ppt/slides/slide2.xml": f"<p:sld {SHOW}><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>New</a:t></a:r></a:p><a:p><a:r><a:t>line</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>",
})


def rows(content):
    return [tuple(x) for x in office.parts(content)]


def test_files_of_other_programs():
    assert rows(BOOK) == [("sheet", "Second", 1, ["2"], None), ("sheet", "First", 2, ["", "two ", *[""] * 24, "1.5"], None), ("sheet", "First", 5, ["True", "x"], None), ("sheet", "Gone", None, None, "KeyError: no part xl/worksheets/sheet3.xml")]
    assert rows(LETTER) == [("paragraph", "body", 1, ["Hello\tthere"], None), ("paragraph", "body", 2, ["Bye\n"], None), ("table", "1", 1, ["a", "b\nc"], None), ("table", "2", 1, ["z"], None), ("header", "header1", 1, ["Head"], None)]
    assert rows(SLIDES) == [("slide", "1", 1, ["New\nline"], None), ("slide", "2", 1, ["Old"], None)]


def test_what_is_written_comes_back():
    book = office.workbook({"a/b": [[1, 2.5, "x<&\x00\n y ", None, True, float("nan")], [], [None]], "A b": [["ä"]], "a b": iter([["z"] * 30]), "": []})
    assert rows(book) == [("sheet", "a b", 1, ["1", "2.5", "x<&\n y ", "", "True", "nan"], None), ("sheet", "A b_2", 1, ["ä"], None), ("sheet", "a b_3", 1, ["z"] * 30, None)]
    assert book == office.workbook({"a/b": [[1, 2.5, "x<&\x00\n y ", None, True, float("nan")], [], [None]], "A b": [["ä"]], "a b": iter([["z"] * 30]), "": []})
    long = "w " * 300_000
    assert rows(office.letter(["one", " ", "", long])) == [("paragraph", "body", 1, ["one"], None), ("paragraph", "body", 2, [long], None)]


def test_broken_files_are_rows_with_an_error(spark, tmp_path):
    cut = packed({"xl/workbook.xml": f'<workbook {MAIN}><sheets><sheet name="s" r:id="a"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(a="s.xml"), "xl/s.xml": f"<worksheet {MAIN}><sheetData><row><c><v>1</v></c></row><row><c t='s'><v>7</v></c></row></sheetData></worksheet>"})
    found = {"good.xlsx": BOOK, "letter.docx": LETTER, "show.pptx": SLIDES, "bad.xlsx": b"no zip", "half.docx": LETTER[: len(LETTER) // 2], "other.zip": packed({"a": "b"}), "cut.xlsx": cut, "xml.docx": packed({"word/document.xml": "<a><b></a>"})}
    for name, content in found.items():
        (tmp_path / name).write_bytes(content)
    got = office.files(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    errors = {r.path: r.error for r in got.filter("error IS NOT NULL").collect()}
    assert set(errors) == set(found) - {"letter.docx", "show.pptx"}
    assert errors["other.zip"].startswith("ValueError") and errors["cut.xlsx"].startswith("IndexError")
    assert got.filter("path = 'cut.xlsx' AND error IS NULL").count() == 1  # what was read before stays
    assert office.parsed(spark.createDataFrame([("n", None)], "path string, content binary")).first().error is not None


def test_large_groups_take_several_workbooks(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "a").alias("book"), (F.col("id") % 2).alias("sheet"), (1000 - F.col("id")).alias("id"), F.col("id").cast("string").alias("text"))
    files = office.workbooks(df, "book", "sheet", ["id"], ["id", "text"], 250)
    back = office.parsed(files).filter("number > 1")
    assert files.count() >= 4 and back.count() == 1000 and back.filter("path LIKE '-%'").count() == 100
    each = back.groupBy("path", "part").agg(F.array_sort(F.collect_list(F.struct("number", F.col("cells")[0].cast("int").alias("id")))).alias("rows")).collect()
    assert all([r.id for r in x.rows] == sorted(r.id for r in x.rows) for x in each)
