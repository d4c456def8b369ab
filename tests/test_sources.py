"""Office packages, images, the parser registry and sinks."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.sources import images, markdown, office, registry, sinks

W = 'xmlns:w="http://x/w" xmlns:r="http://x/r" xmlns:a="http://x/a" xmlns:p="http://x/p"'
REL = '<Relationships xmlns="http://x/rel">{}</Relationships>'




def files(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = files({
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Hello</w:t><w:br/><w:t>you</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p><a:blip r:embed="i1"/></w:p></w:body></w:document>',
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
    "word/_rels/document.xml.rels": REL.format('<Relationship Id="i1" Type="http://x/image" Target="media/p.png"/>'),
    "word/media/p.png": b"?",
})
XLSX = files({
    "xl/workbook.xml": f'<workbook {W}><sheets><sheet name="S" r:id="s1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": REL.format('<Relationship Id="s1" Type="http://x/worksheet" Target="worksheets/sheet1.xml"/>'),
    "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>",
    "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2</v></c></row><row><c r="A2" s="1"><v>45292</v></c></row><row><c r="D7"><f>SUM(A1)</f></c></row></sheetData></worksheet>',
})
PPTX = files({
    "ppt/presentation.xml": f'<p:presentation {W}><p:sldIdLst><p:sldId r:id="s2"/></p:sldIdLst><p:sldSz cx="100" cy="100"/></p:presentation>',
    "ppt/_rels/presentation.xml.rels": REL.format('<Relationship Id="s2" Type="http://x/slide" Target="slides/slide1.xml"/>'),
    "ppt/slides/slide1.xml": f'<p:sld {W}><p:sp><a:off x="50" y="50"/><a:ext cx="10" cy="10"/><a:p><a:t>right</a:t></a:p></p:sp><p:sp><a:off x="10" y="50"/><a:p><a:t>left</a:t></a:p></p:sp><p:sp><p:ph type="title"/><a:off x="0" y="0"/><a:p><a:t>Title</a:t></a:p></p:sp></p:sld>',
})


def test_docx():
    blocks, warnings = office.read_docx(DOCX)
    assert [(b["kind"], b["text"]) for b in blocks] == [("heading", "# Top"), ("paragraph", "Hello\nyou"), ("list", "  - item"), ("table", "| a\\|b |  |\n| --- | --- |"), ("figure", "![](asset://p.png)")]
    assert not warnings and blocks[1]["place"] == {"section": ["Top"]}


def test_xlsx_regions_dates_and_formulas():
    blocks, warnings = office.read_xlsx(XLSX)
    assert [b["place"]["range"] for b in blocks] == ["A1:B2", "D7:D7"]
    assert "2024-01-01" in blocks[0]["text"] and "=SUM(A1)" in blocks[1]["text"] and len(warnings) == 1


def test_pptx_reads_by_rows():
    blocks, _ = office.read_pptx(PPTX)
    assert [b["text"] for b in blocks] == ["### Title", "left", "right"] and office.to_markdown(blocks).startswith("## Slide 1\n\n### Title")


def test_packages_that_inflate_too_far_are_refused():
    with pytest.raises(office.LimitError):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a", b"0" * (8 << 20))
        office.open_package(out.getvalue())


def test_regions_of_cells():
    cells = {(r, c): "x" for r, c in ((1, 1), (1, 2), (2, 1), (2, 5), (9, 9))}
    assert office.cell_regions(cells) == [(1, 1, 2, 2), (2, 5, 2, 5), (9, 9, 9, 9)]
    assert office.cell_regions(cells, [(1, 1, 9, 9)]) == [(1, 1, 9, 9)]


def test_letters():
    assert [office.column_letters(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"] and office.column_number("AAA") == 703


def test_images():
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 3, 5)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 7, 9) + b"\0" * 8
    assert (images.sniff(png), images.dimensions(png)) == ("image/png", (3, 5)) and images.dimensions(jpeg) == (9, 7)
    assert images.dimensions(b"GIF89a" + struct.pack("<HH", 2, 0)) is None and images.sniff(b"?", "x") == "x"


def test_registry(spark, tmp_path):
    for name, data in {"a.MD": b"# T\r\n\r\nbody", "b.docx": DOCX, "c.xlsx": XLSX, "d.bin": b"?", "e.txt": b"\xff", "f.pptx": b"no zip"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in registry.parse(registry.read_files(spark, str(tmp_path))).collect()}
    assert {k: r.status for k, r in got.items()} == {"a.MD": "ready", "b.docx": "ready", "c.xlsx": "review", "d.bin": "failed", "e.txt": "failed", "f.pptx": "failed"}
    assert got["a.MD"].markdown == "# T\n\nbody" and got["c.xlsx"].markdown.startswith("## S\n\n")
    few = registry.read_files(spark, str(tmp_path), max_bytes=5)
    assert few.filter("content is not null").count() == 2
    long = {r.path.rsplit("/", 1)[-1]: (r.status, r.error) for r in registry.parse(few).collect()}
    assert len(long) == 6 and long["a.MD"] == ("failed", "ValueError: file of 11 bytes is too long")
    typed = few.limit(0).select("path", "content").union(spark.createDataFrame([("name", bytearray(b"# T"))], "path string, content binary")).withColumn("mime", F.lit("text/markdown"))
    assert [(r.format, r.status) for r in registry.parse(typed).collect()] == [("md", "ready")]


def test_tables_on_both_sides(spark):
    rows = [["a", "b|c", "d\ne"], ["1"]]
    df = spark.createDataFrame([(rows,)], "rows array<array<string>>")
    assert df.select(markdown.table_column(F.col("rows"))).first()[0] == markdown.table(rows)


def test_sinks(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame(list(v), "k long, v string")
    path = str(tmp_path / "t")
    sinks.replace_partitions(rows((1, "a"), (2, "b")), path, "k")
    sinks.replace_partitions(rows((2, "c")), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    assert sorted(map(tuple, sinks.upsert(rows((1, "a"), (2, "b")), rows((2, "z"), (3, "y")), ["k"]).collect())) == [(1, "a"), (2, "z"), (3, "y")]
    assert sorted(map(tuple, sinks.insert_absent(rows((1, "a")), rows((1, "q"), (2, "b")), ["k"]).collect())) == [(1, "a"), (2, "b")]
    assert [r.k for r in sinks.purge({"t": rows((1, "a"), (2, "b"))}, rows((2, "")), "k")["t"].collect()] == [1]


def test_two_columns_are_read_one_after_the_other(spark):
    from quern.sources import positioned

    rows = [("Heading over both", 0.0, 0.0, 600.0)]
    for i in range(4):
        rows += [(f"left {i}", 0.0, 20.0 + 12 * i, 200.0), (f"right {i}", 320.0, 21.0 + 12 * i, 200.0)]
    rows += [("two", 0.0, 100.0, 20.0), ("words", 26.0, 100.5, 30.0)]
    items = spark.createDataFrame([(1, 1, 600.0, t, x, y, w, 10.0, 10.0) for t, x, y, w in rows], "doc long, page int, page_width double, text string, x double, top double, width double, height double, size double")
    got = positioned.page_lines(items).orderBy("line").collect()
    assert [r.text for r in got] == ["Heading over both", *(f"left {i}" for i in range(4)), "two words", *(f"right {i}" for i in range(4))]


def test_structured_chunks_follow_context():
    from quern.operators.chunking import chunk_elements

    text = "alpha beta\ngamma\n| a |\n| - |\n| 1 |\nfooter\ndelta"
    e = lambda a, b, kind="paragraph", **more: {"start": a, "end": b, "kind": kind, "unit": "u", "path": ["A"]} | more
    elements = [e(0, 10), e(11, 16), e(17, 34, "table", markdown=text[17:34]), e(35, 41, searchable=False), e(42, 47, path=["B"])]
    assert [c[2] for c in chunk_elements("v", text, elements)] == ["alpha beta\ngamma", "| a |\n| - |\n| 1 |", "delta"]


def test_elements_join_lines_and_carry_paths(spark):
    from quern.sources import positioned

    rows = [(1, 1, "Head", 3.0, 0.0, 1, None), (1, 2, "exam-", 20.0, 0.0, None, None), (1, 3, "ple text", 31.0, 0.0, None, None), (1, 4, "far below", 90.0, 0.0, None, None), (1, 5, "9", 99.0, 0.0, None, "footer"), (2, 1, "goes on", 10.0, 0.0, None, None), (2, 2, "Sub", 30.0, 0.0, 3, None)]
    df = spark.createDataFrame([(7, p, n, t, x, y, 50.0, 10.0, 10.0, 0, lv, m, 10.0) for p, n, t, y, x, lv, m in rows], "doc long, page int, line int, text string, x double, top double, width double, height double, size double, column_no int, level int, margin string, body double")
    got = [(r.page, r.kind, r.text, r.path) for r in positioned.page_elements(df).orderBy("page", "position").collect()]
    assert got == [(1, "heading", "Head", ["Head"]), (1, "paragraph", "example text", ["Head"]), (1, "paragraph", "far below", ["Head"]), (1, "footer", "9", ["Head"]), (2, "paragraph", "goes on", ["Head"]), (2, "heading", "Sub", ["Head", "Sub"])]


def _workbook(chart="c1", **more):
    """A sheet with three cells, a chart and two pictures over it."""
    draw = 'xmlns:xdr="http://x/xdr" xmlns:c="http://x/c" xmlns:a="http://x/a" xmlns:r="http://x/r"'
    at = lambda tag, row, col: f"<xdr:{tag}><xdr:col>{col}</xdr:col><xdr:row>{row}</xdr:row></xdr:{tag}>"
    cache = lambda tag, *v: f"<c:{tag}>" + "".join(f'<c:pt idx="{i}"><c:v>{x}</c:v></c:pt>' for i, x in reversed(list(enumerate(v)))) + f"</c:{tag}>"
    series = lambda name, cats, *v: f"<c:ser><c:tx><c:strRef>{cache('strCache', name)}</c:strRef></c:tx>" + (f"<c:cat><c:strRef>{cache('strCache', *cats)}</c:strRef></c:cat>" if cats else "") + f"<c:val><c:numRef>{cache('numCache', *v)}</c:numRef></c:val></c:ser>"
    parts = {
        "xl/workbook.xml": f'<workbook {W}><sheets><sheet name="S" r:id="s1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": REL.format('<Relationship Id="s1" Type="http://x/worksheet" Target="worksheets/sheet1.xml"/>'),
        "xl/worksheets/sheet1.xml": f'<worksheet {W}><sheetData><row><c r="A1"><v>1</v></c><c r="B1"><v>2</v></c></row><row><c r="D5"><v>3</v></c></row></sheetData><drawing r:id="d1"/></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": REL.format('<Relationship Id="d1" Type="http://x/drawing" Target="../drawings/drawing1.xml"/>'),
        "xl/drawings/drawing1.xml": f'<xdr:wsDr {draw}><xdr:oneCellAnchor>{at("from", 9, 0)}<xdr:pic><a:blip r:embed="i1"/></xdr:pic></xdr:oneCellAnchor><xdr:twoCellAnchor>{at("from", 1, 2)}{at("to", 7, 4)}<c:chart r:id="{chart}"/></xdr:twoCellAnchor><xdr:oneCellAnchor>{at("from", 11, 0)}<xdr:pic><a:blip r:embed="i2"/></xdr:pic></xdr:oneCellAnchor></xdr:wsDr>',
        "xl/drawings/_rels/drawing1.xml.rels": REL.format('<Relationship Id="c1" Type="http://x/chart" Target="../charts/chart1.xml"/><Relationship Id="i1" Type="http://x/image" Target="../media/a b.png"/><Relationship Id="i2" Type="http://x/image" Target="../media/gone.png"/>'),
        "xl/charts/chart1.xml": f'<c:chartSpace {draw}><c:title><a:t>Sales</a:t><a:t>by year</a:t></c:title>{series("North", ["2020", "2021"], 5, 6, 7, 8, 9, 10)}{series("South", None, 1)}</c:chartSpace>',
        "xl/media/a b.png": b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 3, 5),
    }
    return files(parts | more)


def test_charts_are_reached_from_their_sheet():
    blocks, warnings = office.read_xlsx(_workbook())
    assert [(b["kind"], b["unit"]) for b in blocks] == [("table", "sheet-1-region-1"), ("table", "sheet-1-region-2"), ("heading", "sheet-1-chart-1"), ("figure", "sheet-1-chart-1"), ("table", "sheet-1-chart-1"), ("figure", "sheet-1-image-2")]
    heading, figure, rows, picture = blocks[2:]
    assert heading["text"] == "### Chart: Sales by year (C2:E8)" and heading["place"] == {"sheet": "S", "row_start": 2, "row_end": 8, "range": "C2:E8"}
    # five rows in the summary, all in the table; categories end before the values do
    assert figure["marker"] == "Chart analysis: Sales by year. 2020 | 5 | 1; 2021 | 6 | ; 3 | 7 | ; 4 | 8 | ; 5 | 9 | "
    assert rows["text"].split("\n")[0] == "| Category | North | South |" and rows["text"].split("\n")[-1] == "| 6 | 10 |  |" and rows["text"].count("\n") == 7
    assert picture["text"] == "![](asset://a%20b.png)" and picture["place"]["range"] == "A10:A10"
    assert warnings == ["image 2 is left out: it is missing"]
    assert [b["unit"] for b in office.read_xlsx(_workbook("gone"))[0] if b["kind"] == "heading"] == []
    bare = {"xl/charts/chart1.xml": "<chart><ser><val><v>4</v></val></ser></chart>"}
    assert [b["text"] for b in office.read_xlsx(_workbook(**bare))[0][2:5]] == ["### Chart: Chart 1 (C2:E8)", "> Chart analysis: Chart 1. 1 | 4", "| Category | Series 1 |\n| --- | --- |\n| 1 | 4 |"]
    assert [b["kind"] for b in office.read_xlsx(_workbook(**{"xl/charts/chart1.xml": "<chart/>"}))[0][2:4]] == ["heading", "figure"]


def test_parsed_files_have_structures_that_can_be_looked_up(spark):
    from quern.sources import structure

    rows = [("a.xlsx", bytearray(_workbook())), ("b.pptx", bytearray(PPTX)), ("c.docx", bytearray(DOCX)), ("d.md", bytearray(b"intro\n\n# A\n\n| x\\|y | z |\n| --- | --- |\n| 1 | 2 |"))]
    parsed = registry.parse(spark.createDataFrame(rows, "path string, content binary"))
    stored = structure.read(parsed.select(F.col("path").alias("version_id"), F.col("structure").alias("content"), F.sha2("structure", 256).alias("sha256")))
    assert structure.problems(stored).count() == 0
    found = {}
    for r in structure.elements(stored).orderBy("version_id", "unit_no", "place").collect():
        found.setdefault(r.version_id, []).append(r.element)
    chart = {e.id: e for e in found["a.xlsx"]}
    assert [e.id for e in found["a.xlsx"]] == ["sheet-1-region-1-e1", "sheet-1-region-1-e2", "sheet-1-region-2-e1", "sheet-1-chart-1-e1", "sheet-1-chart-1-e2", "sheet-1-chart-1-e3", "sheet-1-image-2-e1"]
    said = chart["sheet-1-chart-1-e2"]
    assert (said.kind, said.source, said.figureId, said.location.range) == ("figure", "derived", "sheet-1-chart-1-f1", "C2:E8") and chart["sheet-1-image-2-e1"].assetFilename == "a b.png"
    markdowns = {r.path: r.markdown for r in parsed.collect()}
    assert all(markdowns[v][e.offsetStart : e.offsetEnd] == e.markdown for v, own in found.items() for e in own)
    assert {e.location.slide for e in found["b.pptx"]} == {1} and found["c.docx"][-1].sectionPath == ["Top"]
    assert [(e.id, e.location.type, e.location.heading) for e in found["d.md"]] == [("markdown-e1", "document", None), ("markdown-e2", "section", "A"), ("markdown-e3", "section", "A")]
    tables = {r.version_id: r.table for r in structure.tables(stored).filter("version_id = 'd.md'").collect()}
    assert tables["d.md"].rows == [["x|y", "z"], ["1", "2"]] and tables["d.md"].id == "markdown-t1"


def test_damaged_packages_are_read_for_their_texts(spark):
    broken = _workbook(**{"xl/charts/chart1.xml": "<chart>", "xl/sharedStrings.xml": "<sst><si><t>kept</t></si></sst>"})
    slide = files({"ppt/presentation.xml": "<p", "ppt/slides/slide1.xml": f"<p:sld {W}><a:p><a:t>words</a:t></a:p></p:sld>"})
    rows = [("a.xlsx", bytearray(broken)), ("b.pptx", bytearray(slide)), ("c.xlsx", bytearray(files({"x": "y"}))), ("d.pptx", bytearray(b"no zip"))]
    got = {r.path: r for r in registry.parse(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert (got["a.xlsx"].status, got["a.xlsx"].markdown) == ("review", "kept") and got["a.xlsx"].warnings[0].startswith("read without its structure: ParseError")
    assert (got["b.pptx"].status, got["b.pptx"].markdown) == ("review", "words")
    assert got["d.pptx"].status == "failed" and "neither structure" in got["d.pptx"].error
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", b"0" * (8 << 20))
    beyond = registry.parse(spark.createDataFrame([("e.xlsx", bytearray(out.getvalue()))], "path string, content binary")).first()
    assert beyond.status == "failed" and beyond.error.startswith("LimitError")


def test_pictures_are_assets_by_content(spark, monkeypatch):
    from quern.operators import assets

    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 3, 5)
    word = lambda n: files({
        "word/document.xml": f"<w:document {W}><w:body>" + "".join(f'<w:p><a:blip r:embed="i{i}"/></w:p>' for i in range(n)) + "</w:body></w:document>",
        "word/_rels/document.xml.rels": REL.format("".join(f'<Relationship Id="i{i}" Type="http://x/image" Target="media/p{i}.png"/>' for i in range(n))),
    } | {f"word/media/p{i}.png": png + bytes(i % 2) for i in range(n)})
    rows = [("a.xlsx", bytearray(_workbook())), ("b.docx", bytearray(word(3))), ("c.docx", bytearray(b"?")), ("d.md", bytearray(b"x"))]
    found = registry.assets(spark.createDataFrame(rows, "path string, content binary"))
    got = [(r.path, r.ordinal, r.filename, r.mime, r.width, r.height, r.bytes) for r in found.orderBy("path", "ordinal").collect()]
    assert got == [("a.xlsx", 1, "a b.png", "image/png", 3, 5, 24), ("b.docx", 1, "p0.png", "image/png", 3, 5, 24), ("b.docx", 2, "p1.png", "image/png", 3, 5, 25), ("b.docx", 3, "p2.png", "image/png", 3, 5, 24)]
    once = assets.by_content(found.withColumnRenamed("path", "version_id")).orderBy("bytes").collect()
    assert [(r.bytes, r.n_assets, r.n_versions, r.version_id, r.ordinal) for r in once] == [(24, 3, 2, "a.xlsx", 1), (25, 1, 1, "b.docx", 2)]
    monkeypatch.setattr(office, "MAX_IMAGES", 2)
    assert office.read_docx(word(3))[1] == ["image 3 is left out: there are more than 2"]
    monkeypatch.setattr(office, "MAX_IMAGES_BYTES", 30)
    assert [b["part"] for b in office.read_docx(word(2))[0]] == ["word/media/p0.png"]
