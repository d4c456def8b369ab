"""Persisted structures and document tools, on small cases with known answers and against the SQL."""

from __future__ import annotations

import hashlib
import json
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.operators import tools as D
from quern.plans import catalog
from quern.plans.scratch import stored
from quern.sources import structure as S
from tests.oracle import DATA


def element(id_="e1", at=None, text="words", kind="paragraph", **more):
    return {"id": id_, "kind": kind, "location": at or {"type": "document"}, "order": 1, "text": text, "markdown": text, "offsetStart": 0, "offsetEnd": len(text), "searchable": True, "source": "native", "sectionPath": [], **more}


def structure(units, tables=(), format_="pdf"):
    return {"version": 2, "format": format_, "units": units, "tables": list(tables), "quality": {"status": "pass", "score": 100, "reasons": [], "metrics": {"n": 1, "s": "x", "b": True}}}


PAGE = {"width": 612, "height": 792, "classification": "native", "textCharacters": 52, "textCoverage": 1, "imageCount": 0, "ocrApplied": False, "visionAnalyzedImages": 0}
FIRST = {
    "version": 1, "format": "pdf",
    "pages": [{"page": 2, **PAGE, "classification": "mixed", "elements": [{k: v for k, v in element("p2-e1", text="Legacy content", sectionPath=["Legacy"], bbox={"x": 1, "y": 2, "width": 3, "height": 4}).items() if k != "location"} | {"page": 2}]}],
    "tables": [{"id": "p2-t1", "page": 2, "rows": [["Name", "Value"]], "markdown": "| Name | Value |"}],
    "quality": {"status": "pass", "score": 100, "reasons": [], "scannedPages": 0, "unprocessedScannedPages": 1, "lowConfidenceOcrPages": 0, "emptySearchablePages": 0, "unanalyzedVisuals": 0},
}


def read(spark, **documents):
    rows = [(k, v if v is None or isinstance(v, str) else json.dumps(v), None) for k, v in documents.items()]
    return stored(S.read(spark.createDataFrame(rows, "version_id string, content string, sha256 string").coalesce(1)), "structures")


def test_the_first_version_is_upgraded(spark):
    own = read(spark, a=FIRST)
    r = own.first()
    assert r.problem is None and (r.structure.version, r.structure.format) == (2, "pdf")
    assert r.structure.quality.metrics["scannedPages"] == "0" and r.structure.quality.metrics["unprocessedScannedPages"] == "1"
    unit = S.pages(own, spark.createDataFrame([("a", 2), ("a", 3)], "version_id string, page int")).collect()
    assert [u.unit.id for u in unit] == ["page-2"] and (unit[0].unit.location.type, unit[0].unit.location.page) == ("page", 2)
    e = unit[0].unit.elements[0]
    assert (e.id, e.location.page, e.sectionPath, e.bbox.height) == ("p2-e1", 2, ["Legacy"], 4.0)
    table = S.tables_by_id(own, spark.createDataFrame([("a", "p2-t1"), ("a", "x")], "version_id string, table_id string")).collect()
    assert [(t.table.location.page, t.table.rows) for t in table] == [(2, [["Name", "Value"]])]


def test_versions_read_alike(spark):
    now = structure([{"id": "page-2", "location": {"type": "page", "page": 2}, **FIRST["pages"][0], "elements": [element("p2-e1", {"type": "page", "page": 2}, "Legacy content", sectionPath=["Legacy"], bbox={"x": 1, "y": 2, "width": 3, "height": 4})]}], [{"id": "p2-t1", "location": {"type": "page", "page": 2}, "rows": [["Name", "Value"]], "markdown": "| Name | Value |"}])
    a, b = (r.structure for r in read(spark, a=FIRST, b=now).orderBy("version_id").collect())
    assert a.units == b.units and a.tables == b.tables


def changed(document, path, value):
    out = json.loads(json.dumps(document))
    at = out
    for p in path[:-1]:
        at = at[p]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


def test_what_does_not_fit_is_put_aside(spark):
    good = structure([{"id": "u", "location": {"type": "sheet", "sheet": "S", "rowStart": 1}, "elements": [element()]}], [{"id": "t", "location": {"type": "slide", "slide": 1}, "rows": [["x"]], "markdown": "x"}])
    wrong = {
        "version": ("version", 3), "format": ("format", "csv"), "no units": ("units", KeyError), "unit location": ("units", 0, "location", {"type": "page"}), "zero": ("units", 0, "location", {"type": "page", "page": 0}), "half": ("units", 0, "location", {"type": "page", "page": 1.5}),
        "kind": ("units", 0, "elements", 0, "kind", "odd"), "text": ("units", 0, "elements", 0, "text", KeyError), "offset": ("units", 0, "elements", 0, "offsetStart", "a"), "flag": ("units", 0, "elements", 0, "searchable", KeyError), "origin": ("units", 0, "elements", 0, "source", "x"),
        "cells": ("tables", 0, "rows", [[None]]), "row": ("tables", 0, "rows", [None]), "status": ("quality", "status", "fine"), "metrics": ("quality", "metrics", KeyError), "elements": ("units", 0, "elements", None), "path": ("units", 0, "elements", 0, "sectionPath", [None]),
    }
    cases = {k: changed(good, v[:-1], v[-1]) for k, v in wrong.items()} | {f"first {f}": changed(FIRST, (f,), KeyError) for f in ("pages", "tables", "quality")}
    cases |= {"first counter": changed(FIRST, ("quality", "scannedPages"), KeyError), "first page": changed(FIRST, ("pages", 0, "page"), 0), "broken": "{broken", "list": "[]", "empty": "", "null": "null"}
    got = {r.version_id: r.problem for r in read(spark, good=good, first=FIRST, nothing=None, **cases).collect()}
    assert {k for k, v in got.items() if v is None} == {"good", "first"}
    assert got.pop("nothing") == "missing" and {got[k] for k in cases} == {"malformed"}
    assert read(spark, **cases).filter("structure is not null").count() == 0


def test_checksums(spark):
    text = json.dumps(structure([]))
    rows = [("a", text, hashlib.sha256(text.encode()).hexdigest() + " "), ("b", text, "0" * 64), ("c", text, None)]
    got = {r.version_id: r.problem for r in S.read(spark.createDataFrame(rows, "version_id string, content string, sha256 string")).collect()}
    assert got == {"a": None, "b": "checksum", "c": None}
    files = spark.createDataFrame([("a", bytearray(text.encode()), rows[0][2])], "version_id string, content binary, sha256 string")
    assert S.read(files).first().problem is None
    assert S.read(files.limit(0)).count() == 0


def test_figures_by_id(spark):
    own = read(spark, a=structure([{"id": "u", "location": {"type": "document"}, "elements": [element("e1"), element("e2", kind="figure", figureId="f"), element("e3", figureId="f")]}]))
    got = S.figures_by_id(own, spark.createDataFrame([("a", "f"), ("a", "g"), ("b", "f")], "version_id string, figure_id string")).collect()
    assert [(r.figure_id, r.element.id) for r in got] == [("f", "e2")]


# tools


def hit(rank=1, kind="page", content="Retrieved content", document=1, version=None, qid=1, **at):
    place = [at.get(n) for n in ("heading", "page", "slide", "sheet", "rowStart", "rowEnd", "range")]
    return (qid, rank, f"c{rank}", document, version or f"v{document}", "Title", None, content, 0.5, (kind, *place), 0, 60)


def enriched(spark, question, hits, **documents):
    questions = spark.createDataFrame([(1, question)], "qid long, question string")
    hits, structures = spark.createDataFrame(hits, D.HIT), read(spark, **documents)
    asked = stored(D.calls(questions, hits).coalesce(1), "calls")
    results = stored(D.found(asked, structures), "found")
    calls = D.report(asked, results, structures).unionByName(D.missing_sources(hits, structures)).orderBy("source_no", "tool").collect()
    return D.enrich(hits, results).orderBy("rank").collect(), [(c.source_no, c.tool, c.status, c.resource, c.n) for c in calls]


def test_an_explicit_range_replaces_the_hit_of_its_place(spark):
    at = {"type": "sheet", "sheet": "Summary", "rowStart": 1, "rowEnd": 3, "range": "A1:B3"}
    table = "| Name | Value |\n| --- | --- |\n| Alpha | 1 |"
    doc = structure([{"id": "r1", "location": at, "elements": [element("e1", at, table, "table", tableId="t1")]}], [{"id": "t1", "location": at, "rows": [["Name"]], "markdown": table}], "xlsx")
    hits, calls = enriched(spark, "report: 读取 Summary!A1:B3 范围", [hit(kind="sheet", content=table, sheet="Summary", rowStart=1, rowEnd=3, range="A1:B3")], v1=doc)
    assert (1, "read_range", "success", "range-Summary-A1:B3", 1) in calls
    assert len(hits) == 1 and (hits[0].source.sheet, hits[0].source.range) == ("Summary", "A1:B3")


def test_ranges_read_what_they_overlap_and_three_units_at_most(spark):
    at = lambda cells, sheet="S": {"type": "sheet", "sheet": sheet, "rowStart": int(cells[1]), "rowEnd": int(cells[-1]), "range": cells}
    cells = ["A1:B2", "A3:B4", "C1:D2", "B2:C3", "B1:B9", "Z1:Z2"]
    doc = structure([{"id": c, "location": at(c), "elements": [element(c, at(c), f"text {c}")]} for c in cells] + [{"id": "o", "location": at("B2:B2", "T"), "elements": [element("o", at("B2:B2", "T"), "other")]}], format_="xlsx")
    hits, calls = enriched(spark, "cells s!B2-C3", [hit(kind="sheet", sheet="other")], v1=doc)
    new = next(h for h in hits if h.score == 1.0)
    assert new.content == "text A1:B2\n\ntext A3:B4\n\ntext C1:D2" and (new.source.rowStart, new.source.rowEnd, new.source.range, new.source.sheet) == (1, 4, "B2:C3", "s")
    assert (1, "read_range", "success", "range-s-B2:C3", 3) in calls


@pytest.mark.parametrize(("a", "b", "meet"), [("A1:B2", "B2:C3", True), ("A1", "A1:A9", True), ("$A$1:$B$2", "b2", True), ("A1:B2", "C1:D2", False), ("A1:A9", "A10", False), ("AA1", "Z1:AB1", True), ("all", "ALL", True), ("all", "A1", False)])
def test_cell_ranges_meet(spark, a, b, meet):
    assert spark.range(1).select(D.ranges_meet(F.lit(a), F.lit(b)).alias("x")).first().x is meet


def test_a_slide_and_a_section_are_read_by_place(spark):
    deck = structure([{"id": "slide-2", "location": {"type": "slide", "slide": 2}, "elements": [element("s", {"type": "slide", "slide": 2}, "Deployment architecture", sectionPath=["Architecture"])]}], format_="pptx")
    hits, calls = enriched(spark, "读取第 2 张幻灯片的上下文", [hit(kind="slide", slide=1, heading="Architecture")], v1=deck)
    assert (1, "read_location", "success", "slide-2", 1) in calls and any(h.content == "Deployment architecture" and (h.source.type, h.source.slide) == ("slide", 2) for h in hits)
    at = {"type": "section", "heading": "Deployment"}
    text = structure([{"id": "s1", "location": at, "elements": [element("a", at, "## Deployment", "heading"), element("b", at, "Use the production worker.")]}, {"id": "s2", "location": {"type": "section", "heading": "Other"}, "elements": [element("c", None, "nothing")]}], format_="docx")
    hits, calls = enriched(spark, "读取章节 Deployment", [hit(kind="heading", heading="Deployment")], v1=text)
    assert (1, "read_location", "success", "section-Deployment", 2) in calls
    assert [h.content for h in hits if h.score == 1.0] == ["## Deployment\n\nUse the production worker."]


def test_a_fuller_page_takes_the_place_of_its_hit(spark):
    at, whole = {"type": "page", "page": 1}, "This is the first page used for parser verification."
    doc = structure([{"id": "page-1", "location": at, **PAGE, "elements": [element("e", at, whole), element("h", at, "hidden", searchable=False, offsetEnd=900)]}])
    hits, calls = enriched(spark, "What is page 1 used for?", [hit(1, content="This is the first page", page=1), hit(2, "document", document=2)], v1=doc)
    assert [(h.rank, h.document_id, h.content) for h in hits] == [(1, 1, whole), (2, 2, "Retrieved content")]
    assert hits[0].offset_end == 900
    assert calls == [(1, "read_page", "success", "page-1", 1), (2, "get_source", "skipped", None, 0)]


def test_tables_and_figures_by_terms(spark):
    at = lambda p: {"type": "page", "page": p}
    tables = [{"id": f"t{i}", "location": at(1 if i < 4 else 2), "rows": [["x"]], "markdown": m} for i, m in enumerate(["none", "revenue of ships", "revenue", "ships revenue margin", "revenue margin ships table"])]
    doc = structure([{"id": "p", "location": at(1), **PAGE, "elements": [element("e", at(1), "x", tableId="t3", offsetStart=7, offsetEnd=9), element("f1", at(1), "a plain one", "figure"), element("f2", at(1), "the ships chart", "figure", figureId="F2"), element("f3", at(1), "ships chart", "figure", searchable=False)]}], tables)
    hits, calls = enriched(spark, "revenue margin of ships in the chart", [hit(page=1, heading="H")], v1=doc)
    assert calls == [(1, "get_table", "success", "t3", 2), (1, "inspect_figure", "success", "F2", 2)]
    new = {h.content: h for h in hits if h.score == 1.0}
    assert set(new) == {"ships revenue margin", "revenue of ships", "the ships chart", "a plain one"}
    assert (new["ships revenue margin"].offset_start, new["revenue of ships"].offset_start, new["the ships chart"].source.heading) == (7, 0, "H")


def test_no_cue_calls_nothing(spark):
    hits, calls = enriched(spark, "hello", [hit(page=1)], v1=structure([]))
    assert len(hits) == 1 and calls == []


def test_hits_of_the_tables_at_hand(spark):
    got = defaultdict(list)
    for r in catalog.queries()["document_tool_hits"](spark, DATA).collect():
        got[r.qid].append((r.rank, r.document_id, r.sha256))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = {r.doc_id: (r.text or "").split("\n") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    plain = lambda t: " ".join(t.split()).lower()
    want = {}
    for q in {i // 4 for i in docs}:
        rows = [(i, 2, (docs[i][5:6] or [""])[0]) for i in sorted(docs) if i // 4 == q]
        for i, _, _ in rows[:3]:
            if i % 19 == 7 or i % 17 == 5:
                continue
            page = 1 if q % 5 == 0 else 2
            own = [(n, x) for n, x in enumerate(docs[i]) if (str(n // 5 + 1).startswith("2") if q % 5 == 1 else n // 5 + 1 == page)]
            shown = [x for n, x in own if n % 7 != 6]
            text = "\n\n".join(x for x in shown if x)
            if q % 5 == 0 and text:
                rows.append((i, 1, text))
            elif q % 5 == 1 and text:
                rows.append((i, "section", text))
            elif q % 5 == 2 and own:
                rows.append((i, 2, f"| {own[0][1]} |"))
            elif q % 5 == 3:
                score = lambda x: sum(t in x.lower() for t in ("show", "the", "chart"))
                rows += [(i, 2, x) for x in sorted((x for n, x in own if n % 4 == 3 and n % 7 != 6), key=lambda x: -score(x))[:2]]
        kept = []
        for r in rows:
            at = next((k for k, o in enumerate(kept) if o[:2] == r[:2] and (plain(o[2]) in plain(r[2]) or plain(r[2]) in plain(o[2]))), None)
            if at is None:
                kept.append(r)
            elif len(plain(r[2])) > len(plain(kept[at][2])):
                kept[at] = r
        want[q] = [(n, r[0], sha(r[2])) for n, r in enumerate(kept, 1)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert Counter(len(v) for v in want.values())[4] < len(want)
