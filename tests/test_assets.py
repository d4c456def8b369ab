"""Provenance, anchors and addresses of assets on cases with known results."""

from urllib.parse import quote

from pyspark.sql import functions as F

from quern.operators import assets
from quern.sources import structure


def elements(spark, *rows):
    """(version, place, fields of the element)."""
    import json

    raw = spark.createDataFrame([(v, 0, p, json.dumps(e)) for v, p, e in rows], "version_id string, unit_no int, place int, j string")
    return raw.withColumn("element", F.from_json("j", structure.ELEMENT)).drop("j")


def test_the_last_enrichment_of_a_text_says_what_it_is(spark):
    own = elements(spark, ("v", 0, {"text": "a  b\n", "kind": "paragraph", "source": "native", "confidence": 7.0, "figureId": "old"}), ("v", 1, {"text": "c", "source": "native"}), ("w", 0, {"text": "a b", "source": "native"}), ("v", 2, {"source": "native"}), ("v", 3, {"text": " c", "source": "native", "kind": "list"}))
    said = spark.createDataFrame([("v", 1, "a b", "ocr", 50.0, None, None), ("v", 2, " a b", "vision", None, "figure", None), ("v", 3, "c", "ocr", 90.0, None, "f1"), ("v", 4, None, "ocr", 1.0, "table", "f9")], "version_id string, number int, marker string, source string, confidence double, kind string, figure_id string")
    got = {(r.version_id, r.place): (r.element.source, r.element.confidence, r.element.kind, r.element.figureId) for r in assets.with_provenance(own, said).collect()}
    assert got == {("v", 0): ("vision", None, "figure", "old"), ("v", 1): ("ocr", 90.0, None, "f1"), ("w", 0): ("native", None, None, None), ("v", 2): ("native", None, None, None), ("v", 3): ("ocr", 90.0, "list", "f1")}
    assert assets.with_provenance(own.limit(0), said).count() == 0 and assets.with_provenance(own, said.limit(0)).count() == 5


def test_assets_are_anchored_by_their_last_figure(spark):
    section = lambda h: {"type": "section"} | ({"heading": h} if h else {})
    own = elements(
        spark, ("v", 0, {"assetFilename": "a", "location": section("H"), "sectionPath": ["H"]}), ("v", 1, {"assetFilename": "a", "location": section(None), "sectionPath": ["H", "I"]}),
        ("v", 2, {"assetFilename": "b", "location": section("B"), "sectionPath": []}), ("v", 3, {"assetFilename": "b", "location": {"type": "page", "page": 2}, "sectionPath": ["X"]}), ("v", 4, {"assetFilename": "c", "location": section(None), "sectionPath": []}),
    )
    rows = spark.createDataFrame([("v", x) for x in "abcd"] + [("w", "a"), ("v", "a"), ("v", None)], "version_id string, filename string")
    got = sorted(((r.version_id, str(r.filename), r.anchor and (r.anchor.type, r.anchor.heading, r.anchor.sectionPath)) for r in assets.with_anchors(rows, own).collect()), key=str)
    assert got == sorted([("v", "a", ("heading", "I", ["H", "I"]))] * 2 + [("v", "b", None), ("v", "c", ("heading", None, [])), ("v", "d", None), ("w", "a", None), ("v", "None", None)], key=str)


def test_references_are_components_of_addresses(spark):
    names = ["a b.png", "ü/ß?.png", "x+y%.gif", "it's (1)!~*_-.jpg", "", "图.png"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", assets.reference(F.col("n")).alias("r")).collect()
    assert all(r.r == "asset://" + quote(r.n, safe="-_.!~*'()") for r in got)


def test_references_become_addresses(spark):
    texts = {"v": "![x](asset://a%20b.png) asset://a%20b.png\nasset://no asset://c", "w": "![x](asset://c)", "none": "asset://c $1 \\", "empty": "", "null": None}
    versions = spark.createDataFrame(list(texts.items()), "version_id string, markdown string")
    own = spark.createDataFrame([("v", 1, "a b.png", "old"), ("v", 2, "a b.png", "https://$0/\\1"), ("v", 3, "c", "C"), ("w", 1, "c", None), ("empty", 1, "c", "E"), ("null", 1, "c", "N")], "version_id string, ordinal int, filename string, address string")
    got = dict(assets.resolved(versions, own).select("version_id", "markdown").collect())
    assert got == texts | {"v": "![x](https://$0/\\1) https://$0/\\1\nasset://no C"}
    other = dict(assets.resolved(versions, own, "picture://").select("version_id", "markdown").collect())
    assert other == texts
