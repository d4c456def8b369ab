"""Persisted document structures: read with their checksum, upgraded to the current version, looked up by place.

A structure is JSON of version 2 (units of any format) or 1 (pages of PDF files). Both are read by one nested schema, so
that Spark parses, checks and upgrades them without Python; what doesn't fit is put aside with its reason. JSON numbers
where a text is asked for are read as texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The persisted form.
FORMATS = ("pdf", "markdown", "text", "docx", "pptx", "xlsx")
KINDS = ("heading", "paragraph", "list", "code", "table", "figure", "caption", "header", "footer")
ORIGINS = ("native", "ocr", "vision", "derived")
CLASSES = ("native", "scanned", "mixed")
LOCATION = "struct<type:string,heading:string,page:int,slide:int,sheet:string,rowStart:int,rowEnd:int,range:string>"
ELEMENT = (
    f"struct<id:string,kind:string,location:{LOCATION},page:int,`order`:double,text:string,markdown:string,offsetStart:bigint,offsetEnd:bigint,searchable:boolean,source:string,"
    "sectionPath:array<string>,bbox:struct<x:double,y:double,width:double,height:double>,confidence:double,tableId:string,figureId:string,assetFilename:string>"
)
UNIT = (
    f"struct<id:string,location:{LOCATION},page:int,width:double,height:double,classification:string,textCharacters:bigint,textCoverage:double,imageCount:bigint,ocrApplied:boolean,"
    f"ocrConfidence:double,visionAnalyzedImages:bigint,elements:array<{ELEMENT}>>"
)
TABLE = f"struct<id:string,location:{LOCATION},page:int,`rows`:array<array<string>>,markdown:string>"
COUNTERS = ("scannedPages", "unprocessedScannedPages", "lowConfidenceOcrPages", "emptySearchablePages", "unanalyzedVisuals")
QUALITY = "struct<status:string,score:double,reasons:array<string>,metrics:map<string,string>," + ",".join(f"{c}:bigint" for c in COUNTERS) + ">"
PERSISTED = f"version int, format string, units array<{UNIT}>, pages array<{UNIT}>, tables array<{TABLE}>, quality {QUALITY}"


def _all(*conditions: Column) -> Column:
    """True where every condition is true; null is not."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions])


def _there(x: Column, *fields: str) -> Column:
    return _all(*(x[f].isNotNull() for f in fields))


def _every(array: Column, check) -> Column:
    return _all(array.isNotNull(), F.forall(array, lambda x: _all(check(x))))


def _texts(array: Column) -> Column:
    return _every(array, lambda x: x.isNotNull())


def valid_location(at: Column) -> Column:
    positive = lambda f: at[f].isNull() | (at[f] > 0)
    kind = at["type"]
    return _all((kind == "document") | (kind == "section") | ((kind == "page") & _all(at["page"] > 0)) | ((kind == "slide") & _all(at["slide"] > 0)) | ((kind == "sheet") & at["sheet"].isNotNull() & positive("rowStart") & positive("rowEnd")))


def _valid_element(e: Column, place: Column) -> Column:
    return _all(place, _there(e, "id", "order", "text", "markdown", "offsetStart", "offsetEnd", "searchable"), e["kind"].isin(*KINDS), e["source"].isin(*ORIGINS), _texts(e["sectionPath"]))


def _valid_table(t: Column, place: Column) -> Column:
    return _all(place, _there(t, "id", "markdown"), _every(t["rows"], _texts))


def _valid_quality(q: Column) -> Column:
    return _all(q["status"].isin("pass", "review"), _there(q, "score"), _texts(q["reasons"]))


def is_page(unit: Column) -> Column:
    """Whether a unit has all that a page has."""
    return _all(unit["location"]["type"] == "page", _there(unit, "width", "height", "textCharacters", "textCoverage", "imageCount", "ocrApplied", "visionAnalyzedImages"), unit["classification"].isin(*CLASSES))


def _current(s: Column) -> Column:
    unit = lambda u: _all(_there(u, "id"), valid_location(u["location"]), _every(u["elements"], lambda e: _valid_element(e, valid_location(e["location"]))))
    return _all(s["version"] == 2, s["format"].isin(*FORMATS), _every(s["units"], unit), _every(s["tables"], lambda t: _valid_table(t, valid_location(t["location"]))), _valid_quality(s["quality"]), s["quality"]["metrics"].isNotNull())


def _first_version(s: Column) -> Column:
    page = lambda p: _all(
        p["page"] > 0, _there(p, "width", "height", "textCharacters", "textCoverage", "imageCount", "ocrApplied", "visionAnalyzedImages"), p["classification"].isin(*CLASSES),
        _every(p["elements"], lambda e: _valid_element(e, e["page"] > 0)),
    )
    return _all(s["version"] == 1, s["format"] == "pdf", _every(s["pages"], page), _every(s["tables"], lambda t: _valid_table(t, t["page"] > 0)), _valid_quality(s["quality"]), _there(s["quality"], *COUNTERS))


def _on_page(page: Column) -> Column:
    fields = (f.split(":") for f in LOCATION[len("struct<") : -1].split(","))
    return F.struct(*({"type": F.lit("page"), "page": page}.get(f, F.lit(None)).cast(t).alias(f) for f, t in fields))


def upgraded(s: Column) -> Column:
    """A structure of version 1 as one of version 2: pages are units, and places are locations."""

    def element(e: Column, at: Column) -> Column:
        return e.withField("location", at).dropFields("page")

    def unit(p: Column) -> Column:
        at = _on_page(p["page"])
        out = p.withField("id", F.concat(F.lit("page-"), p["page"])).withField("location", at).withField("elements", F.transform(p["elements"], lambda e: element(e, at)))
        return out.dropFields("page")

    q = s["quality"]
    metrics = F.create_map(*(x for c in COUNTERS for x in (F.lit(c), q[c].cast("string"))))
    quality = F.struct(q["status"].alias("status"), q["score"].alias("score"), q["reasons"].alias("reasons"), metrics.alias("metrics"))
    tables = F.transform(s["tables"], lambda t: t.withField("location", _on_page(t["page"])).dropFields("page"))
    return F.struct(F.lit(2).alias("version"), F.lit("pdf").alias("format"), F.transform(s["pages"], unit).alias("units"), tables.alias("tables"), quality.alias("quality"))


def _as_current(s: Column) -> Column:
    """Without the fields of version 1."""
    units = F.transform(s["units"], lambda u: u.withField("elements", F.transform(u["elements"], lambda e: e.dropFields("page"))).dropFields("page"))
    q = s["quality"]
    quality = F.struct(*(q[f].alias(f) for f in ("status", "score", "reasons", "metrics")))
    return F.struct(s["version"].alias("version"), s["format"].alias("format"), units.alias("units"), F.transform(s["tables"], lambda t: t.dropFields("page")).alias("tables"), quality.alias("quality"))


def read(files: DataFrame) -> DataFrame:
    """(version_id, problem, structure) of files (version_id, content string or binary, sha256: expected, or null).

    problem: 'missing' (no content), 'checksum', 'malformed' (no JSON, another version, a field missing or of another
    kind), or null; structure is null where there is a problem. Write the result as a table before looking things up in
    it: otherwise each look-up parses the JSON again.
    """
    text, own = F.col("content").cast("string"), F.sha2(F.col("content").cast("binary"), 256)
    parsed = F.from_json(text, PERSISTED)
    rows = files.select("version_id", "content", (F.col("sha256").isNotNull() & (F.trim("sha256") != own)).alias("changed"), parsed.alias("s"))
    s = F.col("s")
    rows = rows.select("version_id", "content", "changed", "s", F.when(_current(s), 2).when(_first_version(s), 1).alias("kind"))
    problem = F.when(F.col("content").isNull(), "missing").when(F.col("changed"), "checksum").when(F.col("kind").isNull(), "malformed")
    rows = rows.withColumn("problem", problem)
    return rows.select("version_id", "problem", F.when(F.col("problem").isNull(), F.when(F.col("kind") == 2, _as_current(s)).otherwise(upgraded(s))).alias("structure"))


def problems(structures: DataFrame) -> DataFrame:
    """What is put aside. Give it a table: a filter on what read() computes computes it many times."""
    return structures.filter("problem is not null").select("version_id", "problem")


def units(structures: DataFrame) -> DataFrame:
    """(version_id, unit_no, unit)."""
    return structures.select("version_id", F.posexplode("structure.units").alias("unit_no", "unit"))


def elements(structures: DataFrame) -> DataFrame:
    """(version_id, unit_no, place, element), in the order of units and of their elements."""
    return units(structures).select("version_id", "unit_no", F.posexplode("unit.elements").alias("place", "element"))


def tables(structures: DataFrame) -> DataFrame:
    return structures.select("version_id", F.posexplode("structure.tables").alias("table_no", "table"))


def pages(structures: DataFrame, wanted: DataFrame) -> DataFrame:
    """(version_id, page, unit) of wanted (version_id, page): the first unit of that page, if it has all that a page has."""
    own = units(structures).filter("unit.location.type = 'page'").groupBy("version_id", F.col("unit.location.page").alias("page")).agg(F.min_by("unit", "unit_no").alias("unit"))
    return wanted.select("version_id", "page").distinct().join(own, ["version_id", "page"]).filter(is_page(F.col("unit")))


def tables_by_id(structures: DataFrame, wanted: DataFrame) -> DataFrame:
    """(version_id, table_id, table) of wanted (version_id, table_id): the first table of that id."""
    own = tables(structures).groupBy("version_id", F.col("table.id").alias("table_id")).agg(F.min_by("table", "table_no").alias("table"))
    return wanted.select("version_id", "table_id").distinct().join(own, ["version_id", "table_id"])


def figures_by_id(structures: DataFrame, wanted: DataFrame) -> DataFrame:
    """(version_id, figure_id, element) of wanted (version_id, figure_id): the first element of that figure."""
    own = elements(structures).filter("element.figureId is not null").groupBy("version_id", F.col("element.figureId").alias("figure_id")).agg(F.min_by("element", F.struct("unit_no", "place")).alias("element"))
    return wanted.select("version_id", "figure_id").distinct().join(own, ["version_id", "figure_id"])
