"""Document tools of answers: what a question asks to be read joins the evidence.

For the first three sources of a question's hits, cues and places in the question tell which of five tools to call. A
call is a row; calls meet the units, tables and figures of their document by a join on the version with the place as a
further condition: equal pages and slides, headings that contain each other, cell ranges that overlap. What they find
becomes hits of its own; of hits at one location of which one contains the other, the longer one takes the place of the
one ranked first. A question's hits (a recall's window and 21 more at most) are one group of that last step.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import answers as N
from quern.operators import locations as L
from quern.sources import structure as S

# The cues of each tool.
TABLE_CUES = "(?iu)(对比|比较|同比|环比|表格|数据|金额|比率|率|compare|versus|table|revenue|margin)"
FIGURE_CUES = "(?iu)(图表|图中|趋势图|流程图|架构图|chart|diagram|figure|graph)"
PAGE_CUES = "(?iu)(全文|原文|上下文|page|第.+页)"
RANGE_CUES = "(?iu)(sheet|工作表|单元格|区域|范围|行数据|列数据|cell|range|rows?)"
PLACE_CUES = "(?iu)(幻灯片|章节|小节|标题|原文|上下文|slide|section|context)"
TOOLS = ("read_page", "read_range", "read_location", "get_table", "inspect_figure")
SOURCES, UNITS, BEST = 3, 3, 2
PLACE = "struct<type:string,heading:string,page:int,slide:int,sheet:string,rowStart:int,rowEnd:int,range:string>"
HIT = f"qid long, rank int, chunk_id string, document_id long, version_id string, title string, context string, content string, score double, source {PLACE}, offset_start long, offset_end long"
_CELLS = r"(?i)^([A-Z]{1,3})(\d+)(?::([A-Z]{1,3})(\d+))?$"


def _corner(cells: Column, i: int) -> Column:
    """Column and row of a range's first or last cell; null if it is no range."""
    clean = F.replace(cells, F.lit("$"), F.lit(""))
    g = lambda k: F.nullif(F.regexp_extract(clean, _CELLS, k), F.lit(""))
    letters, row = (g(1), g(2)) if i == 0 else (F.coalesce(g(3), g(1)), F.coalesce(g(4), g(2)))
    return F.when(letters.isNotNull(), F.struct(T.column_number(letters).alias("c"), row.cast("long").alias("r")))


def ranges_meet(a: Column, b: Column) -> Column:
    """Whether two A1 ranges share a cell; what is no range is equal but for case, or not."""
    a0, a1, b0, b1 = _corner(a, 0), _corner(a, 1), _corner(b, 0), _corner(b, 1)
    share = ~((a1["r"] < b0["r"]) | (b1["r"] < a0["r"]) | (a1["c"] < b0["c"]) | (b1["c"] < a0["c"]))
    return F.when(a0.isNull() | b0.isNull(), F.upper(a) == F.upper(b)).otherwise(share)


def _place(**fields: Column) -> Column:
    names = [f.split(":") for f in PLACE[len("struct<") : -1].split(",")]
    return F.struct(*(fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names))


def sources(hits: DataFrame) -> DataFrame:
    """The first hit of each document version of a question, for the first three of these."""
    names = [c for c in hits.columns if c != "qid"]
    first = hits.groupBy("qid", "document_id", "version_id").agg(F.min("rank").alias("rank"), F.min_by(F.struct(*names), "rank").alias("hit"))
    ordered = first.groupBy("qid").agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", "document_id", "version_id", "hit"))), 1, SOURCES).alias("s"))
    return ordered.select("qid", F.posexplode("s").alias("place", "s")).select("qid", *(F.col("s.hit")[c].alias(c) for c in names), (F.col("place") + 1).alias("source_no"))


def calls(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """A row for each call of a tool: the source's columns, tool, resource, target (the place asked for) and any (whether
    the place limits what tables and figures are looked at)."""
    q, at = F.col("question"), F.col("source")
    page, slide, section, cells = N.page_of(q), N.slide_of(q), N.section_of(q), N.cells_of(q)
    given = F.concat(cells["c1"], cells["r1"].cast("string"), F.lit(":"), cells["c2"], cells["r2"].cast("string"))
    rows = sources(hits).join(questions.select("qid", "question"), "qid")
    rows = rows.withColumns({"page": F.when(at["type"] == "page", F.coalesce(page, F.when(at["page"] > 0, at["page"]))), "sheet": F.nullif(F.coalesce(cells["sheet"], at["sheet"]), F.lit("")), "cells": F.coalesce(given, at["range"])})
    kind = at["type"]
    requested = (
        F.when(slide.isNotNull(), _place(type=F.lit("slide"), slide=slide)).when(section.isNotNull(), _place(type=F.lit("section"), heading=section))
        .when((kind == "slide") & (at["slide"] > 0), _place(type=F.lit("slide"), slide=at["slide"])).when(kind == "heading", _place(type=F.lit("section"), heading=at["heading"]))
        .when((kind == "sheet") & (at["sheet"] != ""), _place(type=F.lit("sheet"), sheet=at["sheet"], rowStart=at["rowStart"], rowEnd=at["rowEnd"], range=at["range"]))
        .when(kind == "document", _place(type=F.lit("document")))
    )
    limit = F.when(F.col("page").isNotNull(), _place(type=F.lit("page"), page=F.col("page"))).when(F.col("sheet").isNotNull(), _place(type=F.lit("sheet"), sheet=F.col("sheet"), range=F.col("cells"))).otherwise(_place(type=F.lit("document")))
    wants = {
        "read_page": ((page.isNotNull() | q.rlike(PAGE_CUES)) & F.col("page").isNotNull(), _place(type=F.lit("page"), page=F.col("page"))),
        "read_range": ((cells.isNotNull() | q.rlike(RANGE_CUES)) & F.col("sheet").isNotNull(), _place(type=F.lit("sheet"), sheet=F.col("sheet"), range=F.col("cells"))),
        "read_location": ((slide.isNotNull() | section.isNotNull() | q.rlike(PLACE_CUES)) & requested.isNotNull(), requested),
        "get_table": (q.rlike(TABLE_CUES), limit),
        "inspect_figure": (q.rlike(FIGURE_CUES), limit),
    }
    number = F.col("tool_no")
    by_tool = lambda i: F.coalesce(*(F.when(number == n, w[i]) for n, w in enumerate(wants.values())))
    names = [c for c in rows.columns if c not in ("page", "sheet", "cells")]
    each = rows.withColumn("tool_no", F.explode(F.sequence(F.lit(0), F.lit(len(wants) - 1))))
    return each.filter(by_tool(0)).select(*names, "tool_no", F.element_at(F.array(*map(F.lit, wants)), number + 1).alias("tool"), by_tool(1).alias("target"))


def _covers(target: Column, unit: Column) -> Column:
    """Whether a unit is at a place: same page or slide, a sheet's overlapping range, a heading within."""
    at, kind = unit["location"], target["type"]
    sheet = (at["type"] == "sheet") & (F.lower(at["sheet"]) == F.lower(target["sheet"])) & (F.coalesce(target["range"], F.lit("")).isin("") | F.coalesce(at["range"], F.lit("")).isin("") | ranges_meet(at["range"], target["range"]))
    heading = T.normalize_for_compare(F.coalesce(target["heading"], F.lit("")))
    named = (at["type"] == "section") & F.contains(T.normalize_for_compare(F.coalesce(at["heading"], F.lit(""))), heading)
    inside = F.exists(unit["elements"], lambda e: F.exists(e["sectionPath"], lambda s: F.contains(T.normalize_for_compare(s), heading)))
    return (
        F.when(kind == "page", (at["type"] == "page") & (at["page"] == target["page"])).when(kind == "slide", (at["type"] == "slide") & (at["slide"] == target["slide"]))
        .when(kind == "sheet", sheet).when(kind == "section", (heading != "") & (named | inside)).otherwise(F.lit(True))
    )


_CALL = ("qid", "source_no", "tool_no")


def _read(asked: DataFrame, structures: DataFrame) -> DataFrame:
    """Contents of the units that page, range and location calls cover."""
    units = S.units(structures)
    met = asked.filter("tool_no < 3").join(units, "version_id").filter(_covers(F.col("target"), F.col("unit")))
    # a page is one unit, and must be whole; a range reads the first three
    met = met.filter((F.col("tool_no") != 0) | S.is_page(F.col("unit")))
    own = [c for c in asked.columns if c not in _CALL]
    grouped = met.groupBy(*_CALL).agg(F.sort_array(F.collect_list(F.struct("unit_no", "unit"))).alias("u"), F.first(F.struct(*own)).alias("call"))
    n = F.when(F.col("tool_no") == 0, 1).when(F.col("tool_no") == 1, UNITS).otherwise(F.size("u"))
    grouped = grouped.withColumn("u", F.transform(F.slice("u", 1, n), lambda x: x["unit"])).withColumn("all", F.flatten(F.transform("u", lambda u: u["elements"])))
    shown = F.filter("all", lambda e: e["searchable"])
    content = F.array_join(F.filter(F.transform(shown, lambda e: e["markdown"]), lambda m: m != ""), "\n\n")
    # offsets of a page are those of all of its elements, of the others those of what is shown
    spanned = F.when(F.col("tool_no") == 0, F.col("all")).otherwise(shown)
    first = F.col("u")[0]["location"]
    rows = grouped.select(*_CALL, "call", content.alias("content"), F.size(shown).alias("shown"), F.array_min(F.transform(spanned, lambda e: e["offsetStart"])).alias("s"), F.array_max(F.transform(spanned, lambda e: e["offsetEnd"])).alias("e"), first.alias("first"), F.array_min(F.transform(shown, lambda e: e["location"]["rowStart"])).alias("row_start"), F.array_max(F.transform(shown, lambda e: e["location"]["rowEnd"])).alias("row_end"))
    return rows.filter("content <> ''").withColumn("item_no", F.lit(1)).select("*", *(F.col("call")[c].alias(c) for c in own if c != "content")).drop("call")


def _ranked(asked: DataFrame, things: DataFrame, text: Column) -> DataFrame:
    """The two best by how many of the question's terms they hold, in their order."""
    terms = F.filter(F.array_distinct(F.split(F.lower("question"), r"[^\p{L}\p{N}]+")), lambda t: F.length(t) > 1)
    met = asked.join(things, "version_id").filter(_covers(F.col("target"), F.col("unit")))
    best = Window.partitionBy(*_CALL).orderBy(F.desc(T.term_score(text, terms)), "order_no")
    return met.withColumn("item_no", F.row_number().over(best)).filter(F.col("item_no") <= BEST)


def _synthetic(rows: DataFrame, resource: Column, content: Column, at: Column, start: Column, end: Column, shown: Column) -> DataFrame:
    own = F.col("source")
    kind, heading = F.when(at["type"] == "section", "heading").otherwise(at["type"]), F.when(at["type"] == "section", F.coalesce(at["heading"], own["heading"])).otherwise(own["heading"])
    only = lambda f, *kinds: F.when(at["type"].isin(*kinds), at[f])
    place = _place(type=kind, heading=heading, page=only("page", "page"), slide=only("slide", "slide"), sheet=only("sheet", "sheet"), rowStart=only("rowStart", "sheet"), rowEnd=only("rowEnd", "sheet"), range=only("range", "sheet"))
    return rows.select(*_CALL, "item_no", "tool", shown.alias("shown"), L.synthetic_id(F.concat_ws(":", "version_id", resource)).alias("chunk_id"), "document_id", "version_id", "title", "context", content.alias("content"), F.lit(1.0).alias("score"), place.alias("source"), F.coalesce(start, F.col("offset_start")).alias("offset_start"), F.coalesce(end, F.col("offset_end")).alias("offset_end"), resource.alias("resource"))


def found(asked: DataFrame, structures: DataFrame) -> DataFrame:
    """What each call finds, as hits with source_no, tool_no, item_no and resource."""
    t = F.col("target")
    read = _read(asked, structures)
    cells = F.coalesce(t["range"], F.col("first")["range"])
    name = (
        F.when(F.col("tool_no") == 0, F.concat(F.lit("page-"), t["page"])).when(F.col("tool_no") == 1, F.concat(F.lit("range-"), t["sheet"], F.lit("-"), F.coalesce(cells, F.lit("all"))))
        .when(t["type"] == "slide", F.concat(F.lit("slide-"), t["slide"])).when(t["type"] == "section", F.concat(F.lit("section-"), F.coalesce(t["heading"], F.lit("untitled"))))
        .when(t["type"] == "sheet", F.concat(F.lit("sheet-"), t["sheet"], F.lit("-"), F.coalesce(t["range"], F.lit("all")))).otherwise(F.lit("document"))
    )
    at = F.when(F.col("tool_no") == 1, _place(type=F.lit("sheet"), sheet=t["sheet"], rowStart=F.col("row_start"), rowEnd=F.col("row_end"), range=cells)).otherwise(t)
    reads = _synthetic(read, name, F.col("content"), at, F.col("s"), F.col("e"), F.col("shown"))
    holders = S.elements(structures).filter("element.tableId is not null").groupBy("version_id", F.col("element.tableId").alias("table_id")).agg(F.min_by("element", F.struct("unit_no", "place")).alias("holder"))
    tables = S.tables(structures).withColumn("table_id", F.col("table.id")).join(holders, ["version_id", "table_id"], "left")
    empty = F.expr("cast(array() as array<struct<sectionPath:array<string>>>)")
    tables = tables.select("version_id", F.col("table_no").alias("order_no"), "table", "holder", F.struct(F.col("table.location").alias("location"), empty.alias("elements")).alias("unit"))
    got = _ranked(asked.filter("tool = 'get_table'"), tables, F.col("table.markdown"))
    shown = _synthetic(got, F.col("table.id"), F.col("table.markdown"), F.col("table.location"), F.col("holder.offsetStart"), F.col("holder.offsetEnd"), F.lit(1))
    figures = S.units(structures).select("version_id", "unit_no", F.struct("unit.location", empty.alias("elements")).alias("unit"), F.posexplode("unit.elements").alias("place", "element"))
    figures = figures.filter("element.kind = 'figure' and element.searchable").select("version_id", F.struct("unit_no", "place").alias("order_no"), "unit", "element")
    seen = _ranked(asked.filter("tool = 'inspect_figure'"), figures, F.col("element.text"))
    pictured = _synthetic(seen, F.coalesce("element.figureId", "element.id"), F.col("element.text"), F.col("element.location"), F.col("element.offsetStart"), F.col("element.offsetEnd"), F.lit(1))
    return reads.unionByName(shown).unionByName(pictured)


def report(asked: DataFrame, results: DataFrame, structures: DataFrame) -> DataFrame:
    """(qid, source_no, document_id, tool, status, resource, n): one row a call; a source without a structure has one
    skipped call, get_source. n counts elements of ranges and locations, otherwise results."""
    there = structures.filter("structure is not null").select("version_id").distinct()
    keys = [*_CALL, "document_id", "tool"]
    made = asked.join(there, "version_id", "left_semi").select(*keys, F.lit(0).alias("hit"), F.lit(0).alias("shown"), F.lit(None).cast("string").alias("resource"), F.lit(None).cast("int").alias("item_no"))
    both = made.unionByName(results.select(*keys, F.lit(1).alias("hit"), "shown", "resource", "item_no"))
    counts = both.groupBy(*keys).agg(F.sum("hit").alias("hits"), F.sum("shown").alias("shown"), F.min_by("resource", "item_no").alias("resource"))
    n = F.when(F.col("tool").isin("read_range", "read_location"), F.col("shown")).otherwise(F.col("hits")).cast("int")
    return counts.select("qid", "source_no", "document_id", "tool", F.when(F.col("hits") > 0, "success").otherwise("skipped").alias("status"), "resource", n.alias("n"))


def missing_sources(hits: DataFrame, structures: DataFrame) -> DataFrame:
    """The skipped get_source calls, in the form of report()."""
    there = structures.filter("structure is not null").select("version_id").distinct()
    lost = sources(hits).join(there, "version_id", "left_anti")
    return lost.select("qid", "source_no", "document_id", F.lit("get_source").alias("tool"), F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("resource"), F.lit(0).alias("n"))


def _replace(pdf: pd.DataFrame) -> pd.DataFrame:
    """Hits in order; one that contains or is contained in an earlier one at its location takes its place if longer."""
    kept: list = []
    for row in pdf.sort_values("order_no").itertuples(index=False):
        at = next((i for i, k in enumerate(kept) if k.where == row.where and (k.plain in row.plain or row.plain in k.plain)), None)
        if at is None:
            kept.append(row)
        elif len(row.plain) > len(kept[at].plain):
            kept[at] = row
    return pd.DataFrame({"qid": [r.qid for r in kept], "rank": range(1, len(kept) + 1), "place": [r.place for r in kept]})


def enrich(hits: DataFrame, results: DataFrame) -> DataFrame:
    """HIT: the hits and what tools found, in place. Only normalised texts and places go through the group."""
    names = [f.split()[0] for f in HIT.replace(PLACE, "x").split(", ") if f.split()[0] != "rank"]
    own = hits.select(*names, F.struct(F.lit(0).alias("a"), F.col("rank").alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d")).alias("o"))
    more = results.select(*names, F.struct(F.lit(1).alias("a"), F.col("source_no").alias("b"), F.col("tool_no").alias("c"), F.col("item_no").alias("d")).alias("o"))
    rows = own.unionByName(more).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("o"))).drop("o")
    where = F.to_json(F.struct("version_id", *(F.col("source")[f].alias(f) for f in ("type", "page", "slide", "sheet", "range", "heading"))))
    plain = rows.select("qid", "place", F.col("place").alias("order_no"), where.alias("where"), T.normalize_for_compare(F.coalesce("content", F.lit(""))).alias("plain"))
    kept = plain.groupBy("qid").applyInPandas(_replace, "qid long, rank int, place int")
    return rows.join(kept, ["qid", "place"]).select(*["qid", "rank"], *names[1:])
