"""Plain text and Markdown sources: cleaning, headings, paragraphs, blocks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*$", re.M)
_FENCE = re.compile(r"^\s*(```|~~~)")
_LIST = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
_IMAGE = re.compile(r"^!\[[^\]]*\]\([^)]*\)\s*$")


def clean(text: str) -> str:
    """Line feeds only, at most two blank lines in a row, none at the ends. Empty texts are an error."""
    out = re.sub("\n{4,}", "\n\n\n", text.replace("\r\n", "\n")).strip()
    if not out:
        raise ValueError("the text is empty")
    return out


def heading_anchors(text: str) -> list[tuple[str | None, int, int]]:
    """(title, start, end): each heading up to the next; one without a title for a text without headings."""
    found = [(m[2], m.start()) for m in _HEADING.finditer(text)] or [(None, 0)]
    ends = [*(s for _, s in found[1:]), len(text)]
    return [(t, a, b) for (t, a), b in zip(found, ends, strict=True)]


def headings(docs: DataFrame) -> DataFrame:
    """(document_id, title, start, end), from 0: the same by lines and a window, for all documents at once."""
    lines = docs.select("document_id", F.length("text").alias("n"), F.posexplode(F.split("text", "\n", -1)).alias("line", "s"))
    order = Window.partitionBy("document_id").orderBy("line")
    placed = lines.withColumn("start", F.coalesce(F.sum(F.length("s") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    marks = placed.withColumn("title", F.regexp_extract("s", r"^#{1,6}[ \t]+(.+?)[ \t]*$", 1)).filter("title <> ''")
    return marks.select("document_id", "title", "start", F.coalesce(F.lead("start").over(order), F.col("n").cast("long")).alias("end"))


def paragraphs(docs: DataFrame, column: str = "text") -> DataFrame:
    """(document_id, position, content): stretches between blank lines, trimmed, without empty ones."""
    parts = docs.select("document_id", F.posexplode(F.split(column, r"\n[ \t]*\n", -1)).alias("position", "content"))
    return parts.withColumn("content", F.btrim("content", F.lit(" \t\r\n"))).filter("content <> ''")


def blocks(text: str) -> list[dict]:
    """Blocks of Markdown in order: kind (heading, code, table, list, figure, paragraph), text, depth of headings,
    section path above them, and offsets."""
    out: list[dict] = []
    path: list[str] = []
    lines, place, i = text.split("\n"), [0], 0
    for x in lines:
        place.append(place[-1] + len(x) + 1)

    def kind_of(x: str) -> str:
        if _HEADING.match(x):
            return "heading"
        if _FENCE.match(x):
            return "code"
        if x.lstrip().startswith("|"):
            return "table"
        return "list" if _LIST.match(x) else "figure" if _IMAGE.match(x) else "paragraph"

    while i < len(lines):
        if not lines[i].strip():
            i += 1
            continue
        start, kind = i, kind_of(lines[i])
        i += 1
        if kind == "code":
            mark = _FENCE.match(lines[start])[1]
            while i < len(lines) and not lines[i].strip().startswith(mark):
                i += 1
            i = min(i + 1, len(lines))
        elif kind in ("table", "list", "paragraph"):
            goes_on = lambda x, k=kind: bool(x.strip()) and (kind_of(x) == k or k == "list" and x[:1] in " \t")
            while i < len(lines) and goes_on(lines[i]):
                i += 1
        block = {"kind": kind, "text": "\n".join(lines[start:i]), "start": place[start], "end": place[i] - 1, "depth": 0}
        if kind == "heading":
            m = _HEADING.match(lines[start])
            block |= {"text": m[2], "depth": len(m[1])}
            del path[min(len(m[1]), len(path) + 1) - 1 :]
            path.append(m[2])
        out.append(block | {"path": list(path)})
    return out


def table(rows: list[list[str]]) -> str:
    """A GFM table padded to the widest row; pipes escaped, line ends as blanks."""
    width = max(map(len, rows), default=0)
    cell = lambda v: re.sub(r"\s*\n\s*", " ", str(v)).replace("|", "\\|").strip()
    line = lambda r: "| " + " | ".join([*map(cell, r), *[""] * (width - len(r))]) + " |"
    return "\n".join((line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:]))) if width else ""


def table_column(rows: Column) -> Column:
    """The same of an array of arrays of strings, on the JVM."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda v: F.trim(F.replace(F.regexp_replace(v, r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, F.lit(2), F.size(rows)), line)), "\n")
