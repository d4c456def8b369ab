"""Structures of parsed Markdown, as they are persisted: units with their elements, and tables.

Slides, regions of cells and charts are units of their own, whose places and ids the readers give; other formats have a
unit a heading. What an enrichment said about a marker (see ``operators/assets.py``) is set while the file is at hand.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from quern.sources import markdown

_IMAGES = re.compile(r"!\[([^\]]*)\]\(([^)\s]*)[^)]*\)")
_CELLS = re.compile(r"(?<!\\)\|")
#: Points off for each warning, and for all together.
PER_WARNING, MOST_OFF = 5, 40


def _location(place: dict) -> dict:
    if "slide" in place:
        return {"type": "slide", "slide": place["slide"]}
    return {"type": "sheet", "sheet": place["sheet"], "rowStart": place["row_start"], "rowEnd": place["row_end"], "range": place["range"]}


def table_rows(text: str) -> list[list[str]]:
    """Cells of a GFM table without its rule."""
    rows = [[c.strip().replace("\\|", "|") for c in _CELLS.split(line.strip())[1:-1]] for line in text.split("\n")]
    return rows[:1] + rows[2:]


def _text(kind: str, text: str) -> str:
    if kind == "figure":
        return " ".join(filter(None, (alt.strip() for alt, _ in _IMAGES.findall(text))))
    return re.sub(r"(?m)^> ?", "", text) if kind == "paragraph" else text


class _Builder:
    def __init__(self, file_format: str):
        self.format, self.units, self.tables = file_format, [], []

    def unit(self, key: str, location: dict) -> None:
        self.units.append({"id": key, "location": location, "elements": []})

    def element(self, key: str, block: dict, source: str, base: int, table: str, figure: str) -> None:
        unit, kind, text = self.units[-1], block["kind"], _text(block["kind"], block["text"])
        own = {
            "id": key, "kind": kind, "location": unit["location"], "order": len(unit["elements"]) + 1, "text": text, "markdown": source,
            "offsetStart": base + block["start"], "offsetEnd": base + block["end"], "searchable": bool(text.strip() or kind != "figure" and source.strip()), "source": "native", "sectionPath": block["path"],
        }
        if kind == "table":
            own["tableId"] = table
            self.tables.append({"id": table, "location": unit["location"], "rows": table_rows(source), "markdown": source})
        elif kind == "figure":
            own["figureId"] = figure
            name = next((t.removeprefix("asset://") for _, t in _IMAGES.findall(source) if t.startswith("asset://")), None)
            own |= {"assetFilename": unquote(name)} if name else {}
        unit["elements"].append(own)

    def done(self, warnings: list[str]) -> dict:
        reasons = [w.strip() for w in warnings if w.strip()]
        metrics = {"units": len(self.units), "elements": sum(len(u["elements"]) for u in self.units), "tables": len(self.tables), "warnings": len(reasons)}
        quality = {"status": "review" if reasons else "pass", "score": max(0, 100 - min(MOST_OFF, PER_WARNING * len(reasons))), "reasons": reasons, "metrics": metrics}
        return {"version": 2, "format": self.format, "units": self.units, "tables": self.tables, "quality": quality}


def fixed(file_format: str, text: str, places: list[tuple[str, dict, int, int]], warnings: list[str]) -> dict:
    """A unit for each (id, place, start, end) of the text; ids of elements, tables and figures begin with the unit's."""
    build = _Builder(file_format)
    for key, place, start, end in places:
        build.unit(key, _location(place))
        own, tables, figures = text[start:end], 0, 0
        for n, block in enumerate(markdown.blocks(own), 1):
            tables, figures = tables + (block["kind"] == "table"), figures + (block["kind"] == "figure")
            build.element(f"{key}-e{n}", block, own[block["start"] : block["end"]], start, f"{key}-t{tables}", f"{key}-f{figures}")
    return build.done(warnings)


def sectioned(file_format: str, text: str, warnings: list[str]) -> dict:
    """A unit for what comes before the first heading, if anything does, and one a heading."""
    build, counts = _Builder(file_format), {"table": 0, "figure": 0}
    build.unit("document", {"type": "document"})
    for n, block in enumerate(markdown.blocks(text), 1):
        if block["kind"] == "heading":
            build.unit(f"section-{len(build.units)}", {"type": "section", "heading": block["text"]})
        if block["kind"] in counts:
            counts[block["kind"]] += 1
        build.element(f"{file_format}-e{n}", block, text[block["start"] : block["end"]], 0, f"{file_format}-t{counts['table']}", f"{file_format}-f{counts['figure']}")
    build.units = [u for u in build.units if u["elements"]]
    return build.done(warnings)


def enriched(structure: dict, blocks: list[dict]) -> dict:
    """What blocks with a marker say of themselves, set on the elements with that text."""
    squeeze = lambda s: re.sub(r"\s+", " ", s).strip()
    known = {squeeze(b["marker"]): b for b in blocks if b.get("marker")}
    for e in (e for u in structure["units"] for e in u["elements"]):
        b = known.get(squeeze(e["text"]))
        if b:
            e |= {"source": b["source"], "kind": b["kind"], "figureId": b.get("figure", e.get("figureId"))}
    return structure
