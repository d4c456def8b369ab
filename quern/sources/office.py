"""Office packages (DOCX, XLSX, PPTX) read with zip and XML parsers of the standard library.

Each reader gives blocks in reading order: dicts with kind (heading, paragraph, list, table, figure), Markdown text, and
place (section path, slide, or sheet with rows and cell range), and a list of warnings. Blocks of slides and sheets name
the unit they belong to (a slide, a region of cells, a chart); pictures name their part of the package.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections import defaultdict
from datetime import datetime, timedelta
from urllib.parse import quote
from xml.etree import ElementTree

from quern.sources.markdown import table

# Limits of packages.
MAX_ENTRIES, MAX_INFLATED, MAX_RATIO = 10_000, 200 << 20, 200
MAX_SHEETS, MAX_ROWS, MAX_COLUMNS, MAX_CELLS = 100, 50_000, 256, 500_000
MAX_SLIDES, MAX_SLIDE_CELLS = 500, 250_000
MAX_IMAGES, MAX_IMAGE_BYTES, MAX_IMAGES_BYTES = 500, 10 << 20, 50 << 20
EMU_TOLERANCE = 0.01
#: What stands as it is in references, besides letters and digits.
UNQUOTED = "-_.!~*'()"
#: Rows of a chart that its summary names.
SUMMARY_ROWS = 5


class LimitError(ValueError):
    """A package beyond its limits; never read in part."""


def open_package(data: bytes) -> zipfile.ZipFile:
    package = zipfile.ZipFile(io.BytesIO(data))
    infos = package.infolist()
    inflated = sum(i.file_size for i in infos)
    if len(infos) > MAX_ENTRIES or inflated > MAX_INFLATED or inflated > MAX_RATIO * max(1, sum(i.compress_size for i in infos)):
        raise LimitError("the package has too many entries or inflates too far")
    return package


def _xml(package: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    """The root of a part with namespaces cut off, so that strict and transitional files read alike."""
    if name not in package.namelist():
        return None
    root = ElementTree.fromstring(package.read(name))
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
        for k in [k for k in e.attrib if "}" in k]:
            e.attrib[k.rsplit("}", 1)[-1]] = e.attrib.pop(k)
    return root


def _parts(package: zipfile.ZipFile, name: str) -> list[ElementTree.Element]:
    root = _xml(package, name)
    return [] if root is None else list(root)


def _relations(package: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """id: (kind, target part)."""
    folder, name = posixpath.split(part)
    out = {}
    for r in _parts(package, f"{folder}/_rels/{name}.rels"):
        target = r.get("Target", "")
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], path)
    return out


def _first(e: ElementTree.Element | None, *tags: str) -> ElementTree.Element | None:
    """The first descendant with the first of the tags that has any."""
    return None if e is None else next((x for tag in tags for x in e.iter(tag)), None)


class _Pictures:
    """Pictures of a package as they come, within the limits of number and size."""

    def __init__(self, package: zipfile.ZipFile, warnings: list[str]):
        self.package, self.warnings, self.n, self.total = package, warnings, 0, 0

    def block(self, relation: tuple[str, str], place: dict, **more) -> dict | None:
        kind, part = relation
        self.n += 1
        problem, size = None, 0
        if kind != "image" or part not in self.package.NameToInfo:
            problem = "it is missing"
        elif self.n > MAX_IMAGES:
            problem = f"there are more than {MAX_IMAGES}"
        else:
            size = self.package.getinfo(part).file_size
            if size > MAX_IMAGE_BYTES:
                problem = f"it has more than {MAX_IMAGE_BYTES >> 20} MB"
            elif self.total + size > MAX_IMAGES_BYTES:
                problem = f"all have more than {MAX_IMAGES_BYTES >> 20} MB"
        if problem:
            self.warnings.append(f"image {self.n} is left out: {problem}")
            return None
        self.total += size
        return {"kind": "figure", "text": f"![](asset://{quote(posixpath.basename(part), safe=UNQUOTED)})", "place": place, "part": part} | more


def _text(e: ElementTree.Element) -> str:
    out = []
    for x in e.iter():
        if x.tag == "t":
            out.append(x.text or "")
        elif x.tag in ("br", "cr"):
            out.append("\n")
        elif x.tag == "tab":
            out.append("\t")
    return "".join(out)


def read_docx(data: bytes) -> tuple[list[dict], list[str]]:
    package, warnings = open_package(data), []
    body = _xml(package, "word/document.xml")
    styles = {s.get("styleId"): (s.find("name").get("val") if s.find("name") is not None else "") for s in _parts(package, "word/styles.xml") if s.tag == "style"}
    relations = _relations(package, "word/document.xml")
    blocks: list[dict] = []
    path: list[str] = []
    pictures = _Pictures(package, warnings)

    def add(kind: str, text: str) -> None:
        if text.strip():
            blocks.append({"kind": kind, "text": text, "place": {"section": list(path)}})

    for e in body.find("body") if body is not None and body.find("body") is not None else ():
        if e.tag == "tbl":
            rows = [["\n".join(filter(None, (_text(p) for p in c.iter("p")))) for c in r.findall("tc")] for r in e.findall("tr")]
            add("table", table(rows))
        elif e.tag == "p":
            text, style = _text(e).strip(), e.find("pPr/pStyle")
            name = (styles.get(style.get("val"), style.get("val")) if style is not None else "") or ""
            level = re.fullmatch(r"[Hh]eading ?([1-6])|[Tt]itle", name)
            if level and text:
                depth = int(level[1] or 1)
                del path[min(depth, len(path) + 1) - 1 :]
                path.append(text)
                add("heading", f"{'#' * depth} {text}")
            elif e.find("pPr/numPr") is not None:
                depth = e.find("pPr/numPr/ilvl")
                add("list", f"{'  ' * int(depth.get('val', 0) if depth is not None else 0)}- {text}" if text else "")
            else:
                add("paragraph", text)
            for blip in e.iter("blip"):
                picture = pictures.block(relations.get(blip.get("embed", ""), ("", "")), {"section": list(path)})
                blocks += [picture] if picture else []
    return blocks, warnings


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _runs(values: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for v in sorted(set(values)):
        if out and v == out[-1][1] + 1:
            out[-1][1] = v
        else:
            out.append([v, v])
    return [tuple(x) for x in out]


def cell_regions(cells: dict[tuple[int, int], str], named: list[tuple[int, int, int, int]] = ()) -> list[tuple[int, int, int, int]]:
    """(top, left, bottom, right): named tables claim their cells; of the rest, runs of rows and in each runs of columns."""
    out, rest = list(named), {p for p in cells if not any(t <= p[0] <= b and le <= p[1] <= r for t, le, b, r in named)}
    by_row = defaultdict(list)
    for r, c in rest:
        by_row[r].append(c)
    for top, bottom in _runs(list(by_row)):
        for left, right in _runs([c for r in range(top, bottom + 1) for c in by_row[r]]):
            rows = [r for r in range(top, bottom + 1) if any(left <= c <= right for c in by_row[r])]
            out.append((min(rows), left, max(rows), right))
    return sorted(out)


def _date_styles(package: zipfile.ZipFile) -> set[int]:
    root = _xml(package, "xl/styles.xml")
    if root is None:
        return set()
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter("numFmt")}
    is_date = lambda n: 14 <= n <= 22 or 45 <= n <= 47 or bool(re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "")), re.I))
    formats = root.find("cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else ()) if is_date(int(x.get("numFmtId", 0)))}


def _cached(e: ElementTree.Element | None) -> list[str]:
    """What a chart keeps of the cells it refers to, in their order; a value without such a cache is the only one."""
    text = lambda x: ((x.text if x is not None else None) or "").strip()
    cache = _first(e, "strCache", "numCache", "multiLvlStrCache")
    if cache is None:
        return [v for v in (text(_first(e, "v")),) if v]
    return [text(_first(p, "v")) for p in sorted(cache.iter("pt"), key=lambda p: int(p.get("idx", 0)))]


def chart(root: ElementTree.Element, number: int) -> tuple[str, list[list[str]]]:
    """Title, and rows with a heading: a column of categories and one a series."""
    title = _first(root, "title")
    name = " ".join(t.text or "" for t in title.iter("t")).strip() if title is not None else ""
    series = [((_cached(_first(s, "tx")) or [f"Series {i}"])[0], _cached(_first(s, "cat", "xVal")), _cached(_first(s, "val", "yVal"))) for i, s in enumerate(root.iter("ser"), 1)]
    n = max((len(values) for _, _, values in series), default=0)
    at = lambda values, i, other: values[i] if i < len(values) else other
    rows = [[at(series[0][1], i, str(i + 1)), *(at(values, i, "") for _, _, values in series)] for i in range(n)]
    return name or f"Chart {number}", [["Category", *(s[0] for s in series)], *rows] if rows else []


def _corner(anchor: ElementTree.Element, tag: str) -> tuple[int, int] | None:
    """Row and column, from 1, of a corner of what lies over a sheet."""
    own = anchor.find(tag)
    row, column = (own.findtext("row", ""), own.findtext("col", "")) if own is not None else ("", "")
    return (int(row) + 1, int(column) + 1) if row.strip().isdigit() and column.strip().isdigit() else None


def _drawn(package: zipfile.ZipFile, part: str, root: ElementTree.Element, sheet: str, number: int, pictures: _Pictures) -> list[dict]:
    """Blocks of the charts and pictures over a sheet: from the sheet to its drawing, from its anchors to their parts."""
    drawing = _first(root, "drawing")
    target = _relations(package, part).get(drawing.get("id", ""), ("", ""))[1] if drawing is not None else ""
    drawn = _xml(package, target) if target else None
    if drawn is None:
        return []
    relations, out = _relations(package, target), []
    for n, anchor in enumerate([*drawn.iter("twoCellAnchor"), *drawn.iter("oneCellAnchor")], 1):
        (top, left), end = _corner(anchor, "from") or (1, 1), _corner(anchor, "to")
        bottom, right = (max(top, end[0]), max(left, end[1])) if end else (top, left)
        # without a place, it is the first cell
        cells = f"{column_letters(left)}{top}:{column_letters(right)}{bottom}" if anchor.find("from") is not None else "A1"
        place = {"sheet": sheet, "row_start": top, "row_end": bottom, "range": cells}
        graph, blip = _first(anchor, "chart"), _first(anchor, "blip")
        if graph is not None:
            source = _xml(package, relations.get(graph.get("id", ""), ("", ""))[1])
            if source is None:
                continue
            title, rows = chart(source, n)
            unit = f"sheet-{number}-chart-{n}"
            named = "; ".join(" | ".join(r) for r in rows[1 : SUMMARY_ROWS + 1])
            marker = f"Chart analysis: {title}. {named}" if named else f"Chart analysis: {title}"
            out.append({"kind": "heading", "text": f"### Chart: {title} ({cells})", "place": place, "unit": unit})
            out.append({"kind": "figure", "text": "> " + marker.replace("\n", "\n> "), "place": place, "unit": unit, "marker": marker, "source": "derived", "figure": f"{unit}-f1"})
            out += [{"kind": "table", "text": table(rows), "place": place, "unit": unit}] if rows else []
        elif blip is not None:
            picture = pictures.block(relations.get(blip.get("embed", ""), ("", "")), place, unit=f"sheet-{number}-image-{n}")
            out += [picture] if picture else []
    return out


def read_xlsx(data: bytes) -> tuple[list[dict], list[str]]:
    package, warnings, blocks, n_cells = open_package(data), [], [], 0
    book = _xml(package, "xl/workbook.xml")
    shared = ["".join(t.text or "" for t in s.iter("t")) for s in _parts(package, "xl/sharedStrings.xml") if s.tag == "si"]
    dates, relations = _date_styles(package), _relations(package, "xl/workbook.xml")
    sheets = list(book.iter("sheet")) if book is not None else []
    if len(sheets) > MAX_SHEETS:
        raise LimitError("too many sheets")
    pictures = _Pictures(package, warnings)
    for number, sheet in enumerate(sheets, 1):
        name, part = sheet.get("name", ""), relations.get(sheet.get("id", ""), ("", ""))[1]
        root = _xml(package, part)
        if root is None:
            warnings.append(f"sheet {name} is missing")
            continue
        cells: dict[tuple[int, int], str] = {}
        for c in root.iter("c"):
            m = re.fullmatch(r"([A-Za-z]+)(\d+)", c.get("r", ""))
            value, formula, kind = c.find("v"), c.find("f"), c.get("t", "n")
            if not m:
                continue
            raw = value.text if value is not None else None
            if kind == "s" and raw is not None:
                text = shared[int(raw)]
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter("t"))
            elif kind == "b" and raw is not None:
                text = "TRUE" if raw == "1" else "FALSE"
            elif raw is not None and kind == "n" and int(c.get("s", -1)) in dates:
                text = (datetime(1899, 12, 30) + timedelta(days=float(raw))).isoformat()
            elif raw is None and formula is not None:
                text = f"={formula.text or ''}"
                warnings.append(f"{name}!{c.get('r')}: a formula without its result")
            else:
                text = raw or ""
            if text != "":
                place = int(m[2]), column_number(m[1])
                if place[0] > MAX_ROWS or place[1] > MAX_COLUMNS:
                    raise LimitError(f"sheet {name} is too large")
                cells[place] = text
        n_cells += len(cells)
        if n_cells > MAX_CELLS:
            raise LimitError("too many cells")
        named = []
        for kind, target in _relations(package, part).values():
            t = _xml(package, target) if kind == "table" else None
            m = t is not None and re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", t.get("ref", ""))
            if m:
                named.append((int(m[2]), column_number(m[1]), int(m[4]), column_number(m[3])))
        for region, (top, left, bottom, right) in enumerate(cell_regions(cells, named), 1):
            rows = [[cells.get((r, c), "") for c in range(left, right + 1)] for r in range(top, bottom + 1)]
            blocks.append({"kind": "table", "text": table(rows), "place": {"sheet": name, "row_start": top, "row_end": bottom, "range": f"{column_letters(left)}{top}:{column_letters(right)}{bottom}"}, "unit": f"sheet-{number}-region-{region}"})
        blocks += _drawn(package, part, root, name, number, pictures)
    return blocks, warnings


def read_pptx(data: bytes) -> tuple[list[dict], list[str]]:
    package, warnings, blocks, n_cells = open_package(data), [], [], 0
    show = _xml(package, "ppt/presentation.xml")
    relations = _relations(package, "ppt/presentation.xml")
    parts = [relations.get(s.get("id", ""), ("", ""))[1] for s in (show.iter("sldId") if show is not None else ())]
    if len(parts) > MAX_SLIDES:
        raise LimitError("too many slides")
    size = show.find("sldSz") if show is not None else None
    pictures = _Pictures(package, warnings)
    width, height = (int(size.get("cx", 1)), int(size.get("cy", 1))) if size is not None else (1, 1)
    for number, part in enumerate(parts, 1):
        root = _xml(package, part)
        if root is None:
            warnings.append(f"slide {number} is missing")
            continue
        images, items = _relations(package, part), []
        for e in root.iter():
            if e.tag not in ("sp", "graphicFrame", "pic"):
                continue
            off, ext = next(e.iter("off"), None), next(e.iter("ext"), None)
            x, y = (int(off.get("x", 0)) / width, int(off.get("y", 0)) / height) if off is not None else (0.0, 0.0)
            w, h = (int(ext.get("cx", 0)) / width, int(ext.get("cy", 0)) / height) if ext is not None and ext.get("cx") else (0.0, 0.0)
            box = tuple(round(v, 6) for v in (x, y, w, h))
            if e.tag == "pic":
                blip = _first(e, "blip")
                picture = pictures.block(images.get(blip.get("embed", "") if blip is not None else "", ("", "")), {})
                items += [(box, "figure", picture["text"], {"part": picture["part"]})] if picture else []
            elif (t := next(e.iter("tbl"), None)) is not None:
                rows = [[_text(c).strip() for c in r.findall("tc")] for r in t.findall("tr")]
                n_cells += sum(map(len, rows))
                items.append((box, "table", table(rows), {}))
            elif e.tag == "sp":
                holder = next(e.iter("ph"), None)
                text = "\n".join(filter(None, (_text(p).strip() for p in e.iter("p"))))
                if text:
                    title = holder is not None and holder.get("type") in ("title", "ctrTitle")
                    items.append((box, "heading" if title else "paragraph", f"### {text}" if title else text, {}))
        if n_cells > MAX_SLIDE_CELLS:
            raise LimitError("too many cells in tables")
        # rows of about the same height are read from the left
        items.sort(key=lambda i: (round(i[0][1] / EMU_TOLERANCE), i[0][0]))
        blocks += [{"kind": k, "text": text, "place": {"slide": number, "box": box}, "unit": f"slide-{number}"} | more for box, k, text, more in items]
    return blocks, warnings


def plain(data: bytes) -> tuple[list[dict], list[str]]:
    """The texts of a package's slides or sheets without their structure: what is left of a package that the readers above
    can't read. Parts that are no XML are skipped. A package beyond its limits is refused here too."""
    package, blocks = open_package(data), []
    own = re.compile(r"(?:ppt/slides/slide|xl/worksheets/sheet|word/document)(\d*)\.xml|xl/sharedStrings\.xml")
    found = sorted((int(m[1] or 0), n) for n in package.namelist() if (m := own.fullmatch(n)))
    for _, name in found:
        try:
            root = _xml(package, name)
        except (ElementTree.ParseError, zipfile.BadZipFile):
            continue
        tags = ("p",) if _first(root, "p") is not None else ("si", "is")
        lines = [_text(x).strip() for tag in tags for x in root.iter(tag)]
        blocks += [{"kind": "paragraph", "text": x, "place": {"section": []}} for x in lines if x]
    if not blocks:
        raise ValueError("the package holds no text that can be read")
    return blocks, []


def laid_out(blocks: list[dict]) -> tuple[str, list[tuple[str, dict, int, int]]]:
    """Markdown of blocks under a heading for each slide or sheet; and (id, place, start, end) of each unit in it."""
    out, units, shown, at = [], [], None, 0
    for b in blocks:
        place, start = b["place"], at
        own = next(((k, place[k]) for k in ("slide", "sheet") if k in place), None)
        if own and own != shown:
            out.append(f"## {'Slide ' if own[0] == 'slide' else ''}{own[1]}")
            shown, at = own, at + len(out[-1]) + 2
        out.append(b["text"])
        end = at + len(b["text"])
        at = end + 2
        if "unit" in b:
            if units and units[-1][0] == b["unit"]:
                start = units.pop()[2]
            units.append((b["unit"], {k: v for k, v in place.items() if k != "box"}, start, end))
    return "\n\n".join(out), units


def to_markdown(blocks: list[dict]) -> str:
    return laid_out(blocks)[0]
