"""Chunking of Markdown: windows that end at preferred breaks, within the ranges that anchors cut."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.sources.markdown import heading_anchors

SIZE, OVERLAP = 1200, 120
#: Kind of an anchor: what wins where several cover a range.
PRIORITY = {"page": 2, "slide": 2, "sheet": 2, "heading": 1, "document": 0}
#: Best break first.
BREAKS = ("\n\n", "\n", "。", ". ", " ")
_WORD = re.compile(r"[^\W_]+")
_CJK = re.compile("[⺀-⿕々〇〡-〩〸-〻ぁ-ゟァ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾝ]")
SCHEMA = "document_id long, chunk_id string, ordinal int, content string, content_sha256 string, tokens int, offset_start int, offset_end int, anchor_type string, heading string"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in SCHEMA.split(", ")]
#: Chunks that a task holds before it gives them on.
HELD = 2000


@dataclass
class Anchor:
    kind: str
    start: int
    end: int
    heading: str | None = None
    place: tuple = field(default_factory=tuple)


def chunk_id(version: str, ordinal: int) -> str:
    """SHA-256 of 'version:ordinal' in the shape of a UUID of version 5."""
    b = bytearray(hashlib.sha256(f"{version}:{ordinal}".encode()).digest()[:16])
    b[6], b[8] = b[6] & 15 | 0x50, b[8] & 63 | 0x80
    h = b.hex()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def estimate_tokens(text: str) -> int:
    return len(_CJK.findall(text)) + sum(not _CJK.search(w) for w in _WORD.findall(text))


def ranges(length: int, anchors: list[Anchor]) -> list[Anchor]:
    """The text cut at all ends of anchors; each piece has its foremost anchor, and equal neighbours are one."""
    clip = [Anchor(a.kind, max(0, min(a.start, length)), max(0, min(a.end, length)), a.heading, a.place) for a in anchors]
    clip = [a for a in clip if a.end > a.start]
    cuts = sorted({0, length, *(p for a in clip for p in (a.start, a.end))})
    out: list[Anchor] = []
    for start, end in zip(cuts, cuts[1:], strict=False):
        over = [a for a in clip if a.start <= start and a.end >= end]
        best = max(over, key=lambda a: PRIORITY[a.kind], default=Anchor("document", start, end))
        title = best.heading or next((a.heading for a in over if a.kind == "heading"), None)
        if out and (out[-1].kind, out[-1].heading, out[-1].place) == (best.kind, title, best.place):
            out[-1].end = end
        else:
            out.append(Anchor(best.kind, start, end, title, best.place))
    return out


def windows(text: str, start: int, end: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans without white space at their ends. A window's last 40 % is searched for the best break."""
    skip = lambda i, stop: next((j for j in range(i, stop) if not text[j].isspace()), stop)
    start = skip(start, end)
    while end > start and text[end - 1].isspace():
        end -= 1
    while start < end:
        stop = min(start + size, end)
        if stop < end:
            least = start + int((stop - start) * 0.6)
            found = ((text.rfind(m, 0, stop + len(m)), len(m)) for m in BREAKS)
            stop = next((at + n for at, n in found if at >= least), stop)
        last = stop
        while last > start and text[last - 1].isspace():
            last -= 1
        if last > start:
            yield start, last
        if stop >= end:
            return
        start = skip(max(start + 1, stop - overlap), end)


def chunk(version: str, text: str, anchors: list[Anchor], size: int = SIZE, overlap: int = OVERLAP) -> list[tuple]:
    if size < 100 or not 0 <= overlap < size:
        raise ValueError("size must be at least 100, overlap from 0 to below size")
    out = []
    for r in ranges(len(text), anchors) if text.strip() else []:
        for a, b in windows(text, r.start, r.end, size, overlap):
            n = len(out) + 1
            piece = text[a:b]
            out.append((chunk_id(version, n), n, piece, hashlib.sha256(piece.encode()).hexdigest(), estimate_tokens(piece), a, b, r.kind, r.heading))
    return out


def table_chunks(markdown: str, size: int = SIZE) -> list[str]:
    """A Markdown table in pieces of whole rows, each with what stands before the table and its header."""
    if len(markdown) <= size:
        return [markdown]
    lines = markdown.split("\n")
    top = next((i for i, x in enumerate(lines) if x.lstrip().startswith("|")), -1)
    if top < 0 or len(lines) - top < 3 or not lines[top] or not lines[top + 1]:
        return [p for i in range(0, len(markdown), size) if (p := markdown[i : i + size].strip())]
    before = "\n".join(lines[:top]).strip()
    head = (before + "\n\n" if before else "") + "\n".join(lines[top : top + 2])
    out: list[str] = []
    rows: list[str] = []
    for row in lines[top + 2 :]:
        if rows and len("\n".join((head, *rows, row))) > size:
            out.append("\n".join((head, *rows)))
            rows = []
        rows.append(row)
    return [*out, "\n".join((head, *rows))] if rows else out


def chunk_elements(version: str, text: str, elements: list[dict], size: int = SIZE, overlap: int = OVERLAP) -> list[tuple]:
    """Chunks of a structured document. Elements have start, end, kind, unit, place, path, searchable, and for tables
    their Markdown. Neighbours of the same unit, place and path go together while they span no more than size; tables
    stand alone, row by row; what isn't searchable ends a group."""
    pieces: list[tuple[str, int, int]] = []
    group: list[dict] = []

    def close() -> None:
        if group:
            pieces.extend((text[a:b], a, b) for a, b in windows(text, group[0]["start"], group[-1]["end"], size, overlap))
            group.clear()

    context = lambda e: (e.get("unit"), e.get("place"), tuple(e.get("path", ())))
    inside = (e for e in elements if 0 <= e["start"] < e["end"] <= len(text))
    for e in sorted(inside, key=lambda e: (e["start"], e["end"])):
        if not e.get("searchable", True) or e["kind"] == "table":
            close()
            if e.get("searchable", True):
                pieces.extend((p, e["start"], e["end"]) for p in table_chunks(e["markdown"], size))
            continue
        if group and (context(e) != context(group[0]) or e["end"] - group[0]["start"] > size):
            close()
        group.append(e)
    close()
    return [(chunk_id(version, n), n, p, hashlib.sha256(p.encode()).hexdigest(), estimate_tokens(p), a, b) for n, (p, a, b) in enumerate(pieces, 1)]


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of (document_id, markdown), with heading anchors of the text."""

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for doc, text in zip(*b.columns, strict=True):
                doc, text = doc.as_py(), text.as_py() or ""
                anchors = [Anchor("heading" if t else "document", a, b, t) for t, a, b in heading_anchors(text)]
                for c in chunk(str(doc), text, anchors, size, overlap):
                    rows.append((doc, *c))
                    if len(rows) == HELD:
                        yield given(rows)
                        rows.clear()
        if rows:
            yield given(rows)

    return docs.select(docs["document_id"].cast("long").alias("document_id"), docs["markdown"].cast("string").alias("markdown")).mapInArrow(run, SCHEMA)
