"""Pages of positioned text: lines, columns and reading order, for formats whose text comes in pieces with places."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LINES = "doc long, page int, line int, text string, x double, top double, width double, height double, size double, column_no int"
#: A gap of this share of the page's width parts lines of different columns.
COLUMN_GAP = 0.14
#: Where a page may be split in two, and how wide a line is that belongs to neither side.
SPLITS, WIDE = (0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65), 0.75
LEAST_A_SIDE = 3


def rows_of(items: pd.DataFrame) -> np.ndarray:
    """Row number of each item, items in order of top: a row holds what lies within 0.45 of the smaller font (2 at
    least) of its first item."""
    tops, sizes = items["top"].to_numpy(), items["size"].to_numpy()
    out, row, first = np.zeros(len(items), int), 0, 0
    for i in range(1, len(items)):
        if tops[i] - tops[first] > max(2.0, 0.45 * min(sizes[i], sizes[first])):
            row, first = row + 1, i
        out[i] = row
    return out


def join_line(items: pd.DataFrame) -> dict:
    """Text with a blank for gaps over 0.22 of the font (2 at least) and a tab for those over 2.5 of it."""
    text, right = "", items["x"].iloc[0]
    for r in items.itertuples():
        gap = r.x - right
        if text and gap > max(2.0, 0.22 * r.size):
            text += "\t" if gap > 2.5 * r.size else " "
        text += r.text
        right = max(right, r.x + r.width)
    x, top = items["x"].min(), items["top"].min()
    return {"text": text.strip(), "x": x, "top": top, "width": right - x, "height": (items["top"] + items["height"]).max() - top, "size": items["size"].max()}


def column_split(lines: pd.DataFrame, page_width: float) -> float | None:
    """The best place that has lines on either side and few across it; None on pages of one column."""
    if len(lines) < 2 * LEAST_A_SIDE:
        return None
    x, right, wide = lines["x"].to_numpy(), (lines["x"] + lines["width"]).to_numpy(), lines["width"].to_numpy() >= WIDE * page_width
    scores = []
    for at in (page_width * s for s in SPLITS):
        left, beyond = int((~wide & (right <= at)).sum()), int((~wide & (x >= at)).sum())
        if min(left, beyond) >= LEAST_A_SIDE:
            scores.append((min(left, beyond) - 2 * (len(lines) - left - beyond), -at))
    best = max(scores, default=(0, 0.0))
    return -best[1] if best[0] > 0 else None


def reading_order(lines: pd.DataFrame, page_width: float) -> pd.DataFrame:
    """Lines from top to bottom; on pages of two columns, between lines that span them, the left column first."""
    split = column_split(lines, page_width)
    lines = lines.copy()
    if split is None:
        lines["column_no"] = 0
        return lines.sort_values(["top", "x"], kind="stable")
    right = lines["x"] + lines["width"]
    lines["column_no"] = np.where(right <= split, 0, np.where(lines["x"] >= split, 1, 2))
    spanning = np.sort(lines.loc[lines["column_no"] == 2, "top"].to_numpy())
    # bands between spanning lines; a spanning line comes before the band below it
    lines["band"] = np.searchsorted(spanning, lines["top"].to_numpy(), side="right")
    lines["after"] = (lines["column_no"] != 2).astype(int)
    return lines.sort_values(["band", "after", "column_no", "top", "x"], kind="stable").drop(columns=["band", "after"])


def page_lines(items: DataFrame) -> DataFrame:
    """LINES of (doc, page, page_width, text, x, top, width, height, size). A page's items are one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        width = float(pdf["page_width"].iloc[0])
        own = pdf[pdf["text"].str.strip() != ""].sort_values(["top", "x"], kind="stable").reset_index(drop=True)
        out = []
        for _, row in own.groupby(rows_of(own), sort=True) if len(own) else ():
            row = row.sort_values("x", kind="stable")
            gaps = row["x"] - (row["x"] + row["width"]).shift().fillna(row["x"].iloc[0])
            out += [join_line(part) for _, part in row.groupby((gaps > COLUMN_GAP * width).cumsum())]
        if not out:
            return pd.DataFrame(columns=[c.split()[0] for c in LINES.split(", ")])
        lines = reading_order(pd.DataFrame(out), width).reset_index(drop=True)
        return lines.assign(doc=pdf["doc"].iloc[0], page=pdf["page"].iloc[0], line=range(1, len(lines) + 1))[[c.split()[0] for c in LINES.split(", ")]]

    return items.groupBy("doc", "page").applyInPandas(run, LINES)


ELEMENTS = "doc long, page int, position int, kind string, text string, depth int, path array<string>"


def joins(before, line, body: float) -> bool:
    """Whether a line goes on with the paragraph of the one before: same column, near below it, about as far left."""
    gap = line.top - (before.top + before.height)
    near = -body <= gap <= 1.8 * body
    return before.column_no == line.column_no and near and (line.column_no == 0 or abs(before.x - line.x) <= 3 * body)


def paragraph_text(texts: list[str]) -> str:
    out = ""
    for t in texts:
        if out.endswith("-") and t[:1].isalpha():
            out = out[:-1] + t
        else:
            out += ("" if not out or out.endswith("\t") or t.startswith("\t") else " ") + t
    return out


def page_elements(lines: DataFrame) -> DataFrame:
    """ELEMENTS of LINES with level (null: body), margin (null: none) and body (font size): headings with the section path
    they open, paragraphs of joined lines, margins apart. A document's lines are one group, as paths go across pages."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        path: list[str] = []
        open_: list = []
        position = page = 0

        def add(kind: str, text: str, depth: int = 0) -> None:
            nonlocal position
            if text.strip():
                position += 1
                out.append((pdf["doc"].iloc[0], page, position, kind, text.strip(), depth, list(path)))

        def close() -> None:
            if open_:
                add("paragraph", paragraph_text([r.text for r in open_]))
                open_.clear()

        for r in pdf.sort_values(["page", "line"]).itertuples():
            if r.page != page:
                close()
                page, position = r.page, 0
            if isinstance(r.margin, str):
                close()
                add(r.margin, r.text)
            elif not np.isnan(r.level):
                close()
                depth = min(int(r.level), len(path) + 1)
                path[depth - 1 :] = [r.text.strip()]
                add("heading", r.text, depth)
            else:
                if open_ and not joins(open_[-1], r, r.body):
                    close()
                open_.append(r)
        close()
        return pd.DataFrame(out, columns=[c.split()[0] for c in ELEMENTS.split(", ")])

    typed = lines.withColumn("level", lines["level"].cast("double"))
    return typed.groupBy("doc").applyInPandas(run, ELEMENTS)
