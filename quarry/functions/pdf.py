"""Lines of a typeset document to Markdown by their styles and places (TXT-6, TXT-7).

A line is what a reader of the format yields: its page and block, text, font size and weight, and box."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markdown import HEADING_WORDS, infer_structure, numeric_cell

BAND, REPEATED, LEAST_PAGES, STYLE_SHARE, OVERLAP, CELL_WORDS, LEVELS = 0.08, 0.5, 3, 0.15, 0.5, 5, 3
COLUMN, LEAST_ROWS = 0.03, 2
PAGE_NUMBER = re.compile(r"(?:page\s+)?\d+(?:\s+of\s+\d+)?", re.I)
LIST_MARK = re.compile(r"[-*•·▪◦]|\d{1,3}[.)]|[a-z][.)]|[ivxlcdm]{2,4}[.)]", re.I)


@dataclass(frozen=True)
class Line:
    page: int
    block: int
    text: str
    size: float
    bold: bool
    italic: bool
    x0: float
    y0: float
    x1: float
    y1: float
    mixed: bool = False
    cells: tuple[tuple[str, float], ...] = ()  # of merged lines: text and left edge

    @property
    def style(self) -> tuple[float, bool, bool]:
        return self.size, self.bold, self.italic

    @property
    def height(self) -> float:
        return self.y1 - self.y0


def merge_rows(lines: list[Line]) -> list[Line]:
    """Lines of one block that stand side by side become one, ordered by left edge, in the style of the longest."""
    group = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j in range(i):
            b = lines[j]
            low = min(a.height, b.height)
            if low > 0 and min(a.y1, b.y1) - max(a.y0, b.y0) > low * OVERLAP and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    out = []
    for g in sorted(set(group)):  # a group is named by its first line
        parts = [x for x, k in zip(lines, group, strict=True) if k == g]
        if len(parts) == 1:
            out.append(parts[0])
            continue
        row = sorted(parts, key=lambda x: x.x0)
        long = max(parts, key=lambda x: len("".join(x.text.split())))
        box = {"x0": row[0].x0, "y0": min(x.y0 for x in parts), "x1": max(x.x1 for x in parts), "y1": max(x.y1 for x in parts)}
        mixed = len({x.style for x in parts}) > 1 or any(x.mixed for x in parts)
        out.append(replace(long, text=" ".join(x.text for x in row), mixed=mixed, cells=tuple((x.text, x.x0) for x in row), **box))
    return out


def without_furniture(lines: list[Line], heights: dict[int, float]) -> list[Line]:
    """Page numbers, and texts that most pages repeat, go from the bands at the top and the bottom."""
    edge = lambda x: x.y0 < heights[x.page] * BAND or x.y1 > heights[x.page] * (1 - BAND)
    name = lambda x: " ".join(re.sub(r"\d+", "#", x.text).split()).lower()
    pages = Counter(k for k, _ in {(name(x), x.page) for x in lines if edge(x)}) if len(heights) >= LEAST_PAGES else Counter()
    out = []
    for x in lines:
        text = " ".join(x.text.split())
        if text and not (edge(x) and (PAGE_NUMBER.fullmatch(text) or pages[name(x)] >= max(1, len(heights) * REPEATED))):
            out.append(replace(x, text=text))
    return out


def body_style(lines: list[Line]) -> tuple[float, bool, bool]:
    """The style of most words, the first seen of equals."""
    words: Counter = Counter()
    for x in lines:
        words[x.style] += len(x.text.split())
    return max(words, key=words.__getitem__)


def numeric_row(text: str) -> bool:
    words = text.split()
    numbers = sum(bool(re.fullmatch(r"-?[0-9]+", re.sub(r"[$%(),.]", "", w))) for w in words)
    return numbers >= 2 and 2 * numbers >= len(words)


def candidates(lines: list[Line], body: tuple[float, bool, bool]) -> list[bool]:
    """Lines in a larger or stronger style than the body that read as a heading and stand alone on their row."""
    rows: dict[int, list[Line]] = {}
    for x in lines:
        rows.setdefault(x.page, []).append(x)

    def alone(x: Line) -> bool:
        least = max(x.height, 1) * OVERLAP
        return not any(y is not x and len(y.text.split()) <= CELL_WORDS and min(x.y1, y.y1) - max(x.y0, y.y0) > least for y in rows[x.page])

    def heading(x: Line) -> bool:
        stronger = x.size > body[0] or (x.size == body[0] and ((x.bold and not body[1]) or (x.italic and not body[2])))
        reads = len(x.text.split()) <= HEADING_WORDS and any(map(str.isalpha, x.text)) and x.text[-1] not in ".,;:"
        return stronger and not x.mixed and x.style != body and reads and not numeric_row(x.text) and alone(x)

    return [heading(x) for x in lines]


def follows(a: Line, b: Line) -> bool:
    return a.page == b.page and -a.height / 2 <= b.y0 - a.y1 <= a.height


def headings(lines: list[Line], may: list[bool]) -> list[tuple[int, int]]:
    """Ranges of lines that are one heading each: joined lines of a style; none of a common style, or of a wrapped paragraph."""
    runs: list[list[int]] = []
    for i, ok in enumerate(may):
        if ok and runs and runs[-1][1] == i and lines[i - 1].style == lines[i].style and follows(lines[i - 1], lines[i]):
            runs[-1][1] = i + 1
        elif ok:
            runs.append([i, i + 1])
    each = Counter(x.style for x, ok in zip(lines, may, strict=True) if ok)

    def wrapped(a: int, b: int) -> bool:
        style = lines[a].style
        before = a > 0 and not may[a - 1] and lines[a - 1].style == style and follows(lines[a - 1], lines[a])
        return before or (b < len(lines) and not may[b] and lines[b].style == style and follows(lines[b - 1], lines[b]))

    short = lambda a, b: sum(len(x.text.split()) for x in lines[a:b]) <= HEADING_WORDS
    return [(a, b) for a, b in runs if short(a, b) and each[lines[a].style] <= len(lines) * STYLE_SHARE and not wrapped(a, b)]


def style_levels(lines: list[Line], found: list[tuple[int, int]], n_pages: int) -> dict[tuple, int]:
    """Larger styles first, those of the first page alone last; a single style is level 2."""
    places: dict[tuple, list[int]] = {}
    for a, _ in found:
        places.setdefault(lines[a].style, []).append(a)

    def rank(style: tuple) -> tuple:
        later = [a for a in places[style] if lines[a].page > 0]
        return n_pages > 1 and not later, -style[0], (later or places[style])[0]

    order = sorted(places, key=rank)
    return {s: 2 if len(order) == 1 else min(i, LEVELS) for i, s in enumerate(order, 1)}


def table_rows(lines: list[Line], width: float) -> dict[int, str]:
    """Rows of tables by line: two or more lines in a run whose cells stand on the first one's columns, with a number among them (TXT-7)."""
    rowlike = lambda x: len(x.cells) >= 2 and not any(LIST_MARK.fullmatch(t.strip()) for t, _ in x.cells)

    def on(columns: list[float], x: Line) -> bool:
        at = iter(columns)
        return rowlike(x) and len(x.cells) <= len(columns) and all(any(abs(left - c) <= COLUMN * width for c in at) for _, left in x.cells)

    out, i = {}, 0
    while i < len(lines):
        end = i + 1
        if rowlike(lines[i]):
            columns = [left for _, left in lines[i].cells]
            while end < len(lines) and on(columns, lines[end]):
                end += 1
        if end - i < LEAST_ROWS:
            i += 1
            continue
        start = next((k for k in range(i, end) if not numeric_cell(lines[k].cells[0][0])), i)
        if end - start >= LEAST_ROWS and any(numeric_cell(t) for x in lines[start:end] for t, _ in x.cells):
            out |= {k: " | ".join(t for t, _ in lines[k].cells) for k in range(start, end)}
        i = end
    return out


def styled_markdown(raw: list[Line], heights: dict[int, float], widths: dict[int, float]) -> str | None:
    """Markdown with headings by style; None where no style is a heading's. Pages count from 0."""
    merged = [x for _, block in groupby(raw, key=lambda x: (x.page, x.block)) for x in merge_rows(list(block))]
    lines = without_furniture(merged, heights)
    if not lines:
        return None
    may = candidates(lines, body_style(lines))
    found = headings(lines, may)
    if not found:
        return None
    levels = style_levels(lines, found, len(heights))
    rows: dict[int, str] = {}
    for page, at in groupby(range(len(lines)), key=lambda i: lines[i].page):
        at = list(at)
        rows |= {at[k]: text for k, text in table_rows([lines[i] for i in at], widths.get(page, 612)).items()}
    whole = {a: (b, f"{'#' * levels[lines[a].style]} " + " ".join(x.text for x in lines[a:b])) for a, b in found}
    parts: list[str] = []
    i, open_block = 0, None
    while i < len(lines):
        x = lines[i]
        if i in whole:
            i, text = whole[i]
            parts.append(text)
            open_block = None
            continue
        if i in rows:
            parts.append(rows[i])
            open_block = None
        else:
            text = f"\\{x.text}" if re.match(r"#{1,6}\s", x.text) else x.text
            if open_block == (x.page, x.block):
                parts[-1] += f"\n{text}"
            else:
                parts.append(text)
            open_block = (x.page, x.block)
        i += 1
    return infer_structure("\n\n".join(parts), headings=False)


def plain_text(lines: list[Line]) -> str:
    """Lines by line feeds, blocks by a blank line."""
    return "\n\n".join("\n".join(x.text for x in block) for _, block in groupby(lines, key=lambda x: (x.page, x.block)))


def styled_documents(lines: DataFrame) -> DataFrame:
    """doc_id, markdown (null without headings), plain of lines(doc_id, page, block, line, text, size, bold, italic, x0, y0, x1, y1, page_width, page_height).

    One task reads one document at a time; pages count from 0 and sizes are rounded to halves."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page", "block", "line"])
        rows = [Line(r.page, r.block, r.text or "", round(2 * r.size) / 2, bool(r.bold), bool(r.italic), r.x0, r.y0, r.x1, r.y1) for r in pdf.itertuples()]
        heights, widths = (dict(zip(pdf["page"], pdf[c], strict=True)) for c in ("page_height", "page_width"))
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "markdown": [styled_markdown(rows, heights, widths)], "plain": [plain_text(rows)]})

    kind = lines.schema["doc_id"].dataType.simpleString()
    return lines.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, markdown string, plain string")


def furniture_keys(lines: DataFrame) -> DataFrame:
    """(doc_id, name) of the texts that at least half of a document's three or more pages repeat in their bands, as one plan (TXT-6b)."""
    edge = (F.col("y0") < F.col("page_height") * BAND) | (F.col("y1") > F.col("page_height") * (1 - BAND))
    name = F.lower(F.trim(F.regexp_replace(F.regexp_replace("text", r"\d+", "#"), r"\s+", " ")))
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    seen = lines.where(edge).groupBy("doc_id", name.alias("name")).agg(F.countDistinct("page").alias("n"))
    return seen.join(pages, "doc_id").where(F.col("n") >= F.col("pages") * REPEATED).select("doc_id", "name")

