"""Section-aware chunks: a document's sections are packed greedily into a word budget (TXT-12).

The budget depends on what is already packed, so this is one call per document, in parallel over documents.
A document is one list of words; sections, tables and chunks are ranges of it."""

from __future__ import annotations

import bisect
import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import Range, day_month_order, extract_dates, format_range, posted_date
from ..functions.markdown import dated_sections, linearise_tables, numeric_cell, render_block

SENTENCE = re.compile(r"[.!?][\"')\]]*$")
FILL, EXTRA_TITLES, BATCH = 0.75, 2, 128


@dataclass
class Section:
    path: list[str]
    dates: list[Range]
    kind: str
    start: int
    end: int = 0
    first_heads: int = 0  # where its leading headings end


@dataclass
class Text:
    words: list[str] = field(default_factory=list)
    shown: list[str] = field(default_factory=list)  # each with the space after it, or the line's end after a block
    heads: set[int] = field(default_factory=set)  # where headings end
    ends: list[int] = field(default_factory=list)  # where other blocks end
    tables: list[tuple[int, int, str]] = field(default_factory=list)
    sections: list[Section] = field(default_factory=list)

    def slice(self, a: int, b: int) -> str:
        return "".join(self.shown[a:b])[:-1]

    def add(self, path: list[str], dates: list[Range], blocks: list[tuple[str, str, int]]) -> None:
        s = Section(path, dates, blocks[0][0], len(self.words))
        leading, table, before = True, None, False
        for kind, text, level in blocks:
            at, shown = len(self.words), render_block(kind, text, level)
            if kind != "tableRow":
                before = False
            else:
                numbers = any(map(numeric_cell, (c.strip() for c in shown.split(" | "))))
                opens, before = before and not numbers, numbers
            if table and (kind != "tableRow" or opens):
                self.tables.append((table[0], at, table[1]))
                table = None
            if kind == "tableRow" and not table:
                table = (at, shown)
            own = shown.split()
            self.words += own
            self.shown += [f"{w} " for w in own[:-1]] + [f"{w}\n" for w in own[-1:]]
            if kind == "heading":
                self.heads.add(len(self.words))
                s.first_heads = len(self.words) if leading else s.first_heads
            else:
                leading = False
                self.ends.append(len(self.words))
        if table:
            self.tables.append((table[0], len(self.words), table[1]))
        s.end = len(self.words)
        s.first_heads = max(s.first_heads, s.start)
        self.sections.append(s)


def read_text(md: str, dates_of: Callable[[str], list[Range]]) -> Text:
    """Sections in order; a heading with nothing under it goes to the section that follows, which keeps its path if it begins with a list item."""
    out, carried = Text(), None
    for path, dates, blocks in dated_sections(md, dates_of):
        if len(blocks) == 1 and blocks[0][0] == "heading":
            carried = (path, dates, (carried[2] if carried else []) + blocks)
            continue
        if carried:
            path, blocks = (carried[0] if blocks[0][0] == "listItem" else path), carried[2] + blocks
            carried = None
        out.add(path, dates, blocks)
    if carried:
        out.add(*carried)
    return out


def latest(bounds: list[int], above: int, upto: int) -> int | None:
    """The largest bound in (above, upto]."""
    i = bisect.bisect_right(bounds, upto)
    return bounds[i - 1] if i and bounds[i - 1] > above else None


def structured_chunks(md: str, size: int = 512, file_name: str = "", posted: Range | None = None, count_tokens: Callable[[str], int] | None = None, with_dates: bool = True, order: str | None = None, near: date | None = None) -> list[dict]:
    """Every word once and in order, but for a split table's header; offsets are contiguous; no chunk ends with a heading unless it is all there is."""
    year = int(posted[0][:4]) if posted else None
    dates_in = (lambda text: extract_dates(text, year, order, near)) if with_dates else (lambda text: [])
    t = read_text(md, dates_in)
    if not t.sections:
        return []
    count = count_tokens or (lambda text: len(text.split()))
    n_words, n_tokens = len(md.split()), count(md)
    each = n_tokens / n_words if n_tokens > 0 and n_words else 1.0
    budget = max(1, math.floor(size / each + 0.5))

    def describe(group: list[Section], text: str) -> tuple[str, list[Range], str]:
        titles = [s.path[-1] for s in group[1:] if s.kind == "heading" and s.path and s.path[-1]]
        path = " ; ".join(x for x in [" > ".join(group[0].path), *titles[:EXTRA_TITLES]] if x)
        path += f" +{len(titles) - EXTRA_TITLES} more" if len(titles) > EXTRA_TITLES else ""
        dates = list(dict.fromkeys([d for s in group for d in s.dates] + dates_in(text)))
        parts = [f"File: {file_name}" if file_name else "", f"Posted: {format_range(posted)}" if posted else "", f"Section: {path}" if path else "", f"Dates: {', '.join(map(format_range, dates))}" if dates else ""]
        shown = " | ".join(p for p in parts if p)
        return path, dates, f"[{shown}]" if shown else ""

    header = describe(t.sections[:1], t.slice(t.sections[0].start, t.sections[0].end))[2]
    head_words = len(header.split())
    head_each = count(header) / head_words if head_words and count(header) > 0 else each
    cost = lambda header: math.ceil(len(header.split()) * head_each / each)
    chunks: list[dict] = []

    def emit(group: list[Section], a: int, b: int, repeated: str = "") -> None:
        text = f"{repeated}\n{t.slice(a, b)}" if repeated else t.slice(a, b)
        path, dates, header = describe(group, text)
        embed = linearise_tables(text)
        chunks.append({"text": text, "embed_text": embed if embed != text else None, "context_header": header, "section_path": path, "dates": dates, "start_index": a, "end_index": b})

    def fits(group: list[Section]) -> bool:
        a, b = group[0].start, group[-1].end
        return b - a <= budget and cost(describe(group, t.slice(a, b))[2]) + b - a <= budget

    def split(s: Section) -> None:
        piece = max(math.ceil(budget / 2), budget - cost(describe([s], t.slice(s.start, s.end))[2]))
        sentences = [i + 1 for i in range(s.start, s.end) if SENTENCE.search(t.words[i])]
        tables = [x for x in t.tables if s.start <= x[0] < s.end]
        inside = lambda at: next((x for x in tables if x[0] < at < x[1]), None)
        a = s.start
        while a < s.end:
            limit = min(s.end, a + piece)
            above = max(a, s.first_heads) if a == s.start else a
            b = limit
            if limit < s.end:
                block, sentence = latest(t.ends, above, limit), latest(sentences, above, limit)
                full = block is not None and block >= a + math.ceil(piece * FILL)
                b = block if full else max(x for x in (block, sentence, -1) if x is not None)
                b = limit if b < 0 else b
            if a == s.start and b <= s.first_heads:
                b = min(s.end, s.first_heads + 1)
            if table := inside(b):
                b = table[0] if table[0] > above else latest(t.ends, above, limit) or b
            elif b < s.end and b in t.heads:
                before = latest(t.ends, above, b - 1) or latest(sentences, above, b - 1)
                b = before or b + 1
            opened = next((x for x in tables if x[0] < a < x[1]), None)
            emit([s], a, b, opened[2] if opened else "")
            a = b

    packed: list[Section] = []
    for s in t.sections:
        if packed and fits([*packed, s]):
            packed.append(s)
            continue
        if packed:
            emit(packed, packed[0].start, packed[-1].end)
        packed = [s] if fits([s]) else []
        if not packed:
            split(s)
    if packed:
        emit(packed, packed[0].start, packed[-1].end)
    return chunks


def document_chunks(md: str, name: str, mtime: date | None, size: int, count_tokens: Callable[[str], int] | None) -> list[dict]:
    """Chunks with the document's posted date; without dates where reading them fails (ORC-7)."""
    try:
        posted = posted_date(md, name, mtime) if mtime else None
        return [c | {"posted": posted} for c in structured_chunks(md, size, name, posted, count_tokens, order=day_month_order(md), near=mtime)]
    except (ValueError, OverflowError):
        posted = (mtime.isoformat(),) * 2 if mtime else None
        return [c | {"posted": posted} for c in structured_chunks(md, size, name, posted, count_tokens, with_dates=False)]


def chunk_documents(docs: DataFrame, size: int = 512, count_tokens: Callable[[str], int] | None = None) -> DataFrame:
    """docs(doc_id, text as Markdown[, file_name, mtime]) to chunk rows; null text gives none. Dates are JSON ranges.

    A batch of any size is cut BATCH documents at a time, so a worker holds the chunks of few of them."""
    ranges = lambda rs: json.dumps([{"start": a, "end": b} for a, b in rs])
    kinds = {"chunk_index": "int", "text": "string", "embed_text": "string", "context_header": "string", "section_path": "string", "posted_date": "string", "dates": "string", "start_index": "int", "end_index": "int"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                of, rows = [], []
                for n, (text, name, day) in enumerate(zip(*(part.column(c).to_pylist() for c in ("text", "file_name", "day")), strict=True)):
                    for i, c in enumerate(document_chunks(text or "", name or "", day, size, count_tokens)):
                        of.append(n)
                        rows.append((i, c["text"], c["embed_text"], c["context_header"], c["section_path"], ranges([c["posted"]]) if c["posted"] else None, ranges(c["dates"]), c["start_index"], c["end_index"]))
                if rows:
                    made = [pa.array(x, pa.int32() if k == "int" else pa.string()) for x, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), *made], ["doc_id", *kinds])

    name = F.col("file_name") if "file_name" in docs.columns else F.lit("")
    mtime = F.col("mtime") if "mtime" in docs.columns else F.lit(None)
    rows = docs.select("doc_id", "text", name.alias("file_name"), mtime.cast("timestamp").cast("date").alias("day"))
    return rows.mapInArrow(run, ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{c} {k}" for c, k in kinds.items())]))
