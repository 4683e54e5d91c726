"""Document text to Markdown: state machines, one call per document (TXT-1, 4, 9, 10, 11)."""

from __future__ import annotations

import re
from html.parser import HTMLParser

_LIST = re.compile(r"^(?:(\d{1,3}|[a-zA-Z])[.)]|[-*•▪◦])\s+")
_HEAD = re.compile(r"^(#{1,6})\s+(\S.*)$")
_ITEM = re.compile(r"^([ \t]*)(?:-|\d{1,3}\.|[a-z]\.)[ \t]+\S")
HEADING_WORDS, TITLE = 12, 80


def heading_candidate(line: str) -> bool:
    return line.count(" ") < HEADING_WORDS and line[-1] not in ".,;:" and any(map(str.isalpha, line))


def infer_structure(raw: str, headings: bool = True) -> str:
    """Plain text to blocks: short lines that open a block become headings, wrapped lines join the paragraph or item they continue."""
    lines = [re.sub(r"[ \t\f\v]+", " ", x).strip() for x in re.sub(r"\r\n?", "\n", raw).split("\n")]
    blocks: list[str] = []
    open_block = False  # whether the next plain line continues the last block
    for line, after in zip(lines, [*lines[1:], ""], strict=True):
        item = _LIST.match(line)
        if not line:
            open_block = False
        elif _HEAD.match(line):
            blocks.append(line)
            open_block = False
        elif item:
            blocks.append(f"{item[1]}. {line[item.end():]}" if item[1] else f"- {line[item.end():]}")
            open_block = True
        elif open_block:
            blocks[-1] += f" {line}"
        else:
            heading = headings and heading_candidate(line) and (not after or not blocks)
            blocks.append(f"## {line}" if heading else line)
            open_block = not heading
    return "\n\n".join(blocks)


def ocr_page(number: int, raw: str) -> tuple[str, int] | None:
    """A page read from an image under a heading of its own, and the length without it (TXT-5)."""
    body = infer_structure(raw)
    return (f"## Page {number}\n\n{body}", len(body)) if body else None


def numeric_cell(cell: str) -> bool:
    bare = re.sub(r"[$%(),.]", "", cell.removeprefix("-")).strip()
    return bool(re.fullmatch(r"[0-9]+", bare))


def linearise_tables(text: str) -> str:
    """Pipe rows after a header row read `first — column: value; …`; a row of words after one with numbers opens a new table (TXT-9)."""
    out, header, numbers = [], None, False
    for line in text.split("\n"):
        cells = [c.strip() for c in line.split(" | ")]
        if len(cells) == 1:
            header, numbers = None, False
            out.append(line)
            continue
        before, numbers = numbers, any(map(numeric_cell, cells))
        if header is None or (before and not numbers):
            header = cells
            out.append(line)
            continue
        rest = "; ".join(f"{header[i]}: {c}" if i < len(header) and header[i] else c for i, c in enumerate(cells) if i)
        out.append(f"{cells[0]} — {rest}" if rest else cells[0])
    return "\n".join(out)


class _Reader(HTMLParser):
    SKIP, BLOCK = frozenset("script style noscript nav head".split()), frozenset("p div section article main header footer aside blockquote pre ul ol table tr li h1 h2 h3 h4 h5 h6 body html figure dl dt dd".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.out, self.buf, self.lists, self.cells, self.prefix = 0, [], [], [], None, ""

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.buf)).strip()
        self.buf = []
        if text and self.cells is None:
            self.out.append(self.prefix + text)
            self.prefix = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        if self.skip:
            return
        if tag == "br":
            self.buf.append(" ")
        if tag in ("td", "th"):
            self.buf = []
        elif tag in self.BLOCK:
            self.flush()
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "tr":
            self.cells = []
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            self.prefix = "  " * (len(self.lists) - 1) + (f"{self.lists[-1][1]}. " if self.lists[-1][0] == "ol" else "- ")
        elif re.fullmatch("h[1-6]", tag):
            self.prefix = "#" * min(3, int(tag[1])) + " "

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        if self.skip:
            return
        if tag in ("td", "th") and self.cells is not None:
            self.cells.append(re.sub(r"\s+", " ", "".join(self.buf)).strip())
            self.buf = []
        elif tag == "tr" and self.cells is not None:
            row, self.cells, self.buf = self.cells, None, []
            if any(row):
                self.out.append(" | ".join(row))
        elif tag in self.BLOCK:
            self.flush()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()

    def handle_data(self, data):
        if not self.skip:
            self.buf.append(data)


def html_to_markdown(html: str) -> str:
    r = _Reader()
    r.feed(html or "")
    r.close()
    r.flush()
    joined = ""
    for a, b in zip([""] + r.out, r.out, strict=False):
        close = (_LIST.match(a.lstrip()) and _LIST.match(b.lstrip())) or (" | " in a and " | " in b)
        joined += ("\n" if close else "\n\n" if joined else "") + b
    return joined.strip()


def parse_blocks(md: str) -> list[tuple[str, str, int]]:
    """(kind, text, level): heading, listItem, tableRow or paragraph; lines right after an item or in a paragraph join it (TXT-10)."""
    out: list[tuple[str, str, int]] = []
    joins = ""  # the kind of block that the next plain line continues
    for raw in re.sub(r"\r\n?", "\n", md).split("\n"):
        line = raw.strip()
        head, item = _HEAD.match(line), _ITEM.match(raw)
        if not line:
            joins = ""
        elif head:
            out.append(("heading", head[2].strip(), len(head[1])))
            joins = ""
        elif item:
            out.append(("listItem", line, len(item[1]) // 2))
            joins = "listItem"
        elif " | " in line:
            out.append(("tableRow", line, 0))
            joins = ""
        elif joins:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line}", out[-1][2])
        else:
            out.append(("paragraph", line, 0))
            joins = "paragraph"
    return out


def render_block(kind: str, text: str, level: int) -> str:
    return f"{'#' * level} {text}" if kind == "heading" else "  " * level + text


def leading_text(text: str) -> str:
    return text if len(text) <= TITLE else text[:TITLE].rstrip()


def dated_sections(md: str, dates_of=lambda text: []) -> list[tuple[list[str], list, list[tuple[str, str, int]]]]:
    """(path, dates, blocks) of every section (TXT-11).

    A heading opens a section and closes those of its level or deeper; so does a list item of the top
    level, under its own first words. A section's dates stand in the first words of its title, else
    of the block right under its heading, which then holds for all below; else they are its parent's."""
    out: list[tuple[list[str], list, list[tuple[str, str, int]]]] = []
    above: list[list] = []  # [level, title, dates] of the open headings
    undated = False  # whether the open section is a heading's that has no date of its own
    for kind, text, level in parse_blocks(md):
        own = dates_of(leading_text(text)) if kind == "heading" or (kind == "listItem" and level == 0) or (undated and len(out[-1][2]) == 1) else []
        if kind == "heading":
            while above and above[-1][0] >= level:
                above.pop()
            above.append([level, text, own or (above[-1][2] if above else [])])
            out.append(([x[1] for x in above], above[-1][2], [(kind, text, level)]))
            undated = not own
        elif kind == "listItem" and level == 0:
            out.append(([*(x[1] for x in above), leading_text(text)], own or (above[-1][2] if above else []), [(kind, text, level)]))
            undated = False
        elif not out:
            out.append(([], [], [(kind, text, level)]))
        else:
            path, dates, blocks = out[-1]
            if undated and len(blocks) == 1 and own:
                above[-1][2] = dates = own
                undated = False
            blocks.append((kind, text, level))
            out[-1] = (path, dates, blocks)
    return out


def sections(md: str) -> list[tuple[list[str], list[tuple[str, str, int]]]]:
    return [(path, blocks) for path, _, blocks in dated_sections(md)]
