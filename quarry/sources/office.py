"""Word, slide and book files as Markdown, from their bytes with the standard library (SRC-7..9, SRC-14)."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from html import escape
from urllib.parse import unquote
from xml.etree import ElementTree as ET

from ..functions.markdown import html_to_markdown

# Images that are taken from an archive.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff"}


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in e.iter() if _name(x) == name]


def _child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        e = next((x for x in e if _name(x) == name), None) if e is not None else None
    return e


def _get(e: ET.Element | None, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None) if e is not None else None


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _links(z: zipfile.ZipFile, part: str) -> list[tuple[str, str, str]]:
    """(id, type, target path) of a part's relationships."""
    folder, base = posixpath.split(part)
    root = _xml(z, f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels")
    target = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return [(r.get("Id", ""), r.get("Type", ""), target(r.get("Target", ""))) for r in root] if root is not None else []


def docx_html(data: bytes) -> str:
    """Headings by style, lists by numbering, tables by row, each paragraph's runs joined."""
    z = zipfile.ZipFile(io.BytesIO(data))
    styles, numbering = _xml(z, "word/styles.xml"), _xml(z, "word/numbering.xml")
    heading = {}
    for s in _all(styles, "style") if styles is not None else ():
        if m := re.fullmatch(r"heading ([1-6])", (_get(_child(s, "name"), "val") or "").lower()):
            heading[_get(s, "styleId")] = int(m[1])
    ordered = {}
    if numbering is not None:
        kinds = {_get(a, "abstractNumId"): {_get(lv, "ilvl"): _get(_child(lv, "numFmt"), "val") not in ("bullet", "none", None) for lv in a if _name(lv) == "lvl"} for a in numbering if _name(a) == "abstractNum"}
        ordered = {_get(n, "numId"): kinds.get(_get(_child(n, "abstractNumId"), "val"), {}) for n in numbering if _name(n) == "num"}

    def text(p: ET.Element) -> str:
        return "".join(x.text or "" if _name(x) == "t" else " " if _name(x) in ("br", "cr", "tab") else "" for x in p.iter())

    out: list[str] = []
    lists: list[tuple[str, str]] = []  # open lists, outermost first: tag and number

    def shut(depth: int) -> None:
        while len(lists) > depth:
            out.append(f"</{lists.pop()[0]}>")

    def body(root: ET.Element) -> None:
        for e in root:
            if _name(e) == "tbl":
                shut(0)
                rows = ["".join(f"<td>{escape(' '.join(text(p) for p in _all(c, 'p')))}</td>" for c in r if _name(c) == "tc") for r in e if _name(r) == "tr"]
                out.append("<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>")
            elif _name(e) == "p":
                style = _get(_child(e, "pPr", "pStyle"), "val") or ""
                number = _get(_child(e, "pPr", "numPr", "numId"), "val")
                level = heading.get(style) or (int(m[1]) if (m := re.fullmatch(r"Heading([1-6])", style)) else 0)
                if level or not number or number == "0":
                    shut(0)
                    out.append(f"<h{level}>{escape(text(e))}</h{level}>" if level else f"<p>{escape(text(e))}</p>")
                    continue
                deep = int(_get(_child(e, "pPr", "numPr", "ilvl"), "val") or 0)
                shut(deep + 1)
                if len(lists) > deep and lists[deep][1] != number:
                    shut(deep)
                while len(lists) <= deep:
                    lists.append(("ol" if ordered.get(number, {}).get(str(len(lists))) else "ul", number))
                    out.append(f"<{lists[-1][0]}>")
                out.append(f"<li>{escape(text(e))}</li>")
            elif _name(e) in ("sdt", "sdtContent"):
                body(e)

    body(_child(_xml(z, "word/document.xml"), "body"))
    shut(0)
    return f"<body>{''.join(out)}</body>"


def docx_markdown(data: bytes) -> str:
    return html_to_markdown(docx_html(data))


def slide_paths(z: zipfile.ZipFile) -> list[str]:
    """Slides in the order they are shown; by number where the presentation doesn't say."""
    deck, names = _xml(z, "ppt/presentation.xml"), set(z.namelist())
    if deck is not None:
        target = {i: t for i, _, t in _links(z, "ppt/presentation.xml")}
        ids = [next((v for k, v in s.attrib.items() if k.startswith("{")), "") for s in _all(deck, "sldId")]
        if found := [target[i] for i in ids if target.get(i) in names]:
            return found
    slides = [(int(m[1]), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
    return [n for _, n in sorted(slides)]


def _slide_blocks(root: ET.Element) -> list[tuple[bool, str]]:
    """(is a table row, text) of paragraphs and rows in document order."""
    out: list[tuple[bool, str]] = []
    line = lambda p: "".join(x.text or "" for x in _all(p, "t")).strip()

    def walk(e: ET.Element) -> None:
        for x in e:
            if _name(x) == "tbl":
                for row in _all(x, "tr"):
                    cells = [" ".join(t for p in _all(c, "p") if (t := line(p))) for c in row if _name(c) == "tc"]
                    if any(cells):
                        out.append((True, " | ".join(cells)))
            elif _name(x) == "p" and x.tag.startswith("{http://schemas.openxmlformats.org/drawingml"):
                if t := line(x):
                    out.append((False, t))
            else:
                walk(x)

    walk(root)
    return out


def pptx_markdown(data: bytes, notes: bool = True) -> str:
    z, slides = zipfile.ZipFile(io.BytesIO(data)), []
    for i, path in enumerate(slide_paths(z), 1):
        found = _slide_blocks(_xml(z, path))
        title = next((k for k, (row, _) in enumerate(found) if not row), None)
        if not found and not notes:
            continue
        lines = [f"## Slide {i}" + (f": {found[title][1]}" if title is not None else "")]
        lines += [t if row else f"- {t}" for k, (row, t) in enumerate(found) if k != title]
        page = next((t for _, kind, t in _links(z, path) if kind.endswith("/notesSlide")), None)
        if notes and page in z.namelist() and (said := _slide_blocks(_xml(z, page))):
            lines += ["", "### Notes", *(t for _, t in said)]
        slides.append("\n".join(lines))
    return "\n\n".join(slides)


def epub_markdown(data: bytes) -> str:
    """Chapters in spine order; a book that can't be read is empty."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        package = _get(_all(_xml(z, "META-INF/container.xml"), "rootfile")[0], "full-path")
        root, folder, names = _xml(z, package), posixpath.dirname(package), set(z.namelist())
        place = {i.get("id"): posixpath.normpath(posixpath.join(folder, unquote(i.get("href", "")))) for i in _all(root, "item")}
        parts = [place.get(r.get("idref")) for r in _all(root, "itemref")]
        texts = [html_to_markdown(z.read(p).decode("utf-8", "replace")) for p in parts if p in names]
        return re.sub(r"\n{3,}", "\n\n", "\n\n".join(t for t in texts if t)).strip()
    except Exception:  # noqa: BLE001  any damage to a book is an empty text, by contract
        return ""


def archive_images(data: bytes, extension: str) -> list[dict]:
    """Raster images of a Word or slide file, those of slides with the slide they stand on."""
    z = zipfile.ZipFile(io.BytesIO(data))
    media = {"docx": "word/media/", "pptx": "ppt/media/"}.get(extension)
    if not media:
        return []
    on = {}
    for i, path in enumerate(slide_paths(z) if extension == "pptx" else (), 1):
        on |= {t: f"Slide {i}" for _, kind, t in _links(z, path) if kind.endswith("/image")}
    out = []
    for n in z.namelist():
        kind = n.rpartition(".")[2].lower()
        if n.startswith(media) and not n.endswith("/") and kind in IMAGE_TYPES:
            out.append({"archive_path": n, "extension": kind, "mime_type": IMAGE_TYPES[kind], "data": z.read(n), "location": on.get(n)})
    return out
