"""Files to Markdown: one parser a format, behind one dispatch by extension (SRC-4..14)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import html_to_markdown, infer_structure, ocr_page
from . import office
from .files import GROUPS

PDF_LEAST, OCR_PAGES, OCR_SCALE, OCR_FLOOR, OCR_STEP, OCR_PIXELS = 50, 50, 2.0, 0.75, 0.25, 50_000_000

Result = tuple[str | None, str | None, str | None]  # text, reason, details


@dataclass(frozen=True)
class Readers:
    """What this library has no reader of its own for. pdf: ordered (name, bytes -> text); ocr: image bytes -> text."""

    pdf: tuple[tuple[str, Callable[[bytes], str]], ...] = ()
    ocr: Callable[[bytes], str] | None = None
    enable_ocr: bool = False
    notes: bool = True
    group_of: dict[str, str] = field(default_factory=lambda: {e: g for g, es in GROUPS.items() for e in es})


def ocr_scale(width: float, height: float) -> float | None:
    """The largest scale at which a page keeps under the pixel bound; None if the least is too much (SRC-11c)."""
    scale = OCR_SCALE
    while scale >= OCR_FLOOR:
        if width * scale * height * scale <= OCR_PIXELS:
            return scale
        scale -= OCR_STEP
    return None


def ocr_pages(pages: list[str]) -> str:
    """The texts of up to OCR_PAGES pages, each under its heading; empty if they hold under PDF_LEAST characters."""
    found = [x for i, raw in enumerate(pages[:OCR_PAGES], 1) if (x := ocr_page(i, raw))]
    return "\n\n".join(md for md, _ in found) if sum(n for _, n in found) >= PDF_LEAST else ""


def one_line(error: Exception) -> str:
    text = re.split(r"</>\s*STACK TRACE|\n\s*at\s", str(error))[0]
    text = " ".join(re.sub(r"^\s*Error\b", " ", re.sub("[─-╿]", " ", text)).split())
    return text if 0 < len(text) <= 160 else f"{text[:159]}…" if text else "unknown error"


def parse_pdf(data: bytes, readers: Readers) -> Result:
    """The first stage with enough text; the failures of all before it are kept as details (SRC-11)."""
    if not readers.pdf:
        return None, "pdf.missing-client", None
    failed = []
    for name, read in readers.pdf:
        try:
            text = (read(data) or "").strip()
        except Exception as e:  # noqa: BLE001  a stage that fails makes way for the next
            failed.append(f"{name}: {one_line(e)}")
            continue
        if len(text) >= PDF_LEAST:
            return text, None, "; ".join(failed) or None
        failed.append(f"{name}: {len(text)} characters")
    return None, "pdf.all-stages-failed", "; ".join(failed)


def parse(name: str, data: bytes | None, readers: Readers = Readers()) -> Result:
    """(text, None, details) or (None, reason, details); never raises."""
    extension = name.rpartition(".")[2].lower() if "." in name else ""
    group, data = readers.group_of.get(extension), bytes(data or b"")
    decoded = lambda: data.decode("utf-8", "replace").removeprefix("﻿")
    parsers: dict[str, Callable[[], str]] = {
        "html": lambda: html_to_markdown(decoded()),
        "markdown": lambda: normalise_markdown(decoded()),
        "text": lambda: infer_structure(decoded()),
        "docx": lambda: office.docx_markdown(data),
        "pptx": lambda: office.pptx_markdown(data, readers.notes),
        "epub": lambda: office.epub_markdown(data),
        "image": lambda: infer_structure(readers.ocr(data)) if readers.ocr else _no_ocr(),
    }
    if group == "pdf":
        return parse_pdf(data, readers)
    if group == "image" and not readers.enable_ocr:
        return None, "image.ocr-disabled", None
    if group not in parsers:
        return None, "unsupported-extension", f".{extension}" if extension else ""
    kind = "text" if group == "markdown" else group
    try:
        text = parsers[group]().strip()
    except Exception as e:  # noqa: BLE001  a file that fails is a row with its reason
        return None, f"{kind}.error", one_line(e)
    return (text, None, None) if text else (None, f"{kind}.empty", f"{name} trimmed to zero length")


def _no_ocr() -> str:
    raise RuntimeError("no image reader is set")


# the rules of functions.text.normalise_markdown, for a text that is already in Python
_RULES = [
    (re.compile(p), r) for p, r in (
        (r"\r\n?", "\n"), (r"(?s)```.*?```", ""), (r"`([^`]+)`", r"\1"), (r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]+)\]\([^)]*\)", r"\1"),
        (r"(?m)^[ \t]{0,3}>[ \t]?", ""), (r"(?m)^[ \t]{0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$", ""), (r"(?m)^([ \t]*)[*+]([ \t]+)", r"\1-\2"),
        (r"(\*\*|__)(.+?)\1", r"\2"), (r"(?<![\w*])\*(?!\s)(.+?)(?<!\s)\*(?![\w*])", r"\1"), (r"(?<!\w)_(?!\s)(.+?)(?<!\s)_(?!\w)", r"\1"),
        (r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$\n?", ""),
    )
]


def normalise_markdown(md: str) -> str:
    for pattern, left in _RULES:
        md = pattern.sub(left, md)
    rows = (" | ".join(c.strip() for c in m[1].split("|")) if (m := re.fullmatch(r"[ \t]*\|(.*)\|[ \t]*", x)) else x for x in md.split("\n"))
    md = re.sub(r"<[^>]+>", " ", "\n".join(rows))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)[ \t]+$", "", md)).strip()


def parse_files(files: DataFrame, readers: Readers = Readers()) -> DataFrame:
    """Every column of files(file_name, content, ...) but content, and text, reason, details; one pass, no shuffle."""

    @F.pandas_udf("text string, reason string, details string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, contents in batches:
            yield pd.DataFrame([parse(n, c, readers) for n, c in zip(names, contents, strict=True)], columns=["text", "reason", "details"])

    rest = [c for c in files.columns if c not in ("content", "text", "reason", "details")]
    return files.select(*rest, run("file_name", "content").alias("_parsed")).select(*rest, "_parsed.*")


def images(files: DataFrame) -> DataFrame:
    """One row an image of files(path, extension, content): path, archive_path, extension, mime_type, data, location (UDTF-2)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                try:
                    found = office.archive_images(bytes(r.content), r.extension)
                except Exception:  # noqa: BLE001  a damaged archive has no images
                    found = []
                for one in found:  # a row at a time: images are large
                    yield pd.DataFrame([{"path": r.path} | one])

    office_files = files.where(F.col("extension").isin("docx", "pptx")).select("path", "extension", "content")
    return office_files.mapInPandas(run, "path string, archive_path string, extension string, mime_type string, data binary, location string")
