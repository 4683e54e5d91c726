"""What the structure of a folder's documents looks like, and how they would be cut (AGG-13, SUB-28)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.markdown import parse_blocks
from .functions.text import markdown_plain, words
from .operators.chunking import document_chunks
from .operators.indexing import window_chunks

TOKENS_A_WORD = 1.3
COUNTS = ("h1", "h2", "h3", "tables", "table_rows", "pipe_lines")


def estimate_tokens(text: str) -> int:
    return math.ceil(len(text.split()) * TOKENS_A_WORD)


def block_counts(md: str) -> tuple[int, ...]:
    """Headings of levels 1, 2 and deeper; tables (runs of two or more rows), their rows, and rows alone."""
    out = dict.fromkeys(COUNTS, 0)
    for kind, run in groupby(parse_blocks(md), key=lambda b: b[0]):
        blocks = list(run)
        for _, _, level in blocks if kind == "heading" else ():
            out[f"h{min(level, 3)}"] += 1
        if kind == "tableRow" and len(blocks) > 1:
            out["tables"] += 1
            out["table_rows"] += len(blocks)
        elif kind == "tableRow":
            out["pipe_lines"] += 1
    return tuple(out.values())


def structure_report(docs: DataFrame, size: int = 512, overlap: int = 100) -> DataFrame:
    """docs(doc_id, text as Markdown[, file_name, mtime]) to one row each: the counts, legacy_chunks, structured_chunks, fill."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS) + ", structured_chunks long, fill double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, names in batches:
            rows = []
            for text, name in zip(texts, names, strict=True):
                chunks = document_chunks(text or "", name or "", None, size, estimate_tokens)
                used = sum(estimate_tokens(c["context_header"]) + estimate_tokens(c["text"]) for c in chunks)
                rows.append((*block_counts(text or ""), len(chunks), used / size))
            yield pd.DataFrame(rows, columns=[*COUNTS, "structured_chunks", "fill"])

    name = F.col("file_name") if "file_name" in docs.columns else F.lit("")
    plain = docs.select("doc_id", markdown_plain(F.col("text")).alias("text"))
    legacy = window_chunks(plain, size, overlap, F.ceil(F.size(words(F.col("text"))) * TOKENS_A_WORD)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("legacy_chunks"))
    found = docs.select("doc_id", run(F.col("text"), name).alias("_r")).select("doc_id", "_r.*")
    return found.join(legacy, "doc_id", "left").withColumn("legacy_chunks", F.coalesce("legacy_chunks", F.lit(0)).cast("long"))


def totals(report: DataFrame) -> DataFrame:
    """One row over all documents; fill is the mean share of a chunk's budget, in percent."""
    n = F.sum("structured_chunks")
    sums = [F.sum(c).alias(c) for c in (*COUNTS, "legacy_chunks", "structured_chunks")]
    return report.agg(F.count(F.lit(1)).alias("documents"), *sums, (n / F.nullif(F.sum("legacy_chunks"), F.lit(0))).alias("ratio"), F.round(100 * F.sum("fill") / F.nullif(n, F.lit(0))).alias("fill_percent"))
