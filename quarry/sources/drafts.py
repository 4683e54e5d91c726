"""Drafts of answers, kept per model beside a question set, so that a run repeats without its generator (SNK-8)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import draft_for
from ..store import JsonFiles

VERSION = 1


def drafts_name(questions_name: str, model: str) -> str:
    """One file a question set and model."""
    return f"{questions_name.removesuffix('.json')}.drafts.{re.sub(r'[^A-Za-z0-9._-]+', '-', model)}.json"


def load_drafts(files: JsonFiles, name: str, model: str, regenerate: bool = False) -> dict[str, str]:
    """Draft by question id; empty where the file is missing, of another model, or to be made again."""
    found = files.read(name) or {}
    if regenerate or found.get("version") != VERSION or found.get("model") != model or not isinstance(found.get("drafts"), dict):
        return {}
    return {k: v for k, v in found["drafts"].items() if isinstance(v, str) and v.strip()}


def with_drafts(questions: DataFrame, files: JsonFiles, name: str, model: str, generate: Callable[[str], str], regenerate: bool = False, timeout_s: float = 10.0) -> tuple[DataFrame, dict[str, int]]:
    """questions(id, question) with a draft column, and the counts of hits and misses.

    Only questions without a kept draft are asked for, on the driver, one at a time; one that fails has none and isn't kept."""
    spark, kept = questions.sparkSession, load_drafts(files, name, model, regenerate)
    known = spark.createDataFrame(list(kept.items()), "id string, draft string")
    todo = questions.join(known, "id", "left_anti").select("id", "question").distinct().collect()
    made = {r["id"]: d for r in todo if (d := draft_for(r["question"] or "", generate, timeout_s))}
    if made:
        files.write(name, {"version": VERSION, "model": model, "drafts": kept | made})
    every = spark.createDataFrame(list((kept | made).items()), "id string, draft string")
    hits = questions.join(known, "id", "left_semi").select("id").distinct().count()
    return questions.join(F.broadcast(every), "id", "left"), {"hits": hits, "misses": len(todo)}
