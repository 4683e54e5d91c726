"""Prompts around retrieved passages (TXT-24..28, FLT-12, SUB-23)."""

from __future__ import annotations

import concurrent.futures
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.retrieval import fit_budget, prompt_order, relevance_cut
from ..settings import DEFAULT_TEMPLATE
from .text import match_label, rendered

CONTEXT, QUESTION = "{{rag_context}}", "{{user_query}}"


def normalise_template(template: str | None) -> str:
    """The template, or the default one if it is blank, with both macros."""
    out = template if template and template.strip() else DEFAULT_TEMPLATE
    out = out if CONTEXT in out else f"{CONTEXT}\n\n{out}"
    return out if QUESTION in out else f"{out}\n\nUser Query:\n\n{QUESTION}"


def fill_template(template: str, context: str, question: str) -> str:
    """Macros become their values as they stand, the context's first."""
    return template.replace(CONTEXT, context).replace(QUESTION, question)


def draft_prompt(question: str) -> str:
    """Asks for a passage as a document with the answer would have it; the draft is embedded and never shown."""
    return (
        "Write a passage of two or three sentences as it could stand in a document that answers the question below, in that document's own terms, labels and figures. "
        f"Don't address the reader, don't explain, don't say whether you know the answer; details may be invented.\n\nQuestion: {question}\n\nPassage:"
    )


def draft_for(question: str, generate: Callable[[str], str], timeout_s: float = 10.0) -> str | None:
    """The draft, or None on a blank question or draft, an error or a timeout; never raises (UDF-3)."""
    if not question.strip():
        return None
    pool = concurrent.futures.ThreadPoolExecutor(1)
    try:
        text = pool.submit(generate, draft_prompt(question)).result(timeout_s)
        return text.strip() or None if isinstance(text, str) else None
    except Exception:  # noqa: BLE001  high depth becomes medium for this question
        return None
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def cited(passages: DataFrame) -> DataFrame:
    """passages(query_id, position, text, score, lanes, file_path) to one citation each: query_id, position, citation, score, source (SUB-23)."""
    label = match_label(F.col("position"), F.col("lanes"), F.col("score"))
    return passages.select("query_id", "position", F.concat(F.col("text"), F.lit(" \n\n ["), label, F.lit("]")).alias("citation"), "score", F.col("file_path").alias("source"))


def answer_context(passages: DataFrame, questions: DataFrame, template: str | None, budget: int, cut: float = 0.0) -> DataFrame:
    """(query_id, prompt, used) of passages(query_id, position, text, score, similarity, context_header[, tokens]) (ORC-3, ORC-5).

    Weak passages go, the longest prefix within the budget stays, never none, and the best one comes last.
    A question without passages gets its template with an empty context."""
    shown = rendered(F.col("context_header"), F.col("text"))
    rows = passages.withColumn("rank", F.col("position")).withColumn("shown", shown)
    if "tokens" not in passages.columns:
        rows = rows.withColumn("tokens", F.size(F.filter(F.split("shown", r"\s+"), lambda w: w != "")).cast("long"))
    kept = prompt_order(fit_budget(relevance_cut(rows, cut), budget), 2**31 - 1)
    parts = F.array_sort(F.collect_list(F.struct("prompt_position", "shown")))
    context = kept.groupBy("query_id").agg(F.array_join(parts["shown"], "\n\n").alias("context"), F.count(F.lit(1)).alias("used"))
    text = F.lit(normalise_template(template))
    rows = questions.select("query_id", "question").join(context, "query_id", "left")
    prompt = F.replace(F.replace(text, F.lit(CONTEXT), F.coalesce("context", F.lit(""))), F.lit(QUESTION), F.col("question"))
    return rows.select("query_id", prompt.alias("prompt"), F.coalesce("used", F.lit(0)).cast("long").alias("used"))
