"""Whole runs: index a folder into a store, answer questions from it, evaluate it (ORC-1, 4, 6, 8, INC-1)."""

from __future__ import annotations

import datetime
import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates
from .functions.text import markdown_plain, prefixed
from .operators import chunking, evaluation, indexing
from .operators.retrieve import diagnostic_pool, retrieve
from .settings import FIXED_DEFAULTS, Settings, snapshot
from .sources import documents, files
from .store import ChunkStore, RunLock, reason_counts

DIMENSIONS, DELETED_SHOWN = 64, 5


def hash_embedding(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """A vector of the text's words, the same on every machine: for tests and as the stand-in of a model (UDF-1)."""
    v = np.zeros(dimensions)
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dimensions] += 1 - 2 * (h >> 63)
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


@dataclass(frozen=True)
class Seams:
    """What a deployment plugs in: a model's vectors, its tokens, and readers of pdf files and images (UDF-1, 2, 4)."""

    embed: Callable[[str], list[float]] = hash_embedding
    count_tokens: Callable[[str], int] | None = None
    readers: documents.Readers = field(default_factory=documents.Readers)


def embedded(rows: DataFrame, text: str, model: str, side: str, seams: Seams, out: str = "vector") -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else [float(x) for x in seams.embed(t)] for t in texts], dtype=object)

    return rows.withColumn(out, run(prefixed(model, F.col(text), side)))


def counted(text: Column, count_tokens: Callable[[str], int]) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([count_tokens(t or "") for t in texts], dtype="int64")

    return run(text)


def chunk_rows(parsed: DataFrame, settings: Settings, seams: Seams) -> DataFrame:
    """Chunks of parsed(file_path, file_name, file_hash, mtime, text) with headers and dates, not embedded yet (ORC-7)."""
    docs = parsed.select(F.col("file_path").alias("doc_id"), "file_name", "mtime", "text")
    if settings.structured:
        out = chunking.chunk_documents(docs, settings.chunk_size, seams.count_tokens)
    else:
        plain = docs.withColumn("text", markdown_plain(F.col("text")))
        tokens = None if seams.count_tokens is None else counted(F.col("text"), seams.count_tokens)
        out = indexing.window_chunks(plain, settings.chunk_size, settings.chunk_overlap, tokens).withColumn("context_header", F.lit(""))
        for c in ("embed_text", "section_path", "posted_date", "dates"):
            out = out.withColumn(c, F.lit(None).cast("string"))
    about = parsed.select(F.col("file_path").alias("doc_id"), "file_name", "file_hash")
    key = F.concat_ws("/", F.substring("file_hash", 1, 16), F.sha1("doc_id"), F.col("chunk_index").cast("string"))
    return out.join(about, "doc_id").withColumn("key", key).withColumnRenamed("doc_id", "file_path")


def index(spark: SparkSession, root: str, store_root: str, settings: Settings = FIXED_DEFAULTS, seams: Seams = Seams(), mode: str = "changed") -> dict:
    """Brings the store up to date with the folder; mode `rebuild` reads every file again, `off` does nothing."""
    if mode == "off":
        return {"mode": mode}
    with RunLock():
        store = ChunkStore(spark, store_root)
        rebuild = store.plan_format(settings.structured, settings.model)[1] or mode == "rebuild"
        listed = files.scan(spark, root, settings.exclude)
        kept = listed.where("excluded_by IS NULL").drop("excluded_by")
        read = files.with_content(spark, kept, root).withColumnRenamed("path", "file_path")
        plan = indexing.incremental_plan(store.inventory(), read.select("file_path", "file_hash"))
        if rebuild:
            plan = plan.withColumn("action", F.when(F.col("action") == "skip", "updated").otherwise(F.col("action")))
        plan = _kept(plan, store, "plan")
        todo = read.join(plan.where("action IN ('new', 'updated')").select("file_path"), "file_path", "left_semi")
        known = store.failures() if not rebuild else store.failures().limit(0)
        parsed = _kept(documents.parse_files(indexing.skip_failures(todo, known), seams.readers), store, "parsed")
        chunks = chunk_rows(parsed.where("text IS NOT NULL"), settings, seams)
        chunks = embedded(chunks.withColumn("_e", F.concat_ws("\n", F.nullif("context_header", F.lit("")), F.coalesce("embed_text", "text"))), "_e", settings.model, "document", seams)
        # the chunks of files that changed go even if the new content can't be read
        store.upsert(chunks, gone=plan.where("action <> 'skip' AND action <> 'new'").select("file_path"))
        store.record_failures(parsed.select("file_path", "file_hash", "reason"))
        store.sync_manifest(settings.model, len(seams.embed(".")), settings.structured)
        store.save_catalog()
        results = plan.join(parsed.select("file_path", "reason"), "file_path", "left").join(known.select("file_path", F.col("reason").alias("before")), "file_path", "left")
        results = results.withColumn("reason", F.when(F.col("action").isin("new", "updated"), F.coalesce("reason", "before")))
        summary = indexing.run_tallies(results).first().asDict() | {"excluded": listed.where("excluded_by IS NOT NULL").count()}
        summary["deleted_paths"] = [r[0] for r in plan.where("action = 'delete'").orderBy("file_path").limit(DELETED_SHOWN).select("file_path").collect()]
        summary["reasons"] = {r["reason"]: r["n"] for r in reason_counts(results).collect()}
        store.write_failure_report(summary, results)
        return summary


def _kept(df: DataFrame, store: ChunkStore, name: str) -> DataFrame:
    """Written beside the store: a run's plan must not change while the store does."""
    path = f"{store.files.root}/runs/{name}-{hashlib.sha1(str(datetime.datetime.now().timestamp()).encode()).hexdigest()[:12]}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reindex_file(spark: SparkSession, root: str, path: str, store_root: str, settings: Settings = FIXED_DEFAULTS, seams: Seams = Seams()) -> None:
    """One file again: its chunks are replaced in one step (INC-4)."""
    store = ChunkStore(spark, store_root)
    one = files.scan(spark, root).where(F.col("path").endswith(path))
    parsed = _kept(documents.parse_files(files.with_content(spark, one, root).withColumnRenamed("path", "file_path"), seams.readers), store, "parsed")
    chunks = embedded(chunk_rows(parsed.where("text IS NOT NULL"), settings, seams), "text", settings.model, "document", seams)
    store.upsert(chunks, gone=parsed.select("file_path"))


def ask(store: ChunkStore, questions: DataFrame, settings: Settings, seams: Seams = Seams(), today: datetime.date | None = None) -> tuple[DataFrame, DataFrame]:
    """(passages, diagnostic pool of 50) for questions(query_id, question[, draft])."""
    if problem := store.check_model(settings.model, len(seams.embed("."))):
        raise ValueError(problem)
    q = embedded(questions, "question", settings.model, "query", seams)
    q = embedded(q, "draft", settings.model, "document", seams, "hyde") if "draft" in questions.columns else q.withColumn("hyde", F.lit(None).cast("array<double>"))
    days = store.catalog()
    years = [r[0] for r in indexing.years_present(days).collect()]  # one row a year
    now = today or datetime.date.today()

    @F.udf("array<struct<start_day:int,end_day:int>>")
    def ranges_of(question: str):
        return dates.question_ranges(question or "", now, years)

    ranges = q.select("query_id", F.explode(ranges_of("question")).alias("r")).select("query_id", "r.*")
    chunks, o = store.chunks(), settings.options()
    return retrieve(chunks, q, o, ranges, days), diagnostic_pool(chunks, q, 50, o, ranges, days)


def run_evaluation(store: ChunkStore, questions: DataFrame, root: str, settings: Settings, seams: Seams = Seams(), today: datetime.date | None = None) -> dict:
    """The report of questions(id, question, sourceFile, answerSnippet): settings, metrics and a row a question (ORC-8, SNK-9)."""
    base = "file:" + root.rstrip("/") + "/" if "://" not in root else root.rstrip("/") + "/"
    relative = lambda c: F.regexp_replace(F.regexp_replace(c, r"^file:/+", "file:/"), "^" + base.replace("file:///", "file:/"), "")
    passages, pool = ask(store, questions.select(F.col("id").alias("query_id"), "question"), settings, seams, today)
    chunks = store.chunks().select("key", relative(F.col("file_path")).alias("file_path"), "chunk_index", "text", "start_index", "end_index")
    pool = pool.join(chunks.select("key", "file_path", "chunk_index", "text"), "key").withColumnRenamed("position", "rank")
    passages = passages.withColumn("file_path", relative(F.col("file_path"))).withColumnRenamed("position", "rank")
    rows = evaluation.score_questions(questions, passages, pool, chunks.select("file_path").distinct(), evaluation.evidence_location(chunks, questions))
    rows = _kept(rows, store, "scores")
    found = evaluation.metrics(rows).first().asDict()
    if not found["scored"] and not rows.isEmpty():
        raise ValueError("no question could be scored: none of their files is in the index; check the documents folder")
    report = {"settings": snapshot(settings, store.manifest(), questions=rows.count()), "metrics": found, "questions": [r.asDict() for r in rows.orderBy("id").collect()]}
    at = datetime.datetime.now(datetime.UTC).isoformat().replace(":", "-").replace(".", "-")
    store.files.write_new(f"reports/run-{at}.json", json.loads(json.dumps(report, default=str)))
    return report


def metrics_table(m: dict, pool: int = 50) -> str:
    """The metrics of a run as lines of text; a rate has one decimal (SUB-29)."""
    percent = lambda x: "n/a" if x is None else f"{100 * x:.1f}%"
    rows = [
        ("Questions scored", str(m["scored"])), ("Unscorable: file not indexed", str(m["file_not_indexed"])), ("Unscorable: evidence not in the index", str(m["evidence_not_in_index"])), ("Final hit rate", percent(m["hit_rate"])),
        (f"Pool hit rate (top {pool})", percent(m["pool_hit_rate"])), ("Filter loss", percent(m["filter_loss"])), ("Right file, wrong passage", percent(m["right_file_wrong_passage"])),
        ("Median answer rank in pool", "n/a" if m["median_pool_rank"] is None else f"{m['median_pool_rank']:g}"), ("Mean reciprocal rank", f"{m['mrr'] or 0:.3f}"), ("Mean passages returned", f"{m['mean_returned'] or 0:.1f}"),
        (f"Passage accuracy (of {m['right_file_returned']} that found the document)", percent(m["passage_accuracy"])),
    ]
    width = max(len(k) for k, _ in rows) + 2
    return "\n".join(f"{k:<{width}}{v}" for k, v in rows)
