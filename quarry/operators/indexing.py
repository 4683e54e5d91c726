"""Chunking and incremental indexing as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def window_chunks(docs: DataFrame, size: int = 512, overlap: int = 100, tokens: Column | None = None) -> DataFrame:
    """docs(doc_id, text) into word windows (TXT-13): doc_id, chunk_index, start_index, end_index, text.

    tokens: a text's number of tokens; size and overlap count tokens then, at the text's own tokens a word."""
    w = docs.select("doc_id", words(F.col("text")).alias("w"), (F.lit(None) if tokens is None else tokens).cast("double").alias("tokens")).where(F.size("w") > 0)
    each = F.when(F.col("tokens") > 0, F.col("tokens") / F.size("w")).otherwise(1.0)
    half_up = lambda c: F.floor(c + 0.5).cast("int")
    w = w.withColumn("window", F.greatest(F.lit(1), half_up(size / each)))
    w = w.withColumn("step", F.greatest(F.lit(1), F.col("window") - F.least(F.greatest(half_up(overlap / each), F.lit(0)), F.col("window") - 1)))
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - F.col("window")) / F.col("step"))).cast("int")
    out = w.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("chunk_index") * F.col("step")
    return out.select("doc_id", "chunk_index", start.alias("start_index"), F.least(start + F.col("window"), F.size("w")).alias("end_index"), F.array_join(F.slice("w", start + 1, F.col("window")), " ").alias("text"))


def incremental_plan(inventory: DataFrame, scanned: DataFrame) -> DataFrame:
    """inventory(file_path, file_hash), scanned(file_path, file_hash): skip, new, updated or delete (JOIN-1..4, SET-2)."""
    old = inventory.groupBy("file_path").agg(F.collect_set("file_hash").alias("known"))
    both = scanned.select("file_path", "file_hash").join(old, "file_path", "full_outer")
    action = F.when(F.col("file_hash").isNull(), "delete").when(F.col("known").isNull(), "new").when(F.array_contains("known", F.col("file_hash")), "skip").otherwise("updated")
    return both.select("file_path", action.alias("action"))


def skip_failures(files: DataFrame, failures: DataFrame) -> DataFrame:
    """files(file_path, file_hash) without those that failed before with the very same content (JOIN-3)."""
    return files.join(failures.select("file_path", "file_hash").distinct(), ["file_path", "file_hash"], "left_anti")


def last_failures(events: DataFrame) -> DataFrame:
    """events(file_path, file_hash, reason, at) to the last one of each path; a null reason clears (SNK-5)."""
    last = events.groupBy("file_path").agg(F.max(F.struct("at", "file_hash", "reason")).alias("x"))
    return last.select("file_path", "x.file_hash", "x.reason").where("reason IS NOT NULL")


def run_tallies(results: DataFrame) -> DataFrame:
    """results(action, reason) to one row: a skipped file counts as a success, too (AGG-9)."""
    ok = F.col("reason").isNull() & F.col("action").isin("new", "updated", "skip")
    n = lambda c, name: F.count_if(c).alias(name)
    return results.agg(n(F.col("action") != "delete", "files"), n(ok, "successful"), n(F.col("reason").isNotNull(), "failed"), n(F.col("action") == "skip", "skipped"), n(ok & (F.col("action") == "new"), "new_files"), n(ok & (F.col("action") == "updated"), "updated"), n(F.col("action") == "delete", "deleted"))


def changed(tallies: DataFrame) -> DataFrame:
    """Whether a run changed the store (INC-6)."""
    return tallies.select((F.col("updated") + F.col("new_files") + F.col("deleted") > 0).alias("changed"))


def catalog(chunks: DataFrame) -> DataFrame:
    """(key, day) of chunks(key, posted_date, dates): the days, as YYYYMMDD, at both ends of each range (AGG-10).

    Both columns are JSON, of one {start, end} or a list; other JSON, or none, is undated."""
    kind = "array<struct<start:string,end:string>>"
    ends = F.concat(*[F.coalesce(F.from_json(F.when(F.col(c).startswith("["), F.col(c)).otherwise(F.concat(F.lit("["), c, F.lit("]"))), kind), F.array().cast(kind)) for c in ("posted_date", "dates")])
    days = F.flatten(F.transform(ends, lambda r: F.array(r["start"], r["end"])))
    day = F.regexp_replace("iso", "-", "").try_cast("int")
    return chunks.select("key", F.explode(F.array_distinct(days)).alias("iso")).select("key", day.alias("day")).where("day IS NOT NULL").distinct()


def years_present(days: DataFrame) -> DataFrame:
    """Years of a catalog (AGG-11)."""
    return days.select(F.floor(F.col("day") / 10000).cast("int").alias("year")).distinct()
