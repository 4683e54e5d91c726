"""Exact deduplication (DataFrame functions only).

Rows are grouped by a 128-bit content hash together with the bytes themselves, so rows whose
hashes collide never share a group; the map side collapses copies before the shuffle. Null text
counts as empty; the smallest doc_id stays (nulls only if all are null); repeated rows of the
smallest doc_id are one record and all flagged kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, read, text_of


def exact_groups(docs: DataFrame) -> DataFrame:
    norm = docs.select("doc_id", F.regexp_replace(text_of(docs), BLANK, " ").alias("norm"))
    keyed = norm.select("doc_id", "norm", F.md5("norm").alias("h"))
    groups = keyed.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    rows = keyed.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"))
    # adaptive execution splits the partition of a hot hash
    return rows.join(groups, ["h", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""
