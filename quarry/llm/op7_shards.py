"""Weighted rendezvous sharding (DataFrame functions only).

Every (key, shard) pair gets a hash u in (0, 1) and the row goes to the shard with the
smallest -ln(u)/weight, so adding a shard moves rows only into it. A null key hashes as the
empty string; repeated keys share a shard and get slots of their own; a null text has size 8
and checksum 0; an empty table gives an empty result. Only the named columns are read. A shard's
slots are dealt by buckets of about BUCKET_ROWS rows, so neither a task nor the number of shards
limits a shard's size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, text_of

BUCKET_ROWS = 20_000


def shard_of(key: Column, weights: list[float]) -> Column:
    def cost(i: int, w: float) -> Column:
        draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{i}"))), 1, 13), 16, 10).cast("double")
        return F.struct((-F.ln((draw + 1) / F.lit(float(2**52 + 1))) / F.lit(float(w))).alias("c"), F.lit(i).alias("i"))

    return F.least(*[cost(i, w) for i, w in enumerate(weights)])["i"] if len(weights) > 1 else F.lit(0)


def shard(docs: DataFrame, weights: list[float], grown_weight: float = 1.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Slots are gapless in each shard: a bucket's first slot is a prefix sum over bucket counts,
    so no task sorts a whole shard. Rows of one key may fall into several buckets."""
    buckets = max(1, math.ceil(docs.count() / (len(weights) * bucket_rows)))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text_of(docs)) + 8).cast("long").alias("size"),
        F.crc32(text_of(docs)).alias("text_crc32"),
        shard_of(docs["doc_id"], weights).alias("shard"),
        shard_of(docs["doc_id"], [*weights, grown_weight]).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", text_of(docs)), F.lit(buckets)).alias("bucket"),
    )
    counts = rows.groupBy("shard", "bucket").count()
    first = counts.select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    # one row of 24 bytes a bucket: under 50 MB up to 40 billion documents, beyond that the join shuffles
    first = F.broadcast(first) if buckets * len(weights) <= 2_000_000 else first
    return rows.withColumn("at", within).join(first, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), [1.0] * 24)
