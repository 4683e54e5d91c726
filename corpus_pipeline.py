"""Corpus pipeline: five stages over documents, each written and read again by the next.

Rows are told apart by what they hold, not by an id alone: decontamination decides by text, so rows
without a doc_id keep their own fates. Near duplicates and the mix go by doc_id: rows of one id share
their decision there, and rows without one are no duplicates and are drawn as one by the mix.
Repeated rows share their decisions; an empty table passes through every stage; other columns are
left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import op4_language, op6_simhash, op7_shards, op9_mix, op10_decon
from quarry.llm.common import shared_dir, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_id(docs: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    return docs.join(chosen.withColumnRenamed("doc_id", "_k"), F.col("doc_id").eqNullSafe(F.col("_k")), how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return op4_language.predict(docs, op4_language.train(op4_language.sample(docs))).where(~F.col("rejected")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    gone = op6_simhash.similar_documents(docs).where("doc_id > component_id").select("doc_id").distinct()
    return by_id(docs, gone, "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hashed = docs.select(*COLUMNS).withColumn("_h", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = op10_decon.contaminated(hashed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "_h")
    bad = op10_decon.small(stored(found.where("n_hit > 0").select("key").distinct(), "pipeline-bad"))
    return hashed.join(bad, F.col("_h") == F.col("key"), "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    times = op9_mix.mix(docs).groupBy("doc_id").agg(F.max("times").alias("times")).where("times > 0")
    return by_id(docs, times, "inner").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_shards.shard(docs, [1.0] * 24)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shards", shards)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
