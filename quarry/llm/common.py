"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
HOT, HOT_KEYS, BATCH = 10_000, 100_000, 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of this machine only where none is named and no other machine takes part."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = "file:///tmp/quarry-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Python workers get BATCH rows at a time: ten times as many texts, beside what is made of them, take hundreds of MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors.

    What comes after reads the table, so the shuffle files behind it go when it is written."""
    spark, tidy = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(tidy)
    spark.conf.set(tidy, "true")
    df.write.parquet(path)
    spark.conf.set(tidy, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._quarry_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_of(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))



def by_key(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows, about `total`, with a table of one row a key, whose column `rows` counts the rows of that key.

    The hot keys are sent to all executors: those of over HOT rows, and of over 1 / HOT_KEYS of all
    rows, so at most HOT_KEYS of them. Only the rows of other keys shuffle."""
    least = max(HOT, total // HOT_KEYS)
    if total <= HOT:
        return rows.join(table.drop("rows"), key)
    table = stored(table, "by-key")
    hot, cold = table.where(F.col("rows") > least).drop("rows"), table.where(F.col("rows") <= least).drop("rows")
    if hot.isEmpty():
        return rows.join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))
