"""Append-only ingestion of new files; edits and deletions go through the batch plan (INC-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.indexing import window_chunks


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, size: int = 512, overlap: int = 100) -> StreamingQuery:
    files = spark.readStream.format("binaryFile").schema(spark.read.format("binaryFile").load(folder).schema).load(folder)

    def write(batch: DataFrame, epoch: int) -> None:
        docs = batch.select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))
        window_chunks(docs, size, overlap).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
