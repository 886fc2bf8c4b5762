"""Incremental ingest of new documents as a stream: an extension, since the reference has no streams.

Each micro-batch keeps the documents whose content isn't stored yet, the first of equal ones, and appends them; a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_documents(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """doc_id, text, hash of a batch's documents that stored(hash) doesn't hold, one for each content."""
    one = batch.withColumn("hash", F.sha2("text", 256)).groupBy("hash").agg(F.min(F.struct("doc_id", "text")).alias("d")).select("d.doc_id", "d.text", "hash")
    return one if stored is None else one.join(stored.select("hash"), "hash", "left_anti")


def ingest(source: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of (doc_id, text) to the Parquet folder target; ends when the source is drained."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        fresh = new_documents(batch, spark.read.parquet(target) if there else None).withColumn("epoch", F.lit(epoch))
        fresh.write.mode("append").parquet(target)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and hour, closed once no event of the hour can still come."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
