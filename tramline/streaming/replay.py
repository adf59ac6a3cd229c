"""Replay of real-time messages as a stream: tumbling hours of release time, late rows apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_messages(spark: SparkSession, path: str, schema) -> DataFrame:
    """Message files as a stream; the file source tracks which files were read."""
    return spark.readStream.schema(schema).parquet(path)


def hourly_batches(messages: DataFrame, kind: str = "event_type", ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """Messages per kind and release hour; the watermark is the system clock of the replay."""
    return messages.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.window(ts, "1 hour"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), kind, "n")


def replay(messages: DataFrame, sink, checkpoint: str) -> None:
    """Run all available input once through ``sink(batch, batch_id)``."""
    query = messages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
