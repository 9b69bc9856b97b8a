"""Chat messages as a stream, an addition of this engine: usage by session, and by window of time with late data dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def session_usage(messages: DataFrame) -> DataFrame:
    """Running numbers of messages and characters by session."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("n_chars"))


def windowed_events(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and window; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def run_once(frame: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Takes all that is there into a table in memory of the given name, and returns it; for small aggregates and tests."""
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)
