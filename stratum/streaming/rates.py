"""Arrival rates from an event stream: tumbling counts with a watermark, and centers kept up to date by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def rates(events: DataFrame, key: str = "event_type", ts: str = "ts", width: str = "5 minutes", late: str | None = None) -> DataFrame:
    """(start, key, n): events by key and window; on a stream, rows later than `late` are dropped and state is freed."""
    if late is not None:
        # zone-less times cannot carry a watermark
        events = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return events.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def keep_up(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs update on each batch of what is there and ends; its sink decides how repeated batches are told apart."""
    return stream.writeStream.outputMode("append").foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
