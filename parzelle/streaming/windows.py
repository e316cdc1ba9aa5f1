"""An extension: sums of an event stream in event-time windows. Late events count until the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_sums(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, key, n, total; for a stream or a table."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what there is and stops; a later call goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
