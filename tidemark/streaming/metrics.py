"""Metric roll-ups as Structured Streaming queries.

``tumbling`` closes a window once the watermark passes it (persist and reset); ``cumulative`` keeps
totals since the start (persist). Both write through foreachBatch to a Parquet table, a folder per
batch, so that a batch repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """name, window_start, counter, total, gauge per window; events have name, ts (timestamp), value."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "name")
    out = w.agg(F.count("*").alias("counter"), F.sum("value").alias("total"), F.max_by("value", "ts").alias("gauge"), F.approx_count_distinct("distinct_id").alias("cardinality"))
    return out.select("name", F.col("window.start").alias("window_start"), "counter", "total", "gauge", "cardinality")


def cumulative(events: DataFrame) -> DataFrame:
    return events.groupBy("name").agg(F.count("*").alias("counter"), F.sum("value").alias("total"), F.max_by("value", "ts").alias("gauge"))


def persisted(rollup: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Start the query until all available input is done."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rollup.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
