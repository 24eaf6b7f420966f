"""Roll-ups of metric events: name, ts (micros), value, distinct_id, seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import tables

QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def from_events(spark: SparkSession, folder: str) -> DataFrame:
    e = tables.table(spark, folder, "events")
    return e.select(F.col("event_type").alias("name"), tables.micros("ts").alias("ts"), "value", F.col("user_id").alias("distinct_id"), F.col("event_id").alias("seq"))


def counters(m: DataFrame) -> DataFrame:
    return m.groupBy("name").agg(F.count("*").cast("double").alias("value"))


def gauges(m: DataFrame) -> DataFrame:
    """The last value by arrival."""
    return m.groupBy("name").agg(F.max_by("value", "seq").alias("value"))


def cardinality(m: DataFrame, exact: bool = True) -> DataFrame:
    n = F.countDistinct("distinct_id") if exact else F.approx_count_distinct("distinct_id", 0.02)
    return m.groupBy("name").agg(n.cast("double").alias("value"))


def quantiles(m: DataFrame, exact: bool = True) -> DataFrame:
    """name, variant, value; sketches bound the memory of a name with very many observations."""
    each = [(F.percentile("value", q) if exact else F.percentile_approx("value", q, 10000)).alias(n) for n, q in QUANTILES.items()]
    return m.groupBy("name").agg(*each).unpivot("name", list(QUANTILES), "variant", "value").withColumn("value", F.round("value", 6))


def flushed(m: DataFrame) -> DataFrame:
    """All variants of every name in one pass: name, variant, value."""
    each = [F.percentile("value", q).alias(n) for n, q in QUANTILES.items()]
    wide = m.groupBy("name").agg(F.count("*").cast("double").alias("counter"), F.max_by("value", "seq").alias("gauge"), F.countDistinct("distinct_id").cast("double").alias("cardinality"), *each)
    return wide.unpivot("name", ["counter", "gauge", "cardinality", *QUANTILES], "variant", "value").withColumn("value", F.round("value", 6))


def windows(m: DataFrame, width: int) -> DataFrame:
    """Tumbling windows: name, window_start, counter, gauge, total."""
    start = F.expr(f"(ts div {width}L) * {width}L").alias("window_start")
    return m.groupBy("name", start).agg(F.count("*").alias("counter"), F.max_by("value", "seq").alias("gauge"), F.round(F.sum("value"), 4).alias("total"))
