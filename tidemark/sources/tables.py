"""The engine's relations, from tables of events, line items and orders.

points: series, t (long), v (float), seq (long) - one row per stored sample
blobs:  k, payload (binary), kind (0 raw, 1 compressed, 2 tombstone), seq - an append-only log
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW, COMPRESSED, TOMBSTONE = 0, 1, 2


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def points_from_events(spark: SparkSession, folder: str, cents: bool = False) -> DataFrame:
    """``cents`` adds the value in whole hundredths."""
    e = table(spark, folder, "events")
    more = [F.round(F.col("value") * 100).cast("long").alias("cents")] if cents else []
    return e.select(F.col("event_type").alias("series"), micros("ts").alias("t"), F.col("value").cast("float").alias("v"), F.col("event_id").alias("seq"), *more)


def points_from_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Many points share a time here; seq puts them in a fixed order."""
    li = table(spark, folder, "lineitem")
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(F.col("l_returnflag").alias("series"), micros("l_shipdate").alias("t"), F.col("l_extendedprice").cast("float").alias("v"), seq.alias("seq"))


def blobs_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """A put of props per event under the user's key; an error event is a delete."""
    e = table(spark, folder, "events")
    gone = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).cast("binary").alias("k"),
        F.when(gone, TOMBSTONE).otherwise(RAW).alias("kind"),
        F.when(~gone, F.col("props").cast("binary")).alias("payload"),
        F.col("event_id").alias("seq"),
    )


def segments_from_events(spark: SparkSession, folder: str, capacity: int = 1000) -> DataFrame:
    """Segment index rows: every ``capacity`` events in arrival order are one segment; levels go round."""
    e = table(spark, folder, "events").withColumn("segment_id", F.expr(f"event_id div {capacity}"))
    s = e.groupBy("segment_id").agg(F.min(micros("ts")).alias("start_time"), F.max(micros("ts")).alias("end_time"), F.count("*").alias("point_count"))
    return s.withColumn("size", F.col("point_count") * 12).withColumn("level", (F.col("segment_id") % 3).cast("int"))
