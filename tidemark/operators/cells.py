"""Values of space cells: keyframes and deltas under a packed key of Morton code and version.

A store is a DataFrame of t (the cell key), v and seq, as the points of a series are; of several
values under one key the first stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import keys

KEYFRAMES, DELTAS = "keyframes", "deltas"


def stored(cells: DataFrame, version: Column, kind: str = KEYFRAMES) -> DataFrame:
    """Points of series ``kind`` from rows of code, v and seq."""
    return cells.select(F.lit(kind).alias("series"), keys.cell_key(F.col("code"), version).alias("t"), F.col("v").cast("float").alias("v"), "seq")


def values(points: DataFrame) -> DataFrame:
    """code, version, v: one value for each key."""
    first = points.groupBy("t").agg(F.min_by("v", "seq").alias("v"))
    return first.select(F.shiftright("t", 16).cast("int").alias("code"), F.col("t").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("version"), "v")


def region(points: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Values of the cells of a box. The key range of its corners goes to the scan, the box itself is exact."""
    ends = [sum((p[k] >> j & 1) << (3 * j + k) for j in range(8) for k in range(3)) for p in (low, high)]
    ranged = points.where(F.col("t").between(ends[0] << 16, (ends[1] << 16) + 0xFFFF))
    return values(ranged).where(keys.in_box(F.col("code"), low, high))


def current(points: DataFrame) -> DataFrame:
    """Each cell's newest keyframe (base) and the sum of the deltas of later versions (added)."""
    frames = values(points.where(F.col("series") == KEYFRAMES)).groupBy("code").agg(F.max("version").alias("version"), F.max_by("v", "version").alias("base"))
    later = values(points.where(F.col("series") == DELTAS)).withColumnRenamed("version", "at")
    added = F.sum(F.when(F.col("at") > F.col("version"), F.col("v").cast("double")))
    return frames.join(later, "code", "left").groupBy("code", "version", "base").agg(F.coalesce(added, F.lit(0.0)).alias("added"))
