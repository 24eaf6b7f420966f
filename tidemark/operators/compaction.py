"""Compaction plans as queries over the segment index (segment_id, size, level)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The plans' defaults.
LEVELS, RATIO, L0_TRIGGER, LEVEL_BYTES, MIN_MERGE, SPREAD = 7, 10, 4, 64 << 20, 4, 0.5


def level_sizes(segments: DataFrame) -> DataFrame:
    """level, files, bytes; levels above the last count as the last."""
    level = F.least("level", F.lit(LEVELS - 1)).alias("level")
    return segments.groupBy(level).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def leveled(segments: DataFrame, trigger: int = L0_TRIGGER, level_bytes: int = LEVEL_BYTES, ratio: int = RATIO) -> DataFrame:
    """Segments to merge: all of level 0 if it has ``trigger``, else the largest of the first level over its size.

    segment_id, from_level, to_level.
    """
    s = level_sizes(segments).withColumn("limit", F.lit(level_bytes) * F.pow(F.lit(float(ratio)), F.col("level")))
    due = s.where(f"(level = 0 and files >= {trigger}) or (level between 1 and {LEVELS - 2} and bytes > limit)")
    first = due.agg(F.min("level").alias("from_level")).where("from_level is not null")
    inside = segments.join(F.broadcast(first), F.least("level", F.lit(LEVELS - 1)) == F.col("from_level"))  # one row
    largest = inside.agg(F.max_by("segment_id", F.struct("size", -F.col("segment_id"))).alias("one"))
    chosen = inside.join(F.broadcast(largest), (F.col("from_level") == 0) | (F.col("segment_id") == F.col("one")))
    return chosen.select("segment_id", "from_level", (F.col("from_level") + 1).alias("to_level"))


def tiered(segments: DataFrame, min_merge: int = MIN_MERGE) -> DataFrame:
    """All segments of the first level that has ``min_merge`` of them go to the next."""
    first = level_sizes(segments).where(F.col("files") >= min_merge).agg(F.min("level").alias("from_level")).where("from_level is not null")
    inside = segments.join(F.broadcast(first), F.least("level", F.lit(LEVELS - 1)) == F.col("from_level"))
    return inside.select("segment_id", "from_level", F.least(F.col("from_level") + 1, F.lit(LEVELS - 1)).alias("to_level"))


def size_tiered(segments: DataFrame, spread: float = SPREAD) -> DataFrame:
    """segment_id, level, tier: by rising size, a segment joins the open tier if it is within ``spread`` of its mean.

    The mean is an integer. Segments of one size always share a tier, so the walk is a fold over a
    level's different sizes with their numbers, which are few however many segments there are.
    """
    def step(acc, x):
        mean = (acc["total"] / acc["n"]).cast("long")
        joins = (acc["n"] > 0) & (F.abs(x["size"] - mean) / F.greatest(mean, F.lit(1)) <= spread)
        tier = F.when(joins | (acc["n"] == 0), acc["tier"]).otherwise(acc["tier"] + 1)
        row = F.struct(x["size"].alias("size"), tier.alias("tier"))
        return F.struct(
            tier.alias("tier"),
            (x["count"] + F.when(joins, acc["n"]).otherwise(0)).alias("n"),
            (x["count"] * x["size"] + F.when(joins, acc["total"]).otherwise(0)).alias("total"),
            F.array_append(acc["out"], row).alias("out"),
        )

    start = F.struct(F.lit(0).alias("tier"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<size:bigint,tier:int>>").alias("out"))
    sizes = segments.groupBy("level", F.col("size").cast("long").alias("size")).count()
    rows = sizes.groupBy("level").agg(F.array_sort(F.collect_list(F.struct("size", "count"))).alias("s"))
    walked = rows.select("level", F.explode(F.aggregate("s", start, step, lambda a: a["out"])).alias("x")).select("level", "x.size", "x.tier")
    return segments.join(walked, ["level", "size"]).select("segment_id", "level", "tier")


def score(segments: DataFrame, trigger: int = L0_TRIGGER, level_bytes: int = LEVEL_BYTES, ratio: int = RATIO) -> DataFrame:
    """How much the index needs a leveled compaction: the largest share of a level's limit."""
    s = level_sizes(segments)
    part = F.when(F.col("level") == 0, F.col("files") / trigger).otherwise(F.col("bytes") / (level_bytes * F.pow(F.lit(float(ratio)), F.col("level"))))
    return s.agg(F.coalesce(F.max(part), F.lit(0.0)).alias("score"))

