"""Lookups and joins of closed intervals [start_time, end_time]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(segments: DataFrame, start: int, end: int) -> DataFrame:
    """Segments that share a time with [start, end]; both conditions reach the scan."""
    return segments.where((F.col("start_time") <= end) & (F.col("end_time") >= start))


def stabbed(segments: DataFrame, t: int) -> DataFrame:
    return overlapping(segments, t, t)


def interval_join(left: DataFrame, right: DataFrame, width: int, factor: int = 8) -> DataFrame:
    """Pairs of overlapping intervals of left (start_time, end_time) and right (q_start, q_end).

    An interval belongs to the first level whose pieces (``width`` times a power of ``factor``)
    are as long as itself, so it lies in two of them at most, however long it is. It is also
    listed in the pieces of the levels above it that occur. A pair meets in a piece of the higher of
    its two levels and is kept in the first that both have, so none comes twice and no side must
    be broadcast.
    """
    def level(a: str, b: str) -> F.Column:
        return F.greatest(F.lit(0), F.ceil(F.log(float(factor), F.greatest(F.col(b) - F.col(a), F.lit(1)) / width))).cast("int")

    def listed(df: DataFrame, a: str, b: str, own: str, top: int) -> DataFrame:
        size = width * F.pow(F.lit(float(factor)), F.col("__level")).cast("long")
        rows = df.withColumn("__level", F.explode(F.sequence(F.col(own), F.lit(top))))
        return rows.withColumn("__piece", F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))))

    l = left.where("start_time <= end_time").withColumn("__l", level("start_time", "end_time"))
    r = right.where("q_start <= q_end").withColumn("__r", level("q_start", "q_end"))
    tops = l.agg(F.max("__l").alias("n")).unionByName(r.agg(F.max("__r").alias("n")))  # two numbers
    top = max((x["n"] or 0 for x in tops.collect()), default=0)
    both = listed(l, "start_time", "end_time", "__l", top).join(listed(r, "q_start", "q_end", "__r", top), ["__level", "__piece"])
    size = width * F.pow(F.lit(float(factor)), F.col("__level")).cast("long")
    meet = (F.col("start_time") <= F.col("q_end")) & (F.col("end_time") >= F.col("q_start"))
    first = F.col("__piece") == F.floor(F.greatest("start_time", "q_start") / size)
    return both.where(meet & first & (F.col("__level") == F.greatest("__l", "__r"))).drop("__piece", "__level", "__l", "__r")


def as_of(probes: DataFrame, facts: DataFrame, by: str, at: str = "t") -> DataFrame:
    """For each probe (by, at) the newest fact (by, at, value) not after it: one union, one window, no range join."""
    p = probes.select(by, at, F.struct(*probes.columns).alias("__probe"), F.lit(None).cast(facts.schema["value"].dataType).alias("value"), F.lit(1).alias("__last"))
    f = facts.select(by, at, F.lit(None).cast(p.schema["__probe"].dataType).alias("__probe"), "value", F.lit(0).alias("__last"))
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(at, "__last").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(f).withColumn("__value", F.last("value", ignorenulls=True).over(w))
    return both.where("__last = 1").select("__probe.*", F.col("__value").alias("value"))
