"""Scans, aggregates and downsampling of a series of points (t, v, seq).

Answers are exact: what was stored is what is read. Points of one time are ordered by seq.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALIASES = {"average": "avg", "mean": "avg", "std": "stddev", "var": "variance"}
AGGREGATES = ("sum", "avg", "min", "max", "count", "first", "last", "stddev", "variance")


def aggregate_name(name: str) -> str:
    """The plain name of an aggregate, whatever its case or alias; ValueError if there is none."""
    n = name.lower()
    n = ALIASES.get(n, n)
    if n not in AGGREGATES:
        raise ValueError(f"unknown aggregation {name!r}")
    return n


def aggregate(name: str, t: str = "t", v: str = "v", seq: str = "seq") -> Column:
    """The aggregate over the rows of a group, NULL for none. min and max skip NaN; stddev is of the population."""
    d, order = F.col(v).cast("double"), F.struct(t, seq)
    number = F.when(~F.isnan(d), d)
    return {
        "sum": F.sum(d),
        "avg": F.avg(d),
        "min": F.min(number),
        "max": F.max(number),
        "count": F.count("*").cast("double"),
        "first": F.min_by(d, order),
        "last": F.max_by(d, order),
        "stddev": F.stddev_pop(d),
        "variance": F.var_pop(d),
    }[aggregate_name(name)]


#: what an aggregate over no points gives
EMPTY = {"min": float("inf"), "max": float("-inf")}


def scan(points: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Points with start <= t <= end; either may be left open. An inverted range is empty."""
    if start is not None:
        points = points.where(F.col("t") >= start)
    if end is not None:
        points = points.where(F.col("t") <= end)
    return points


def deduplicated(points: DataFrame, keep: str = "first", by: tuple[str, ...] = ()) -> DataFrame:
    """One point per time: the first or last by seq. An aggregation, so it combines before the shuffle."""
    pick = {"first": F.min_by, "last": F.max_by}[keep]
    least = {"first": F.min, "last": F.max}[keep]
    return points.groupBy(*by, "t").agg(pick("v", "seq").alias("v"), least("seq").alias("seq"))


def point_get(points: DataFrame, t: int | Column) -> DataFrame:
    """The value stored at ``t``: no row if there is none."""
    return points.where(F.col("t") == t).agg(F.count("*").alias("__n"), F.min_by("v", "seq").alias("v")).where("__n > 0").select("v")


def bucket(interval: int, t: str = "t") -> Column:
    """Start of the bucket of ``t``; the division goes toward zero, so bucket 0 spans both signs."""
    if interval <= 0:
        raise ValueError("interval must be positive")
    return F.expr(f"({t} div {interval}L) * {interval}L")


def downsampled(points: DataFrame, interval: int, *names: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per bucket that has points: bucket and the aggregates (value, if there is one)."""
    out = [aggregate(n).alias("value" if len(names) == 1 else aggregate_name(n)) for n in names]
    return points.groupBy(*by, bucket(interval).alias("bucket")).agg(*out)


def filled(buckets: DataFrame, interval: int, start: int, end: int) -> DataFrame:
    """``buckets`` with a row of nulls for every bucket from that of start to that of end that has no points."""
    first, last = (abs(t) // interval * (interval if t >= 0 else -interval) for t in (start, end))
    spine = buckets.sparkSession.range(0, max(0, (last - first) // interval + 1)).select((F.col("id") * interval + first).alias("bucket"))
    return spine.join(buckets, "bucket", "left")


@dataclass(frozen=True)
class SeriesQuery:
    """A query built step by step. Offset and limit apply to points, before any aggregation."""

    points: DataFrame
    start: int | None = None
    end: int | None = None
    interval: int | None = None
    name: str | None = None
    skip: int | None = None
    most: int | None = None
    keep: str | None = "first"

    def range(self, start: int, end: int) -> SeriesQuery:
        return replace(self, start=start, end=end)

    def from_(self, start: int) -> SeriesQuery:
        return replace(self, start=start)

    def to(self, end: int) -> SeriesQuery:
        return replace(self, end=end)

    def group_by(self, interval: int) -> SeriesQuery:
        bucket(interval)
        return replace(self, interval=interval)

    def aggregate(self, name: str) -> SeriesQuery:
        return replace(self, name=aggregate_name(name))

    def limit(self, n: int) -> SeriesQuery:
        return replace(self, most=n)

    def offset(self, n: int) -> SeriesQuery:
        return replace(self, skip=n)

    def dedup(self, keep: str | None) -> SeriesQuery:
        return replace(self, keep=keep)

    def rows(self) -> DataFrame:
        """The points that the query is about."""
        p = scan(self.points, self.start, self.end)
        if self.keep:
            p = deduplicated(p, self.keep)
        if self.skip is not None or self.most is not None:
            p = p.orderBy("t", "seq")
            p = p.offset(self.skip) if self.skip else p
            p = p.limit(self.most) if self.most is not None else p
        return p

    def execute(self) -> DataFrame:
        """(t, v) by time, (bucket, value) by bucket, or one row (value)."""
        p = self.rows()
        if self.interval is not None:
            return downsampled(p, self.interval, self.name or "first").orderBy("bucket")
        if self.name is None:
            return p.select("t", "v").orderBy("t")
        return p.agg(F.coalesce(aggregate(self.name), F.lit(EMPTY.get(self.name, 0.0))).alias("value"))

    def scalar(self) -> float:
        if self.name is None or self.interval is not None:
            raise ValueError("a scalar needs an aggregation and no grouping")
        return self.execute().first()[0]


def moving(points: DataFrame, width: int, by: tuple[str, ...] = ("series",)) -> DataFrame:
    """Mean of the points of the last ``width`` time units, within each series.

    Time is cut into bins of ``width``, so the points looked back at are the last ones of the bin
    before and the first ones of the point's own. Both are running sums, one backward and one forward:
    a point costs the same however many it looks back at, and no sum is taken from another. So a series
    is spread over as many tasks as it has bins. Points without a time look back at each other.
    """
    bin_ = F.expr(f"(t - pmod(t, {width}L)) div {width}L")
    own = F.struct(bin_.alias("bin"), F.col("t").alias("at"), F.lit(True).alias("own"))
    halo = F.struct((bin_ + 1).alias("bin"), (F.col("t") + width).alias("at"), F.lit(False).alias("own"))
    both = points.withColumn("__p", F.explode(F.array(own, halo))).where("__p.own or t is not null")
    v = F.col("v").cast("double")
    w = Window.partitionBy(*by, "__p.bin")
    # rows of one time are all in
    upto = w.orderBy(F.asc("__p.at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    since = w.orderBy(F.desc("__p.at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    mine, before = F.when(F.col("__p.own"), v), F.when(~F.col("__p.own"), v)
    total = F.coalesce(F.sum(mine).over(upto), F.lit(0.0)) + F.coalesce(F.sum(before).over(since), F.lit(0.0))
    n = F.count(mine).over(upto) + F.count(before).over(since)
    out = both.withColumn("__sum", total).withColumn("__n", n).where("__p.own")
    return out.withColumn("mean", F.when(F.col("__n") > 0, F.col("__sum") / F.col("__n"))).drop("__p", "__sum", "__n")
