"""Registered queries over points, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import intervals, models, series
from tidemark.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

A, B = 1_704_844_800_000_000, 1_705_708_800_000_000  # 2024-01-10 and 2024-01-20
HOUR, DAY = 3_600_000_000, 86_400_000_000
POINTS = "p AS (SELECT event_type AS series, epoch_us(ts) AS t, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v, event_id AS seq FROM events)"
FIRSTS = "d AS (SELECT t, arg_min(v, seq) AS v, min(seq) AS seq FROM p GROUP BY t)"
SQL_AGG = {
    "sum": "round(sum(v), 4)",
    "avg": "round(avg(v), 6)",
    "min": "min(v)",
    "max": "max(v)",
    "count": "CAST(count(*) AS DOUBLE)",
    "first": "arg_min(v, t)",
    "last": "arg_max(v, t)",
    "stddev": "round(stddev_pop(v), 6)",
    "variance": "round(var_pop(v), 4)",
}
DIGITS = {"sum": 4, "avg": 6, "stddev": 6, "variance": 4}


def _query(spark: SparkSession, d: str) -> series.SeriesQuery:
    return series.SeriesQuery(tables.points_from_events(spark, d))


def _rounded(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("value", F.round("value", DIGITS[name])) if name in DIGITS else df


def _tv(df: DataFrame) -> DataFrame:
    return df.select("t", F.col("v").cast("double").alias("v"))


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _scans() -> None:
    def add(name: str, build, where: str, tail: str = "") -> None:
        _add(name, lambda s, d: _tv(build(_query(s, d)).execute()), f"WITH {POINTS}, {FIRSTS} SELECT t, v FROM d WHERE {where} ORDER BY t, seq{tail}")

    add("range_scan", lambda q: q.range(A, B), f"t BETWEEN {A} AND {B}")
    add("scan_from", lambda q: q.from_(B), f"t >= {B}")
    add("scan_to", lambda q: q.to(A), f"t <= {A}")
    add("scan_unbounded", lambda q: q, "true")
    add("scan_inverted", lambda q: q.range(B, A), "false")
    add("scan_limit", lambda q: q.range(A, B).limit(100), f"t BETWEEN {A} AND {B}", " LIMIT 100")
    add("scan_offset", lambda q: q.range(A, B).offset(50), f"t BETWEEN {A} AND {B}", " OFFSET 50")
    add("scan_limit_offset", lambda q: q.range(A, B).offset(50).limit(100), f"t BETWEEN {A} AND {B}", " LIMIT 100 OFFSET 50")
    add("scan_offset_beyond", lambda q: q.range(A, B).offset(1_000_000_000), f"t BETWEEN {A} AND {B}", " OFFSET 1000000000")

    def dedup(keep: str) -> Query:
        def run(s: SparkSession, d: str) -> DataFrame:
            p = tables.points_from_lineitem(s, d)
            return series.deduplicated(p, keep, by=("series",)).select("series", "t", F.col("v").cast("double").alias("v"))

        return run

    order = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
    for keep, way in (("first", "ASC"), ("last", "DESC")):
        each = ", ".join(f"{c} {way}" for c in order.split(", "))
        _add(f"scan_dedup_{keep}", dedup(keep), f"SELECT series, t, v FROM (SELECT l_returnflag AS series, epoch_us(l_shipdate) AS t, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS v, row_number() OVER (PARTITION BY l_returnflag, l_shipdate ORDER BY {each}) AS n FROM lineitem) WHERE n = 1")

    def get(s: SparkSession, d: str) -> DataFrame:
        p = tables.points_from_events(s, d)
        t = p.where(F.col("t") >= A).agg(F.min("t")).first()[0]
        return series.point_get(p, t).select(F.col("v").cast("double").alias("v"))

    _add("point_get", get, f"WITH {POINTS} SELECT arg_min(v, seq) AS v FROM p WHERE t = (SELECT min(t) FROM p WHERE t >= {A})")
    _add("point_get_missing", lambda s, d: series.point_get(tables.points_from_events(s, d), -1).select(F.col("v").cast("double").alias("v")), "SELECT CAST(1 AS DOUBLE) AS v WHERE false")


def _aggregates() -> None:
    for name, sql in SQL_AGG.items():
        _add(f"agg_{name}", lambda s, d, n=name: _rounded(_query(s, d).range(A, B).aggregate(n).execute(), n), f"WITH {POINTS}, {FIRSTS} SELECT {sql} AS value FROM d WHERE t BETWEEN {A} AND {B}")
        empty = {"min": "CAST('inf' AS DOUBLE)", "max": "CAST('-inf' AS DOUBLE)"}.get(name, "CAST(0 AS DOUBLE)")
        _add(f"agg_{name}_empty", lambda s, d, n=name: _query(s, d).range(B, A).aggregate(n).execute(), f"SELECT {empty} AS value")
        _add(
            f"downsample_{name}",
            lambda s, d, n=name: _rounded(_query(s, d).range(A, B).group_by(HOUR).aggregate(n).execute(), n),
            f"WITH {POINTS}, {FIRSTS} SELECT (t // {HOUR}) * {HOUR} AS bucket, {sql} AS value FROM d WHERE t BETWEEN {A} AND {B} GROUP BY 1",
        )
        by = f"(t // {DAY}) * {DAY}"
        _add(
            f"downsample_by_series_{name}",
            lambda s, d, n=name: _rounded(series.downsampled(series.deduplicated(tables.points_from_events(s, d), by=("series",)), DAY, n, by=("series",)), n),
            f"WITH {POINTS}, e AS (SELECT series, t, arg_min(v, seq) AS v FROM p GROUP BY series, t) SELECT series, {by} AS bucket, {sql} AS value FROM e GROUP BY 1, 2",
        )
    _add("downsample_none_is_first", lambda s, d: _query(s, d).range(A, B).group_by(HOUR).execute(), SQL["downsample_first"])
    shift = A + 5 * DAY + 12_345

    def negative(s: SparkSession, d: str) -> DataFrame:
        p = tables.points_from_events(s, d).withColumn("t", F.col("t") - shift)
        return series.SeriesQuery(p).group_by(HOUR).aggregate("count").execute()

    _add("downsample_negative_ts", negative, f"WITH {POINTS}, {FIRSTS} SELECT ((t - {shift}) // {HOUR}) * {HOUR} AS bucket, CAST(count(*) AS DOUBLE) AS value FROM d GROUP BY 1")
    _add(
        "limit_then_agg",
        lambda s, d: _rounded(_query(s, d).from_(A).offset(50).limit(100).aggregate("sum").execute(), "sum"),
        f"WITH {POINTS}, {FIRSTS} SELECT round(sum(v), 4) AS value FROM (SELECT v FROM d WHERE t >= {A} ORDER BY t, seq LIMIT 100 OFFSET 50)",
    )
    _add(
        "limit_then_downsample",
        lambda s, d: _rounded(_query(s, d).from_(A).offset(50).limit(500).group_by(HOUR).aggregate("avg").execute(), "avg"),
        f"WITH {POINTS}, {FIRSTS} SELECT (t // {HOUR}) * {HOUR} AS bucket, round(avg(v), 6) AS value FROM (SELECT t, v FROM d WHERE t >= {A} ORDER BY t, seq LIMIT 500 OFFSET 50) GROUP BY 1",
    )

    def large(s: SparkSession, d: str) -> DataFrame:
        out = series.downsampled(tables.points_from_lineitem(s, d), 30 * DAY, "sum", "count", "min", "max", by=("series",))
        return out.withColumn("sum", F.round("sum", 2))

    _add("downsample_lineitem", large, f"SELECT l_returnflag AS series, (epoch_us(l_shipdate) // {30 * DAY}) * {30 * DAY} AS bucket, round(sum(v), 2) AS sum, CAST(count(*) AS DOUBLE) AS count, min(v) AS min, max(v) AS max FROM (SELECT *, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS v FROM lineitem) GROUP BY 1, 2")

    def gaps(s: SparkSession, d: str) -> DataFrame:
        minute = 60_000_000
        b = _query(s, d).range(A, A + HOUR).group_by(minute).aggregate("count").execute()
        return series.filled(b, minute, A, A + HOUR)

    _add("downsample_filled", gaps, f"WITH {POINTS}, {FIRSTS}, b AS (SELECT (t // 60000000) * 60000000 AS bucket, CAST(count(*) AS DOUBLE) AS value FROM d WHERE t BETWEEN {A} AND {A + HOUR} GROUP BY 1) SELECT g.bucket, value FROM (SELECT {A} + 60000000 * i AS bucket FROM range(0, 61) r(i)) g LEFT JOIN b USING (bucket)")
    def all_gaps(s: SparkSession, d: str) -> DataFrame:
        """Every hour of the whole table; hours of a rare kind of event are often empty."""
        p = tables.points_from_events(s, d).where("series = 'error'")
        lo, hi = p.agg(F.min("t"), F.max("t")).first()
        b = series.SeriesQuery(p).group_by(HOUR // 4).aggregate("count").execute()
        return series.filled(b, HOUR // 4, lo, hi) if lo is not None else b

    _add("downsample_filled_all", all_gaps, f"WITH e AS (SELECT DISTINCT epoch_us(ts) AS t FROM events WHERE event_type = 'error'), b AS (SELECT (t // {HOUR // 4}) * {HOUR // 4} AS bucket, CAST(count(*) AS DOUBLE) AS value FROM e GROUP BY 1), x AS (SELECT min(bucket) AS lo, max(bucket) AS hi FROM b) SELECT g.bucket, value FROM (SELECT unnest(range(lo, hi + 1, {HOUR // 4})) AS bucket FROM x) g LEFT JOIN b USING (bucket)")
    _add("moving_mean", lambda s, d: series.moving(tables.points_from_events(s, d), DAY).select("seq", F.round("mean", 6).alias("mean")), f"WITH {POINTS} SELECT seq, round(avg(v) OVER (PARTITION BY series ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW), 6) AS mean FROM p")


def _lookups() -> None:
    seg = "s AS (SELECT event_id // 1000 AS segment_id, min(epoch_us(ts)) AS start_time, max(epoch_us(ts)) AS end_time, count(*) AS point_count, count(*) * 12 AS size, CAST((event_id // 1000) % 3 AS INT) AS level FROM events GROUP BY 1, 6)"
    cols = ["segment_id", "start_time", "end_time", "point_count"]
    _add("segment_overlap", lambda s, d: intervals.overlapping(tables.segments_from_events(s, d), A, B).select(*cols), f"WITH {seg} SELECT {', '.join(cols)} FROM s WHERE start_time <= {B} AND end_time >= {A}")
    _add("interval_stab", lambda s, d: intervals.stabbed(tables.segments_from_events(s, d), A).select(*cols), f"WITH {seg} SELECT {', '.join(cols)} FROM s WHERE start_time <= {A} AND end_time >= {A}")

    def join(s: SparkSession, d: str) -> DataFrame:
        e = tables.table(s, d, "events").groupBy("user_id").agg(F.min(tables.micros("ts")).alias("q_start"))
        q = e.withColumn("q_end", F.col("q_start") + DAY)
        return intervals.interval_join(tables.segments_from_events(s, d), q, DAY).select("segment_id", "user_id")

    _add("interval_join", join, f"WITH {seg}, q AS (SELECT user_id, min(epoch_us(ts)) AS a FROM events GROUP BY 1) SELECT segment_id, user_id FROM s JOIN q ON start_time <= a + {DAY} AND end_time >= a")

    def asof_user(s: SparkSession, d: str) -> DataFrame:
        e = tables.table(s, d, "events").select(F.col("user_id").alias("by"), tables.micros("ts").alias("t"), F.col("event_id").alias("seq"), F.col("value").cast("double").alias("value"), "event_type")
        facts = e.where("event_type = 'purchase'").groupBy("by", "t").agg(F.max_by("value", "seq").alias("value"))
        return intervals.as_of(e.where("event_type = 'signup'").select("by", "t", "seq"), facts, "by").select("seq", "value")

    _add("as_of_join", asof_user, "WITH f AS (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT event_id AS seq, f.value FROM (SELECT * FROM events WHERE event_type = 'signup') e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.ts >= f.ts")

    def by_arrival(s: SparkSession, d: str) -> DataFrame:
        c = models.cut(tables.points_from_events(s, d), 250)
        return c.groupBy("series", "segment_id").agg(F.min("t").alias("start_time"), F.max("t").alias("end_time"), F.count("*").alias("point_count"))

    _add("segment_cut", by_arrival, f"WITH {POINTS} SELECT series, segment_id, min(t) AS start_time, max(t) AS end_time, count(*) AS point_count FROM (SELECT *, (row_number() OVER (PARTITION BY series ORDER BY seq) - 1) // 250 AS segment_id FROM p) GROUP BY 1, 2")

    def smooth(s: SparkSession, d: str) -> DataFrame:
        """Running means of each series' day: smooth enough for models. Sums are of whole cents, so they do not depend on order."""
        from pyspark.sql import Window

        p = tables.points_from_events(s, d, cents=True)
        w = Window.partitionBy("series", F.expr(f"t div {DAY}")).orderBy("t", "seq").rowsBetween(-200, 0)
        return p.withColumn("v", (F.sum("cents").over(w) / (F.count("*").over(w) * 100.0)).cast("float")).drop("cents")

    _add("model_segments", lambda s, d: models.fitted(smooth(s, d), 500).select("series", "segment_id", "start_time", "end_time", "point_count", "model.kind", "model_size", F.round("compression_ratio", 4).alias("ratio")), None)
    exact = "c AS (SELECT event_type AS series, epoch_us(ts) AS t, event_id AS seq, CAST(round(value * 100) AS BIGINT) AS cents FROM events), m AS (SELECT *, CAST(CAST(sum(cents) OVER w AS BIGINT) / (count(*) OVER w * 100.0) AS FLOAT) AS v FROM c WINDOW w AS (PARTITION BY series, t // " + str(DAY) + " ORDER BY t, seq ROWS BETWEEN 200 PRECEDING AND CURRENT ROW)), g AS (SELECT *, (row_number() OVER (PARTITION BY series ORDER BY seq) - 1) // 500 AS segment_id FROM m), i AS (SELECT series, segment_id, CAST(v AS DOUBLE) AS v, row_number() OVER (PARTITION BY series, segment_id ORDER BY t, seq) - 1 AS i, min(t) OVER (PARTITION BY series, segment_id) AS a, max(t) OVER (PARTITION BY series, segment_id) AS b, count(*) OVER (PARTITION BY series, segment_id) AS n FROM g), r AS (SELECT series, segment_id, i, a + (i * (b - a)) // greatest(n - 1, 1) AS t, v FROM i)"

    def exactly(df: DataFrame) -> DataFrame:
        return df.select("series", "segment_id", "i", "t", F.col("v").cast("float").cast("double").alias("v"))

    _add("model_scan", lambda s, d: exactly(models.regenerated(models.fitted(smooth(s, d), 500, lossless=True))), f"WITH {exact} SELECT series, segment_id, i, t, v FROM r")
    _add("model_range", lambda s, d: exactly(models.read_range(models.fitted(smooth(s, d), 500, lossless=True), A, B)), f"WITH {exact} SELECT series, segment_id, i, t, v FROM r WHERE t BETWEEN {A} AND {B}")
    _add("model_totals", lambda s, d: models.totals(models.fitted(smooth(s, d), 500)), None)
    _add("segment_stats", lambda s, d: models.stats(models.fitted(smooth(s, d), 500)), None)
    _add("model_distribution", lambda s, d: models.fitted(tables.points_from_events(s, d), 500).groupBy("model.kind").count(), None)
    _add("model_value_at", lambda s, d: models.value_of(models.fitted(smooth(s, d), 500), A), None)


_scans()
_aggregates()
_lookups()
