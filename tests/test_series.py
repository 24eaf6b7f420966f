import math

import pytest

from tidemark.operators import series

POINTS = "series string, t long, v float, seq long"


def linear(spark, n=100):
    return spark.createDataFrame([("s", i, float(i), i) for i in range(n)], POINTS)


def test_scalars(spark):
    q = series.SeriesQuery(linear(spark)).range(0, 99)
    got = {n: q.aggregate(n).scalar() for n in series.AGGREGATES}
    assert got["sum"] == 4950 and got["avg"] == 49.5 and got["count"] == 100
    assert (got["min"], got["max"], got["first"], got["last"]) == (0, 99, 0, 99)
    assert math.isclose(got["stddev"] ** 2, got["variance"]) and math.isclose(got["variance"], 833.25)


def test_empty(spark):
    q = series.SeriesQuery(linear(spark, 1)).range(50, 60)
    assert [q.aggregate(n).scalar() for n in series.AGGREGATES] == [0, 0, math.inf, -math.inf, 0, 0, 0, 0, 0]
    assert q.group_by(10).aggregate("sum").execute().count() == 0


def test_nan_and_aliases(spark):
    p = spark.createDataFrame([("s", 1, 1.0, 1), ("s", 2, float("nan"), 2), ("s", 3, 5.0, 3)], POINTS)
    q = series.SeriesQuery(p)
    assert q.aggregate("MAX").scalar() == 5 and q.aggregate("min").scalar() == 1
    assert math.isnan(q.aggregate("Mean").scalar())
    with pytest.raises(ValueError):
        q.aggregate("median")
    with pytest.raises(ValueError):
        q.group_by(0)
    with pytest.raises(ValueError):
        q.scalar()


def test_limit_offset_before_aggregation(spark):
    q = series.SeriesQuery(linear(spark))
    assert q.offset(10).limit(5).aggregate("sum").scalar() == 10 + 11 + 12 + 13 + 14
    assert q.offset(100_000).execute().count() == 0 and q.limit(10).execute().count() == 10
    assert [tuple(r) for r in q.limit(20).group_by(15).aggregate("count").execute().collect()] == [(0, 15), (15, 5)]


def test_negative_times_share_bucket_zero(spark):
    p = spark.createDataFrame([("s", t, 1.0, t + 100) for t in (-11, -9, -1, 0, 9, 10)], POINTS)
    rows = series.SeriesQuery(p).group_by(10).aggregate("count").execute().collect()
    assert [tuple(r) for r in rows] == [(-10, 1), (0, 4), (10, 1)]


def test_dedup_and_get(spark):
    p = spark.createDataFrame([("s", 1, 7.0, 2), ("s", 1, 5.0, 1), ("s", 2, 9.0, 3)], POINTS)
    assert series.point_get(p, 1).first()[0] == 5 and series.point_get(p, 99).first() is None
    q = series.SeriesQuery(p)
    assert [r.v for r in q.execute().collect()] == [5, 9]
    assert [r.v for r in q.dedup("last").execute().collect()] == [7, 9]
    assert q.dedup(None).execute().count() == 3


def test_time_filter_reaches_the_scan(spark, tmp_path):
    linear(spark).write.parquet(str(tmp_path / "p"))
    df = series.scan(spark.read.parquet(str(tmp_path / "p")), 10, 20).select("t", "v")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t,10)" in plan and "LessThanOrEqual(t,20)" in plan and "seq" not in plan.split("ReadSchema")[1]


def test_filled_rounds_its_bounds(spark):
    b = series.SeriesQuery(linear(spark)).group_by(10).aggregate("count").execute().where("bucket != 40")
    got = {r.bucket: r.value for r in series.filled(b, 10, 33, 57).collect()}
    assert got == {30: 10, 40: None, 50: 10}
    assert [r.bucket for r in series.filled(b, 10, -15, 5).orderBy("bucket").collect()] == [-10, 0]


def test_moving_mean(spark):
    """Against the plain definition: shared times, both signs, gaps, nulls in time and value, values that no sum may be taken from."""
    rows = [(s, t, v, i) for i, (s, t, v) in enumerate(
        [("a", t, float(t % 7)) for t in range(-25, 40, 3)]
        + [("a", 5, None), ("a", 5, 2.5), ("a", 15, 1e30), ("b", 0, 1.0), ("b", 10, 2.0), ("b", 21, None), ("c", None, 1.0), ("c", None, 3.0), ("c", 4, 8.0), ("d", 2**60 - 1, 1.0), ("d", 2**60, 5.0), ("d", 2**60 + 10, 6.0)]
        + [("e", 0, math.inf), ("e", 11, 1.0), ("e", 12, 3.0)]
    )]
    p = spark.createDataFrame(rows, "series string, t long, v double, seq long")

    def plain(s, t):
        seen = [v for s2, t2, v, _ in rows if s2 == s and v is not None and (t2 is None if t is None else t2 is not None and t - 10 <= t2 <= t)]
        return math.fsum(seen) / len(seen) if seen else None

    got = {r.seq: r.mean for r in series.moving(p, 10).collect()}
    assert len(got) == len(rows)
    for s, t, _, i in rows:
        want = plain(s, t)
        assert got[i] == want or math.isclose(got[i], want, rel_tol=1e-12), (s, t)


def test_moving_mean_takes_no_frame_again(spark):
    """Frames only grow, so work does not grow with the points in a frame."""
    plan = series.moving(linear(spark), 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RangeFrame, unboundedpreceding$(), currentrow$())" in plan and "RangeFrame, -10" not in plan
