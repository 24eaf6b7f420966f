import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators import compaction, intervals, keyvalue, models, versions
from tidemark.plans import stores


def log(spark, rows):
    return spark.createDataFrame(rows, "k binary, kind int, payload binary, seq long")


def test_newest_wins_and_tombstones(spark):
    rows = [(f"{i}".encode(), 0, b"first", i) for i in range(50)] + [(f"{i}".encode(), 0, b"second", 100 + i) for i in range(50)]
    rows += [(f"{i}".encode(), 2, None, 200 + i) for i in range(0, 50, 2)] + [(b"4", 0, b"again", 300)]
    got = {bytes(r.k): bytes(r.payload) for r in keyvalue.live(log(spark, rows)).collect()}
    assert len(got) == 26 and got[b"1"] == b"second" and got[b"4"] == b"again" and b"2" not in got


def test_prefix(spark):
    l = log(spark, [(k, 0, b"v", i) for i, k in enumerate([b"foo:001", b"bar:001", b"foo:002", b"\xff\xff", b"\xff"])])
    assert [bytes(r.k) for r in keyvalue.prefix_scan(l, b"foo:").collect()] == [b"foo:001", b"foo:002"]
    assert [bytes(r.k) for r in keyvalue.prefix_scan(l, b"\xff").collect()] == [b"\xff", b"\xff\xff"]
    assert keyvalue.prefix_scan(l).count() == 5 and keyvalue.successor(b"a\xff") == b"b"


def test_compression_round_trip(spark):
    values = [b"", b"short", b"many words " * 50, bytes(range(256))]
    df = spark.createDataFrame([(bytes([i]), v, i) for i, v in enumerate(values)], "k binary, v binary, seq long")
    put = keyvalue.puts(df)
    assert [r.kind for r in put.orderBy("seq").collect()] == [0, 0, 1, 0]
    assert [bytes(r.v) for r in put.orderBy("seq").select(keyvalue.decoded("kind", "payload").alias("v")).collect()] == values


def test_intervals(spark):
    s = spark.createDataFrame([(0, 100, 1), (50, 150, 2), (200, 300, 3), (250, 350, 4)], "start_time long, end_time long, id long")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(intervals.stabbed(s, 75)) == [1, 2] and ids(intervals.overlapping(s, 250, 280)) == [3, 4] and ids(intervals.overlapping(s, 160, 190)) == []
    q = spark.createDataFrame([(75, 75), (140, 260), (400, 500)], "q_start long, q_end long")
    for width in (7, 64, 10_000):
        got = sorted((r.id, r.q_start) for r in intervals.interval_join(s, q, width).collect())
        assert got == [(1, 75), (2, 75), (2, 140), (3, 140), (4, 140)]


def test_as_of(spark):
    facts = spark.createDataFrame([("a", 1, 10), ("a", 5, 50), ("b", 2, 20)], "by string, t long, value int")
    probes = spark.createDataFrame([("a", 0), ("a", 1), ("a", 9), ("b", 3), ("c", 3)], "by string, t long")
    got = {(r["by"], r.t): r.value for r in intervals.as_of(probes, facts, "by").collect()}
    assert got == {("a", 0): None, ("a", 1): 10, ("a", 9): 50, ("b", 3): 20, ("c", 3): None}


def test_plans(spark):
    def seg(*rows):
        return spark.createDataFrame(rows, "segment_id long, size long, level int")

    l0 = seg(*[(i, 1000, 0) for i in range(4)])
    assert sorted(tuple(r) for r in compaction.leveled(l0).collect()) == [(i, 0, 1) for i in range(4)]
    assert compaction.leveled(seg((1, 1000, 0))).count() == 0
    assert compaction.tiered(seg((1, 1, 0), (2, 1, 0), (3, 1, 0)), 3).count() == 3
    tiers = {r.segment_id: r.tier for r in compaction.size_tiered(seg((1, 1000, 0), (2, 1100, 0), (3, 1200, 0), (4, 9000, 0))).collect()}
    assert tiers == {1: 0, 2: 0, 3: 0, 4: 1}
    assert compaction.score(l0).first()[0] == 1.0


def test_transactions(spark):
    v = spark.createDataFrame([("x", 1, 10.0, 1, 1), ("x", 3, 20.0, 9, 2), ("x", 7, 5.0, None, 3)], "key string, txn_id long, value double, commit_ts long, seq long")
    assert versions.snapshot(v, 5).first().value == 10 and versions.snapshot(v, 5, me=7).first().value == 5 and versions.snapshot(v, 9).first().value == 20
    assert sorted(r.txn_id for r in versions.collected(v, 9).collect()) == [3, 7]
    t = spark.createDataFrame([(1, "committed", 0), (3, "committed", 0), (7, "active", 5)], "txn_id long, status string, start_ts long")
    w = spark.createDataFrame([("x", 8), ("y", 8), ("x", 7)], "key string, txn_id long")
    assert [tuple(r) for r in versions.write_conflicts(v, t, w).collect()] == [("x", 8, 7)]
    assert [tuple(r) for r in versions.lost_updates(v, t).collect()] == [("x", 3)]


def test_deadlock(spark):
    """Cycles alone: not who waits behind one, between two, or in a long chain."""
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (3, 7), (7, 8), (8, 9), (9, 8), (9, 10), (11, 11)], "waiter long, holder long")
    assert sorted(r.txn_id for r in versions.deadlocked(e).collect()) == [1, 2, 3, 8, 9]
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "waiter long, holder long")
    assert versions.deadlocked(chain).count() == 0


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_deadlock_by_locks(spark, local):
    """Against all paths of the wait-for graph; transactions with many locks, and with one key held and waited for."""
    rng = random.Random(3)
    rows = [(f"k{k}", t, rng.random() < 0.5) for t in range(60) for k in rng.sample(range(60), rng.choice([2, 2, 2, 4]))]
    rows += [("own", 900, True), ("own", 900, False), ("two", 901, True), ("two", 901, False), ("two", 902, True), ("two", 902, False)]
    rows += [(k, 903, g) for k in ("m1", "m2") for g in (True, False)] + [(None, 904, True), (None, 905, False), ("k1", None, False)]
    held, edges = {(k, t) for k, t, g in rows if g and k and t is not None}, {}
    for k, t, g in rows:
        if not g and k and t is not None:
            edges.setdefault(t, set()).update(h for k2, h in held if k2 == k and h != t)

    def reach(t):
        seen, todo = set(), [t]
        while todo:
            new = edges.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return seen

    want = sorted(t for t in edges if t in reach(t))
    locks = spark.createDataFrame(rows, "key string, txn_id long, granted boolean")
    assert 901 in want and 900 not in want and len(want) > 5
    assert sorted(r.txn_id for r in versions.deadlocked_locks(locks, local).collect()) == want
    assert sorted(r.txn_id for r in versions.deadlocked(versions.waits(locks), local).collect()) == want
    assert versions.deadlocked_locks(locks.where("false"), local).count() == 0


def test_deadlock_makes_no_pairs(spark, monkeypatch):
    """A key with 300 waiters and 300 holders gives no more edges than locks."""
    seen, kept = [], versions._kept
    monkeypatch.setattr(versions, "_kept", lambda *a: seen.append(kept(*a)) or seen[-1])
    rows = [("hot", t, t < 300) for t in range(600)] + [(f"back{t}", t, t >= 300) for t in range(600)] + [("back0", 300, True), ("back5", 301, True)]
    locks = spark.createDataFrame(rows, "key string, txn_id long, granted boolean")
    assert sorted(r.txn_id for r in versions.deadlocked_locks(locks).collect()) == [0, 5, 300, 301]
    assert max(n for _, n in seen) <= len(rows)


def test_commit_and_abort(spark):
    v = spark.createDataFrame([("x", 1, 10.0, None, 1), ("y", 1, 11.0, None, 2), ("x", 2, 20.0, None, 3), ("z", 3, 5.0, 4, 4)], "key string, txn_id long, value double, commit_ts long, seq long")
    t = versions.begun(spark.createDataFrame([(3, "committed", 0)], "txn_id long, status string, start_ts long"), spark.createDataFrame([(1, 5), (2, 6), (3, 7), (4, 8)], "txn_id long, start_ts long"))
    assert sorted((r.txn_id, r.status, r.start_ts) for r in t.collect()) == [(1, "active", 5), (2, "active", 6), (3, "committed", 0), (4, "active", 8)]
    v2, t2 = versions.settled(v, t, spark.createDataFrame([(1, 9), (2, None), (3, None)], "txn_id long, commit_ts long"))
    assert sorted((r.key, r.txn_id, r.commit_ts) for r in v2.collect()) == [("x", 1, 9), ("y", 1, 9), ("z", 3, 4)]
    assert {r.txn_id: r.status for r in t2.collect()} == {1: "committed", 2: "aborted", 3: "committed", 4: "active"}
    assert versions.snapshot(v2, 9).count() == 3 and versions.snapshot(v2, 8).count() == 1


def test_log_replay(spark):
    whole = log(spark, [(b"a", 0, b"1", 1), (b"b", 0, b"2", 2), (b"a", 2, None, 3), (b"c", 0, b"3", 4)])
    frames = keyvalue.framed(whole)
    live = lambda f: {bytes(r.k) for r in keyvalue.live(keyvalue.intact(f)).collect()}
    assert live(frames) == {b"b", b"c"}
    assert live(frames.withColumn("payload", F.when(F.col("seq") == 3, F.lit(b"x")).otherwise(F.col("payload")))) == {b"a", b"b"}
    assert live(frames.withColumn("crc", F.when(F.col("seq") < 4, F.col("crc")))) == {b"b"} and live(frames.where("false")) == set()


def test_bloom(spark):
    put = spark.range(0, 2000).select(F.concat(F.lit("k"), "id").alias("k"))
    bits, hashes = (int(x) for x in spark.range(1).select(*keys.bloom_size(F.lit(2000), 0.01)).first())
    f = keys.bloom_build(put, "k", bits, hashes)
    probes = spark.range(0, 6000).select(F.concat(F.lit("k"), "id").alias("k"))
    got = {r.k: r.maybe for r in keys.bloom_contains(probes, "k", f, bits, hashes).collect()}
    assert len(got) == 6000 and all(got[f"k{i}"] for i in range(2000)) and sum(got[f"k{i}"] for i in range(2000, 6000)) < 80


def test_long_intervals(spark):
    """Intervals of very different lengths meet once each, by brute force."""
    rng = random.Random(2)
    some = lambda n: [(a := rng.randrange(-5000, 5000), a + int(10 ** rng.uniform(0, 6)), i) for i in range(n)]
    l, r = some(60), some(50)
    got = intervals.interval_join(spark.createDataFrame(l, "start_time long, end_time long, id long"), spark.createDataFrame(r, "q_start long, q_end long, q long"), 10)
    want = sorted((i, j) for a, b, i in l for c, d, j in r if a <= d and b >= c)
    assert sorted((x.id, x.q) for x in got.collect()) == want


def test_replay_covers_the_committed_log(spark, tmp_path):
    """Entries far beyond index 1000 are applied, those past the majority's index are not."""
    at = [1, 1000, 4000, 5002, 9001]
    orders = [(k, f"{i}-P") for i, k in enumerate(at)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, k % 2, float(k)) for k in at], "l_orderkey long, l_partkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = stores.QUERIES["raft_log_replay_committed"](spark, str(tmp_path)).collect()
    assert {r.t: r.v for r in got} == {0: 4000.0, 1: 1.0}


def test_keys(spark):
    one = spark.range(1)
    code = lambda *p: one.select(keys.morton(*[F.lit(x) for x in p])).first()[0]
    assert (code(10, 20, 30), code(0, 0, 0), code(255, 255, 255)) == (27560, 0, 16777215)
    cube = spark.range(0, 1 << 24, 9973).select(F.col("id").cast("int").alias("c"))
    assert cube.where(keys.morton(*keys.unmorton(F.col("c"))) != F.col("c")).count() == 0
    k = keys.metric_key(F.lit(1 << 19).cast("long"), F.lit(1000).cast("long"), F.lit(3))
    assert tuple(one.select(k < 0, *keys.metric_key_parts(k)).first()) == (True, 1 << 19, 1000, 3)
    assert one.select(keys.crc32(F.lit("123456789").cast("binary"))).first()[0] == 3421780262
    assert one.select(keys.xxh64(F.lit("").cast("binary"))).first()[0] & (2**64 - 1) == 0xEF46DB3751D8E999


def test_models(spark):
    import math

    shapes = {"constant": lambda i: 42.0, "linear": lambda i: 2.0 * i + 10, "sine": lambda i: math.sin(2 * math.pi * 0.01 * i), "noise": lambda i: math.sin(7.3 * i * i) * 1000}
    rows = [(n, i, f(i), i) for n, f in shapes.items() for i in range(1000)]
    p = spark.createDataFrame(rows, "series string, t long, v float, seq long")
    s = models.fitted(p, 1000).cache()
    got = {r.series: r for r in s.collect()}
    assert got["constant"].compression_ratio > 10 and got["linear"].compression_ratio > 10 and got["sine"].compression_ratio > 5
    assert got["noise"].model.kind == "raw" and got["linear"].model.kind == "linear"
    truth = {(a, b): c for a, b, c, _ in rows}
    for r in models.regenerated(s).collect():
        assert abs(r.v - truth[r.series, r.t]) < (0.25 if r.series == "sine" else 1e-2), r
    lossless = models.regenerated(models.fitted(p, 300, lossless=True)).collect()
    assert len(lossless) == 4000 and max(abs(r.v - truth[r.series, r.t]) for r in lossless) < 1e-2
    total = models.totals(s.where("series in ('constant', 'linear')")).first()
    assert total.n == 2000 and abs(total["sum"] - 1_051_000) < 1 and total["max"] == 2008
    assert models.stats(s).first().total_segments == 4
    at = {r.series: r.v for r in models.value_of(s, 500).collect()}
    assert abs(at["linear"] - 1010) < 1e-6 and at["constant"] == 42


def test_arrival_order_cut(spark):
    p = spark.createDataFrame([("s", t, float(t), i) for i, t in enumerate([50, 10, 30, 20, 40])], "series string, t long, v float, seq long")
    s = models.fitted(p, 1000).first()
    assert (s.start_time, s.end_time, s.point_count) == (10, 50, 5)
