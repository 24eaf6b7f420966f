"""Registered queries over the key-value log, metrics, cells, plans and transactions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import frames, keys, sealing
from tidemark.operators import cells as cell_store
from tidemark.operators import compaction, keyvalue, metrics, versions
from tidemark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


LOG = "l AS (SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS k, event_type = 'error' AS gone, props AS payload, event_id AS seq FROM events)"
LIVE = f"{LOG}, w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM l), live AS (SELECT k, payload, seq FROM w WHERE n = 1 AND NOT gone)"


def _text(df: DataFrame) -> DataFrame:
    return df.select(F.col("k").cast("string").alias("k"), F.col("payload").cast("string").alias("payload"), "seq")


def _blobs() -> None:
    log = tables.blobs_from_events
    _add("blob_upsert", lambda s, d: _text(log(s, d).groupBy("k").agg(F.max_by(F.struct("kind", "payload", "seq"), "seq").alias("e")).select("k", "e.payload", "e.seq")), f"WITH {LOG} SELECT k, CASE WHEN NOT gone THEN payload END AS payload, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM l) WHERE n = 1")
    _add("blob_live", lambda s, d: _text(keyvalue.live(log(s, d))), f"WITH {LIVE} SELECT k, payload, seq FROM live")
    _add("blob_scan_all", lambda s, d: _text(keyvalue.prefix_scan(log(s, d))), f"WITH {LIVE} SELECT k, payload, seq FROM live ORDER BY k")
    _add("blob_prefix_scan", lambda s, d: _text(keyvalue.prefix_scan(log(s, d), b"user:00004")), f"WITH {LIVE} SELECT k, payload, seq FROM live WHERE starts_with(k, 'user:00004') ORDER BY k")
    _add("blob_get", lambda s, d: _text(keyvalue.get(log(s, d), b"user:000042")), f"WITH {LIVE} SELECT k, payload, seq FROM live WHERE k = 'user:000042'")
    _add("blob_get_missing", lambda s, d: _text(keyvalue.get(log(s, d), b"nobody")), f"WITH {LIVE} SELECT k, payload, seq FROM live WHERE k = 'nobody'")
    _add("blob_len", lambda s, d: keyvalue.length(log(s, d)), f"WITH {LIVE} SELECT count(*) AS n FROM live")
    _add("blob_compact", lambda s, d: _text(keyvalue.compacted(log(s, d))), f"WITH {LIVE} SELECT k, payload, seq FROM live")

    def masked(s: SparkSession, d: str) -> DataFrame:
        all_ = log(s, d)
        return all_.select("k").distinct().join(keyvalue.live(all_), "k", "left_anti").select(F.col("k").cast("string").alias("k"))

    _add("blob_delete_masks", masked, f"WITH {LIVE} SELECT DISTINCT k FROM l WHERE k NOT IN (SELECT k FROM live)")

    def back(s: SparkSession, d: str) -> DataFrame:
        all_ = log(s, d)
        gone = all_.where(F.col("kind") == tables.TOMBSTONE).groupBy("k").agg(F.min("seq").alias("deleted"))
        return _text(keyvalue.live(all_).join(gone, "k").where("seq > deleted").select("k", "payload", "seq"))

    _add("blob_resurrect", back, f"WITH {LIVE} SELECT live.k, payload, live.seq FROM live JOIN (SELECT k, min(seq) AS deleted FROM l WHERE gone GROUP BY k) g ON live.k = g.k WHERE live.seq > deleted")

    def compressed(s: SparkSession, d: str) -> DataFrame:
        docs = tables.table(s, d, "documents").select(F.col("doc_id").cast("string").cast("binary").alias("k"), F.encode("text", "utf-8").alias("v"), F.col("doc_id").alias("seq"))
        kept = keyvalue.live(keyvalue.puts(docs)).withColumn("v", keyvalue.decoded("kind", "payload"))
        return kept.select(F.col("seq").alias("doc_id"), F.sha2("v", 256).alias("sha"), F.octet_length("v").cast("long").alias("bytes"))

    _add("blob_round_trip", compressed, "SELECT doc_id, sha256(text) AS sha, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents")

    def sizes(s: SparkSession, d: str) -> DataFrame:
        n = tables.table(s, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n"))
        bits, hashes = keys.bloom_size(F.col("n"), 0.01)
        return n.select("event_type", bits.alias("bits"), hashes.alias("hashes"))

    _add("bloom_sizing", sizes, "SELECT event_type, CAST(ceil(-n * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits, CAST(ceil(ceil(-n * ln(0.01) / (ln(2) * ln(2))) / n * ln(2)) AS BIGINT) AS hashes FROM (SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1)")


    def bloom(s: SparkSession, d: str) -> DataFrame:
        """A filter over the users that bought, asked for every user."""
        k = log(s, d).select(F.col("k").cast("string").alias("k")).distinct()
        bought = tables.table(s, d, "events").where("event_type = 'purchase'").select(F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("k")).distinct()
        bits, hashes = (int(x) for x in bought.agg(*keys.bloom_size(F.count("*"), 0.01)).first())
        return keys.bloom_contains(k, "k", keys.bloom_build(bought, "k", bits, hashes), bits, hashes)

    at = "(('0x' || substr(md5(k), 1, 8))::BIGINT + i * (('0x' || substr(md5(k), 9, 8))::BIGINT | 1)) % bits"
    _add("bloom_contains", bloom, f"WITH {LOG}, u AS (SELECT DISTINCT k FROM l), b AS (SELECT DISTINCT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS k FROM events WHERE event_type = 'purchase'), z AS (SELECT count(*) AS n, CAST(ceil(-count(*) * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits FROM b), y AS (SELECT bits, CAST(ceil(bits / n * ln(2)) AS BIGINT) AS hashes FROM z), h AS (SELECT bits, unnest(range(hashes)) AS i FROM y), f AS (SELECT DISTINCT {at} AS pos FROM b, h), p AS (SELECT k, {at} AS pos FROM u, h) SELECT p.k, bool_and(f.pos IS NOT NULL) AS maybe FROM p LEFT JOIN f ON p.pos = f.pos GROUP BY p.k")

    def cut_off(s: SparkSession, d: str) -> DataFrame:
        """The log as written, with the record of nine tenths of the way damaged: what is before it lives."""
        frames = keyvalue.framed(log(s, d))
        far = frames.agg(F.expr("max(seq) * 9 div 10").alias("far"))
        damaged = frames.join(F.broadcast(far)).withColumn("crc", F.col("crc") + (F.col("seq") == F.col("far")).cast("long")).drop("far")  # one row
        return _text(keyvalue.live(keyvalue.intact(damaged)))

    _add("blob_log_replay", cut_off, f"WITH {LOG}, w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM l WHERE seq < (SELECT max(event_id) * 9 // 10 FROM events)) SELECT k, payload, seq FROM w WHERE n = 1 AND NOT gone")


def _metrics() -> None:
    def keyed(s: SparkSession, d: str) -> DataFrame:
        e = tables.table(s, d, "events")
        sec = F.floor(tables.micros("ts") / 1_000_000).cast("long")
        return e.select("event_id", keys.metric_key(F.col("user_id"), sec, F.lit(2)).alias("key"))

    key = "((user_id & 1048575) << 44) | (((epoch_us(ts) // 1000000) & 1099511627775) << 4) | 2"
    _add("metric_key_pack", keyed, f"SELECT event_id, {key} AS key FROM events")

    def unkeyed(s: SparkSession, d: str) -> DataFrame:
        h, t, v = keys.metric_key_parts(F.col("key"))
        return keyed(s, d).select("event_id", h.alias("h"), t.alias("ts"), v.alias("variant"))

    _add("metric_key_unpack", unkeyed, "SELECT event_id, user_id AS h, epoch_us(ts) // 1000000 AS ts, CAST(2 AS BIGINT) AS variant FROM events")
    src = metrics.from_events
    day = "epoch_us(ts) // 86400000000 * 86400000000"
    _add("metric_flush_counter", lambda s, d: metrics.counters(src(s, d)), "SELECT event_type AS name, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1")
    _add("metric_flush_gauge", lambda s, d: metrics.gauges(src(s, d)), "SELECT event_type AS name, arg_max(value, event_id) AS value FROM events GROUP BY 1")
    _add("metric_flush_cardinality", lambda s, d: metrics.cardinality(src(s, d)), "SELECT event_type AS name, CAST(count(DISTINCT user_id) AS DOUBLE) AS value FROM events GROUP BY 1")
    _add("metric_cardinality_sketch", lambda s, d: metrics.cardinality(src(s, d), exact=False), None)
    _add("metric_flush_quantiles", lambda s, d: metrics.quantiles(src(s, d)), "SELECT event_type AS name, 'p' || CAST(CAST(q * 100 AS INT) AS VARCHAR) AS variant, round(CASE q WHEN 0.5 THEN quantile_cont(value, 0.5) WHEN 0.9 THEN quantile_cont(value, 0.9) ELSE quantile_cont(value, 0.99) END, 6) AS value FROM events CROSS JOIN (VALUES (0.5), (0.9), (0.99)) t(q) GROUP BY event_type, q")
    _add("metric_quantiles_sketch", lambda s, d: metrics.quantiles(src(s, d), exact=False), None)
    _add("metric_tumbling", lambda s, d: metrics.windows(src(s, d), 86_400_000_000), f"SELECT event_type AS name, {day} AS window_start, count(*) AS counter, arg_max(value, event_id) AS gauge, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
    _add("metric_flush", lambda s, d: metrics.flushed(src(s, d)), "WITH m AS (SELECT event_type AS name, CAST(count(*) AS DOUBLE) AS counter, arg_max(value, event_id) AS gauge, CAST(count(DISTINCT user_id) AS DOUBLE) AS cardinality, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1) SELECT name, variant, round(value, 6) AS value FROM (UNPIVOT m ON counter, gauge, cardinality, p50, p90, p99 INTO NAME variant VALUE value)")


def _cells() -> None:
    xyz = [("x", "event_id % 256"), ("y", "event_id div 256 % 256"), ("z", "user_id % 256")]

    def cells(s: SparkSession, d: str) -> DataFrame:
        e = tables.table(s, d, "events").select("event_id", *[F.expr(f"cast({q} as int)").alias(n) for n, q in xyz], F.col("value").cast("float").alias("v"))
        return e.withColumn("code", keys.morton(F.col("x"), F.col("y"), F.col("z")))

    bits = " | ".join(f"((({c} >> {j}) & 1) << {3 * j + k})" for j in range(8) for k, c in enumerate("xyz"))
    sql = f"c AS (SELECT event_id, x, y, z, CAST({bits} AS INT) AS code, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v FROM (SELECT *, CAST(event_id % 256 AS INT) AS x, CAST(event_id // 256 % 256 AS INT) AS y, CAST(user_id % 256 AS INT) AS z FROM events))"
    _add("morton_encode", lambda s, d: cells(s, d).select("event_id", "code"), f"WITH {sql} SELECT event_id, code FROM c")

    def decode(s: SparkSession, d: str) -> DataFrame:
        x, y, z = keys.unmorton(F.col("code"))
        return cells(s, d).select("event_id", x.alias("x"), y.alias("y"), z.alias("z"))

    _add("morton_decode", decode, f"WITH {sql} SELECT event_id, x, y, z FROM c")
    _add("cell_key", lambda s, d: cells(s, d).select("event_id", keys.cell_key(F.col("code"), F.col("event_id")).alias("key")), f"WITH {sql} SELECT event_id, (CAST(code AS BIGINT) << 16) | (event_id & 65535) AS key FROM c")
    low, high = (10, 0, 0), (60, 40, 120)
    spread = lambda p: sum((p[k] >> j & 1) << (3 * j + k) for j in range(8) for k in range(3))
    _add("morton_range", lambda s, d: cells(s, d).where(F.col("code").between(spread(low), spread(high))).select("event_id", "code"), f"WITH {sql} SELECT event_id, code FROM c WHERE code BETWEEN {spread(low)} AND {spread(high)}")
    _add("morton_box", lambda s, d: cells(s, d).where(F.col("code").between(spread(low), spread(high)) & keys.in_box(F.col("code"), low, high)).select("event_id", "code"), f"WITH {sql} SELECT event_id, code FROM c WHERE x BETWEEN 10 AND 60 AND y BETWEEN 0 AND 40 AND z BETWEEN 0 AND 120")
    _add(
        "morton_from_world",
        lambda s, d: tables.table(s, d, "events").select("event_id", keys.morton(*[keys.world_byte(F.col("value") + i, 0.0, 512.0) for i in range(3)]).alias("code")),
        "WITH w AS (SELECT event_id, CAST(trunc(least(greatest(CAST(value AS FLOAT) / CAST(512 AS FLOAT), CAST(0 AS FLOAT)), CAST(1 AS FLOAT)) * CAST(255 AS FLOAT)) AS INT) AS x, CAST(trunc(least(greatest(CAST(value + 1 AS FLOAT) / CAST(512 AS FLOAT), CAST(0 AS FLOAT)), CAST(1 AS FLOAT)) * CAST(255 AS FLOAT)) AS INT) AS y, CAST(trunc(least(greatest(CAST(value + 2 AS FLOAT) / CAST(512 AS FLOAT), CAST(0 AS FLOAT)), CAST(1 AS FLOAT)) * CAST(255 AS FLOAT)) AS INT) AS z FROM events) SELECT event_id, CAST(" + bits + " AS INT) AS code FROM w",
    )
    _add("crc32", lambda s, d: tables.table(s, d, "events").select("event_id", keys.crc32(F.col("props").cast("binary")).alias("crc")), None)
    _add("xxh64_seed0", lambda s, d: tables.table(s, d, "events").select("event_id", keys.xxh64(F.col("props").cast("binary")).alias("hash")), None)
    _add("content_hash", lambda s, d: tables.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash")), "SELECT doc_id, sha256(text) AS hash FROM documents")

    def sealed(s: SparkSession, d: str) -> DataFrame:
        key = F.lit("0123456789abcdef")
        e = tables.table(s, d, "events").select("event_id", F.aes_encrypt("props", key).alias("box"))
        return e.select("event_id", F.aes_decrypt("box", key).cast("string").alias("props"))

    _add("sealed_round_trip", sealed, "SELECT event_id, props FROM events")

    def sealed_scan(s: SparkSession, d: str) -> DataFrame:
        """Points as an encrypted database stores them, opened again."""
        key = b"0123456789abcdef0123456789abcdef"
        return sealing.opened_points(sealing.sealed_points(tables.points_from_events(s, d), key), key)

    _add("sealed_points_scan", sealed_scan, "SELECT event_type AS series, epoch_us(ts) AS t, CAST(value AS FLOAT) AS v, event_id AS seq FROM events")

    def versioned(s: SparkSession, d: str, kind: str) -> DataFrame:
        """A keyframe or delta per event; the day of the year is the version."""
        e = cells(s, d).join(tables.table(s, d, "events").select("event_id", F.dayofyear("ts").alias("day")), "event_id")
        return cell_store.stored(e.withColumn("seq", F.col("event_id")).drop("event_id"), F.col("day"), kind)

    each = f"{sql}, e AS (SELECT c.*, CAST(date_part('doy', ts) AS INT) AS version FROM c JOIN events USING (event_id)), f AS (SELECT code, version, arg_min(v, event_id) AS v FROM e GROUP BY 1, 2)"
    _add("cell_keyframes", lambda s, d: cell_store.values(versioned(s, d, cell_store.KEYFRAMES)), f"WITH {each} SELECT code, version, CAST(v AS FLOAT) AS v FROM f")
    _add("cell_region", lambda s, d: cell_store.region(versioned(s, d, cell_store.KEYFRAMES), low, high), f"WITH {each}, b AS (SELECT DISTINCT code FROM c WHERE x BETWEEN 10 AND 60 AND y BETWEEN 0 AND 40 AND z BETWEEN 0 AND 120) SELECT code, version, CAST(v AS FLOAT) AS v FROM f SEMI JOIN b USING (code)")

    def mixed(s: SparkSession, d: str) -> DataFrame:
        """Sign-ups are keyframes and all other events deltas of the cell of a user: how far each cell has gone."""
        e = tables.table(s, d, "events")
        user = F.expr("cast(user_id % 4096 as int)").alias("code")
        rows = e.select(user, F.dayofyear("ts").alias("day"), F.col("value").alias("v"), F.col("event_id").alias("seq"), "event_type")
        kinds = [cell_store.stored(rows.where(c), F.col("day"), k) for c, k in (("event_type = 'signup'", cell_store.KEYFRAMES), ("event_type <> 'signup'", cell_store.DELTAS))]
        return cell_store.current(kinds[0].union(kinds[1])).withColumn("added", F.round("added", 3))

    user = "SELECT CAST(user_id % 4096 AS INT) AS code, CAST(date_part('doy', ts) AS INT) AS version, arg_min(CAST(value AS FLOAT), event_id) AS v FROM events WHERE event_type"
    _add("cell_current", mixed, f"WITH k AS ({user} = 'signup' GROUP BY 1, 2), d AS ({user} <> 'signup' GROUP BY 1, 2), n AS (SELECT code, max(version) AS version, arg_max(v, version) AS base FROM k GROUP BY 1) SELECT n.code, n.version, base, round(coalesce(sum(CAST(d.v AS DOUBLE)), 0), 3) AS added FROM n LEFT JOIN d ON d.code = n.code AND d.version > n.version GROUP BY 1, 2, 3")

    def framed(s: SparkSession, d: str) -> DataFrame:
        """Every event's props in a frame, damaged in one of four ways or not: what a reader says of each."""
        e = tables.table(s, d, "events").select("event_id", F.coalesce(F.col("props"), F.lit("")).cast("binary").alias("data"))
        f = e.withColumn("frame", frames.frame(F.col("data"))).withColumn("other", frames.frame(F.concat("data", F.lit(b"x"))))
        way = F.col("event_id") % 8
        f = f.withColumn(
            "frame",
            F.when(way == 0, F.substring("frame", 1, 20))
            .when(way == 1, F.overlay("frame", F.lit(b"?"), 1))
            .when(way == 2, F.overlay("frame", F.substring("other", 5, 8), 5))
            .when(way == 3, F.concat("frame", F.lit(b"x")))
            .when(way == 4, F.overlay("frame", F.substring("other", 22, 9), 22))
            .otherwise(F.col("frame")),
        )
        f = f.withColumn("status", frames.status(F.col("frame")))
        return f.select("event_id", "status", F.when(F.col("status") == "ok", frames.body(F.col("frame")).cast("string")).alias("props"))

    _add("frame_verify", framed, "SELECT event_id, coalesce((['short', 'magic', 'header', 'length', 'data'])[event_id % 8 + 1], 'ok') AS status, CASE WHEN event_id % 8 > 4 THEN coalesce(props, '') END AS props FROM events")


def _plans() -> None:
    seg = "s AS (SELECT event_id // 1000 AS segment_id, count(*) * 12 AS size, CAST((event_id // 1000) % 3 AS INT) AS level FROM events GROUP BY 1, 3), z AS (SELECT level, count(*) AS files, sum(size) AS bytes FROM s GROUP BY 1)"
    src = tables.segments_from_events
    _add("level_sizes", lambda s, d: compaction.level_sizes(src(s, d)), f"WITH {seg} SELECT level, files, CAST(bytes AS BIGINT) AS bytes FROM z")
    _add("compact_plan_leveled", lambda s, d: compaction.leveled(src(s, d)), f"WITH {seg}, f AS (SELECT min(level) AS from_level FROM z WHERE (level = 0 AND files >= 4) OR (level BETWEEN 1 AND 5 AND bytes > 67108864 * pow(10, level))) SELECT segment_id, from_level, from_level + 1 AS to_level FROM s JOIN f ON level = from_level WHERE from_level = 0 OR segment_id = (SELECT arg_max(segment_id, size * 1000000 - segment_id) FROM s WHERE level = from_level)")

    def small(s: SparkSession, d: str) -> DataFrame:
        """No level 0 and a small limit, so the largest segment of level 1 moves."""
        return compaction.leveled(src(s, d).where("level > 0"), level_bytes=100, ratio=1)

    _add("compact_plan_largest", small, f"WITH {seg}, r AS (SELECT *, row_number() OVER (ORDER BY size DESC, segment_id) AS n FROM s WHERE level = (SELECT min(level) FROM z WHERE level > 0 AND bytes > 100)) SELECT segment_id, level AS from_level, level + 1 AS to_level FROM r WHERE n = 1")
    _add("compact_plan_tiered", lambda s, d: compaction.tiered(src(s, d), 2), f"WITH {seg}, f AS (SELECT min(level) AS from_level FROM z WHERE files >= 2) SELECT segment_id, from_level, least(from_level + 1, 6) AS to_level FROM s JOIN f ON level = from_level")
    walk = "o AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY size, segment_id) AS i FROM s), f AS (SELECT level, segment_id, i, 0 AS tier, 1 AS n, CAST(size AS BIGINT) AS total FROM o WHERE i = 1 UNION ALL SELECT level, segment_id, i, CASE WHEN near THEN tier ELSE tier + 1 END, CASE WHEN near THEN n + 1 ELSE 1 END, CASE WHEN near THEN total + size ELSE size END FROM (SELECT o.level, o.segment_id, o.i, o.size, f.tier, f.n, f.total, abs(o.size - f.total // f.n) / greatest(f.total // f.n, 1) <= 0.5 AS near FROM f JOIN o ON o.level = f.level AND o.i = f.i + 1))"
    _add("compact_plan_size_tiered", lambda s, d: compaction.size_tiered(src(s, d)), f"WITH RECURSIVE {seg}, {walk} SELECT segment_id, level, tier FROM f")

    def uneven(s: SparkSession, d: str) -> DataFrame:
        """A segment for each user, as large as their events, so that there are several tiers."""
        e = tables.table(s, d, "events").groupBy("user_id").agg((F.count("*") * 12).alias("size"))
        return compaction.size_tiered(e.select(F.col("user_id").alias("segment_id"), "size", F.expr("cast(user_id % 2 as int)").alias("level")))

    _add("compact_plan_size_tiered_users", uneven, f"WITH RECURSIVE s AS (SELECT user_id AS segment_id, count(*) * 12 AS size, CAST(user_id % 2 AS INT) AS level FROM events GROUP BY 1), {walk} SELECT segment_id, level, tier FROM f")
    _add("compact_score", lambda s, d: compaction.score(src(s, d)).select(F.round("score", 6).alias("score")), f"WITH {seg} SELECT round(max(CASE WHEN level = 0 THEN files / 4 ELSE bytes / (67108864 * pow(10, level)) END), 6) AS score FROM z")


def _transactions() -> None:
    def version(s: SparkSession, d: str) -> DataFrame:
        o = tables.table(s, d, "orders")
        ts = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
        return o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("txn_id"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderstatus") == "F", ts).alias("commit_ts"), F.col("o_orderkey").alias("seq"))

    def txn(s: SparkSession, d: str) -> DataFrame:
        o = tables.table(s, d, "orders")
        status = F.when(F.col("o_orderstatus") == "F", "committed").when(F.col("o_orderstatus") == "O", "active").otherwise("aborted")
        return o.select(F.col("o_orderkey").alias("txn_id"), status.alias("status"), (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) - 2_592_000).alias("start_ts"))

    at = 852_076_800  # 1997-01-01
    v = "v AS (SELECT o_custkey AS key, o_orderkey AS txn_id, o_totalprice AS value, CASE WHEN o_orderstatus = 'F' THEN CAST(epoch(o_orderdate) AS BIGINT) END AS commit_ts, o_orderkey AS seq, o_orderstatus AS st FROM orders)"
    _add("mvcc_snapshot_read", lambda s, d: versions.snapshot(version(s, d), at, me=7), f"WITH {v} SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY txn_id = 7 DESC, commit_ts DESC NULLS LAST, seq DESC) AS n FROM v WHERE commit_ts <= {at} OR txn_id = 7) WHERE n = 1")
    _add("mvcc_gc", lambda s, d: versions.collected(version(s, d), at).select("key", "txn_id"), f"WITH {v} SELECT key, txn_id FROM (SELECT *, row_number() OVER (PARTITION BY key, commit_ts <= {at} ORDER BY commit_ts DESC, seq DESC) AS n FROM v) WHERE coalesce(commit_ts > {at}, true) OR n = 1")

    def conflicts(s: SparkSession, d: str) -> DataFrame:
        w = version(s, d).where("commit_ts is not null").select("key", "txn_id")
        return versions.write_conflicts(version(s, d), txn(s, d), w)

    _add("mvcc_conflicts", conflicts, f"WITH {v} SELECT w.key, w.txn_id, min(o.txn_id) AS holder FROM v w JOIN v o ON w.key = o.key AND o.st = 'O' AND o.txn_id != w.txn_id WHERE w.commit_ts IS NOT NULL GROUP BY 1, 2")
    _add("mvcc_lost_updates", lambda s, d: versions.lost_updates(version(s, d), txn(s, d)), f"WITH {v} SELECT DISTINCT a.key, a.txn_id FROM v a JOIN v b ON a.key = b.key AND a.txn_id != b.txn_id WHERE b.commit_ts > a.commit_ts - 2592000 AND b.commit_ts < a.commit_ts")

    def occ(s: SparkSession, d: str) -> DataFrame:
        o = tables.table(s, d, "orders")
        reads = o.select(F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"))
        return versions.stale_reads(reads, reads.groupBy("key").agg(F.max("version").alias("version")))

    _add("occ_validate", occ, "SELECT o_orderkey AS txn_id, o_custkey AS key FROM (SELECT *, max(o_orderkey) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderkey != m")

    def locks(s: SparkSession, d: str) -> DataFrame:
        o = tables.table(s, d, "orders")
        return o.select(F.col("o_custkey").alias("key"), F.expr("o_orderkey % 500").alias("txn_id"), (F.col("o_orderstatus") == "F").alias("granted")).where("o_orderstatus != 'P'")

    lock = "k AS (SELECT o_custkey AS key, o_orderkey % 500 AS txn_id, o_orderstatus = 'F' AS granted FROM orders WHERE o_orderstatus != 'P'), e AS (SELECT DISTINCT a.txn_id AS waiter, b.txn_id AS holder FROM k a JOIN k b ON a.key = b.key AND NOT a.granted AND b.granted AND a.txn_id != b.txn_id)"
    _add("lock_wait_for", lambda s, d: versions.waits(locks(s, d)), f"WITH {lock} SELECT waiter, holder FROM e")

    def held(s: SparkSession, d: str) -> DataFrame:
        """Two orders are one transaction; finished ones hold their customer, open ones wait for it."""
        o = tables.table(s, d, "orders").where("o_orderstatus != 'P'")
        return o.select(F.col("o_custkey").alias("key"), F.expr("o_orderkey div 2").alias("txn_id"), (F.col("o_orderstatus") == "F").alias("granted"))

    _add("lock_deadlock_cycle", lambda s, d: versions.deadlocked_locks(held(s, d)), "WITH RECURSIVE k AS (SELECT o_custkey AS key, o_orderkey // 2 AS txn_id, o_orderstatus = 'F' AS granted FROM orders WHERE o_orderstatus != 'P'), e AS (SELECT DISTINCT a.txn_id AS waiter, b.txn_id AS holder FROM k a JOIN k b ON a.key = b.key AND NOT a.granted AND b.granted AND a.txn_id != b.txn_id), r AS (SELECT waiter, holder FROM e UNION SELECT r.waiter, e.holder FROM r JOIN e ON r.holder = e.waiter) SELECT DISTINCT waiter AS txn_id FROM r WHERE waiter = holder")

    def decided(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
        """New transactions begin for every open order; those of odd orders commit, of even ones abort."""
        known = versions.begun(txn(s, d).where("status != 'active'"), txn(s, d).where("status = 'active'").select("txn_id", "start_ts"))
        return versions.settled(version(s, d), known, known.select("txn_id", F.when(F.expr("txn_id % 2 = 1"), F.col("start_ts") + 60).alias("commit_ts")))

    _add("mvcc_commit_abort", lambda s, d: decided(s, d)[0].select("key", "txn_id", "commit_ts"), f"WITH {v} SELECT key, txn_id, CASE WHEN st = 'O' THEN (SELECT CAST(epoch(o_orderdate) AS BIGINT) FROM orders WHERE o_orderkey = txn_id) - 2591940 ELSE commit_ts END AS commit_ts FROM v WHERE st != 'O' OR txn_id % 2 = 1")
    _add("mvcc_status", lambda s, d: decided(s, d)[1].select("txn_id", "status"), "SELECT o_orderkey AS txn_id, CASE WHEN o_orderstatus = 'F' THEN 'committed' WHEN o_orderstatus = 'P' THEN 'aborted' WHEN o_orderkey % 2 = 1 THEN 'committed' ELSE 'aborted' END AS status FROM orders")
    _add("raft_commit_index", raft_commit, "WITH g AS (SELECT o_orderpriority AS node, max(o_orderkey) AS m FROM orders GROUP BY 1), h AS (SELECT m FROM g ORDER BY m DESC LIMIT 1 OFFSET 2) SELECT coalesce(max(o_orderkey), 0) AS commit_index FROM orders, h WHERE o_orderkey <= m AND o_orderkey % 3 = 1")

    def entries(s: SparkSession, d: str) -> DataFrame:
        li = tables.table(s, d, "lineitem")
        log = li.groupBy(F.col("l_orderkey").alias("index")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("t"), F.col("l_extendedprice").alias("v"))).alias("points"))
        return log.withColumn("points", F.transform("points", lambda p: F.struct(p["t"].alias("t"), F.array_max(F.transform(F.filter("points", lambda q: q["t"] == p["t"]), lambda q: q["v"])).alias("v"))))

    def committed(s: SparkSession, d: str) -> DataFrame:
        """Every entry up to the index that a majority holds, however long the log is."""
        return versions.replayed(entries(s, d), raft_commit(s, d).first()["commit_index"])

    commit = SQL["raft_commit_index"]
    _add("raft_log_replay_committed", committed, f"SELECT t, v FROM (SELECT l_partkey AS t, l_orderkey, max(l_extendedprice) AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC) AS n FROM lineitem WHERE l_orderkey <= ({commit}) GROUP BY 1, 2) WHERE n = 1")
    _add("raft_log_replay", lambda s, d: versions.replayed(entries(s, d), 1000), "SELECT t, v FROM (SELECT l_partkey AS t, l_orderkey, max(l_extendedprice) AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC) AS n FROM lineitem WHERE l_orderkey <= 1000 GROUP BY 1, 2) WHERE n = 1")


def raft_commit(s: SparkSession, d: str) -> DataFrame:
    o = tables.table(s, d, "orders")
    match = o.groupBy(F.col("o_orderpriority").alias("node")).agg(F.max("o_orderkey").alias("match_index"))
    log = o.select(F.col("o_orderkey").alias("index"), F.expr("o_orderkey % 3").alias("term"))
    return versions.commit_index(match, log, 1, peers=5)


_blobs()
_metrics()
_cells()
_plans()
_transactions()
