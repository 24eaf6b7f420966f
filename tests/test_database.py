import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.database import Database
from tidemark.functions import frames, sealing
from tidemark.operators import cells
from tidemark.streaming import metrics


def test_points(spark, tmp_path):
    with Database.open(spark, str(tmp_path)) as db:
        assert db.get(1) is None and db.scan(0, 10).count() == 0
        db.put_batch([(t, 2.0 * t) for t in range(100)])
        db.put(200, 1.5)
        db.put_numpy(np.array([300]), np.array([3.0]))
        assert db.get(50) == 100 and db.get(9999) is None and db.get(300) == 3
        assert db.aggregate(0, 99, "avg") == 99 and db.downsample(0, 99, 25, "avg").count() == 4
        assert db.scan_numpy(0, 9).shape == (10, 2)
        with pytest.raises(ValueError):
            db.put_numpy(np.zeros(2), np.zeros(3))
        db.put(50, 7.0)
        assert db.get(50) == 100  # the first at a time stays
        db.put_frame(spark.range(1000, 1010).select(F.col("id").alias("t"), F.col("id").alias("v")))
        db.fit(50)
        assert db.stats()["total_segments"] >= 2


def test_order_of_puts(spark, tmp_path):
    """A frame of four partitions is put before what is put after it, whatever the numbers of its rows."""
    db = Database.open(spark, str(tmp_path))
    db.put_frame(spark.range(0, 40, 1, 4).select(F.col("id").alias("t"), F.col("id").alias("v")))
    db.put_batch([(7, 99.0), (39, 98.0), (100, 1.0)])
    db.put_batch([(100, 2.0)])
    again = Database.open(spark, str(tmp_path))
    again.put(100, 3.0)
    assert [db.get(t) for t in (7, 39, 100)] == [7, 39, 1] and db.query().dedup("last").range(100, 100).execute().first().v == 3
    assert db.stats()["points"] == 45 and db.stats()["total_segments"] == 0
    numbers = [r.seq for r in db.points().collect()]
    assert len(set(numbers)) == 45


def test_crash_while_compacting(spark, tmp_path):
    db = Database.open(spark, str(tmp_path))
    for i in range(3):
        db.put_blobs([(b"a", b"%d" % i), (b"b%d" % i, b"x")])
    # a compaction that broke off: files of the next version, but no mark that it is whole
    spark.createDataFrame([(b"a", 0, b"half", 1)], "k binary, kind int, payload binary, seq long").write.parquet(str(tmp_path / "blobs/v1"))
    (tmp_path / "blobs/v1/_SUCCESS").unlink()
    assert db.get_blob(b"a") == b"2" and db.blob_len() == 4 and not db.compact_blobs(files=100)
    assert db.compact_blobs(files=2)
    assert db.get_blob(b"a") == b"2" and db.blob_len() == 4 and db.stats()["blob_tables"] == 1
    db.delete_blob(b"a")
    db.compact_blobs()
    db.put_blob(b"a", b"new")
    assert db.get_blob(b"a") == b"new" and db.blob_len() == 4


def test_blobs(spark, tmp_path):
    db = Database.open(spark, str(tmp_path))
    assert db.get_blob(b"a") is None
    db.put_blobs([(b"a", b"1"), (b"b", b"long line " * 40), (b"a", b"2")])
    db.delete_blob(b"b")
    assert db.get_blob(b"a") == b"2" and db.get_blob(b"b") is None and db.blob_len() == 1
    db.put_blob(b"b", b"back")
    db.compact_blobs()
    assert [(bytes(r.k), bytes(r.v)) for r in db.scan_blob_prefix().collect()] == [(b"a", b"2"), (b"b", b"back")]


def test_stream(spark, tmp_path):
    rows = [("m", i * 10, float(i), i % 3) for i in range(80)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "name string, s long, value double, distinct_id long").select("name", F.timestamp_seconds("s").alias("ts"), "value", "distinct_id").write.parquet(src)
    stream = spark.readStream.schema("name string, ts timestamp, value double, distinct_id long").parquet(src)
    metrics.persisted(metrics.tumbling(stream, "5 minutes", "1 minute"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [r.counter for r in got][:2] == [30, 30] and got[0].gauge == 29 and got[0].cardinality == 3
    metrics.persisted(metrics.cumulative(stream), str(tmp_path / "all"), str(tmp_path / "ck2"), "complete").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "all")).first().counter == 80


def test_sealed(spark, tmp_path):
    """What is put comes back with the key; without it nothing is readable on storage and another key is refused."""
    key = sealing.derive_key(b"pass", rounds=1000)
    assert key == sealing.derive_key(b"pass", rounds=1000) != sealing.derive_key(b"pass", b"other", rounds=1000) and len(key) == 32
    with Database.open(spark, str(tmp_path), key=key) as db:
        db.put_batch([(t, 2.5 * t) for t in range(-10, 50)])
        db.put_frame(spark.createDataFrame([(100, float("nan")), (101, None)], "t long, v float"))
        db.put_blobs([(b"a", b"secret value"), (b"b", b"long " * 100)])
        db.put_blob(b"a", b"newer")
        db.delete_blob(b"b")
        db.fit(20)
    with Database.open(spark, str(tmp_path), key=key) as db:
        assert db.get(-3) == -7.5 and db.scan(0, 9).count() == 10 and np.isnan(db.get(100)) and db.get(101) is None
        assert db.get_blob(b"a") == b"newer" and db.get_blob(b"b") is None
        assert db.compact_blobs() and db.get_blob(b"a") == b"newer"
        assert db.stats()["total_segments"] >= 3
    raw = b"".join(p.read_bytes() for p in tmp_path.rglob("*.parquet"))
    assert b"secret value" not in raw and b"newer" not in raw
    with pytest.raises(Exception):
        Database.open(spark, str(tmp_path), key=bytes(32)).get(-3)
    with pytest.raises(ValueError):
        Database.open(spark, str(tmp_path), key=b"short")


def test_cells(spark, tmp_path):
    """Keyframes and deltas lie apart; the first value of a cell and version stays."""
    db = Database.open(spark, str(tmp_path))
    rows = spark.createDataFrame([(i, float(i)) for i in range(64)], "code int, v float").coalesce(1)
    db.put_cells(rows, 1)
    db.put_cells(rows.withColumn("v", F.col("v") + 1), 1)
    db.put_cells(rows.where("code < 8"), 70000)
    db.put_cells(rows.where("code < 2"), 3, cells.DELTAS)
    got = {(r.code, r.version): r.v for r in db.cells().collect()}
    assert len(got) == 72 and got[5, 1] == 5 and got[5, 70000 & 0xFFFF] == 5
    assert db.cells(cells.DELTAS).count() == 2
    assert {r.code for r in db.cell_region((0, 0, 0), (1, 1, 0)).collect()} == {0, 1, 2, 3}


def test_frames(spark):
    df = spark.createDataFrame([(bytearray(b"payload"),), (bytearray(b""),), (None,)], "d binary")
    for kind in (frames.CRC32, frames.XXH64):
        made = df.select("d", frames.frame(F.col("d"), kind).alias("f"))
        for r in made.select("d", "f", frames.status(F.col("f"), kind).alias("s"), frames.body(F.col("f")).alias("b")).collect():
            assert (r.s, r.b) == ((None, None) if r.d is None else ("ok", r.d))
            if r.d is not None:
                assert bytes(r.f[:12]) == frames.MAGIC + len(r.d).to_bytes(8, "little") and len(r.f) == 30 + len(r.d)
                assert kind or int.from_bytes(r.f[22:30], "little") == zlib.crc32(r.d)
