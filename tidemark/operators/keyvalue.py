"""Versioned binary key-value log: newest version wins, tombstones delete.

The newest version per key is an aggregation (max_by over seq), which combines on the map side
and needs no sort of the versions of a key, so a key with very many versions costs no more.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.tables import COMPRESSED, RAW, TOMBSTONE

MIN_COMPRESS_LEN, MIN_SAVING = 200, 16


@F.pandas_udf(T.BinaryType())
def _deflated(value: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else zlib.compress(v, 6) for v in value])


@F.pandas_udf(T.BinaryType())
def _inflated(payload: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else zlib.decompress(p) for p in payload])


def encoded(value: Column | str) -> Column:
    """struct<kind, payload>: zlib, if the value is long enough and gets so much smaller; raw otherwise. Short values get no further than the JVM's side of the call as nulls."""
    v = F.col(value) if isinstance(value, str) else value
    small = _deflated(F.when(F.length(v) >= MIN_COMPRESS_LEN, v))
    better = F.coalesce(F.length(small) + MIN_SAVING < F.length(v), F.lit(False))
    return F.struct(F.when(better, COMPRESSED).otherwise(RAW).alias("kind"), F.when(better, small).otherwise(v).alias("payload"))


def decoded(kind: Column | str, payload: Column | str) -> Column:
    kind, payload = (F.col(c) if isinstance(c, str) else c for c in (kind, payload))
    packed = kind == COMPRESSED
    return F.when(packed, _inflated(F.when(packed, payload))).otherwise(payload)


def puts(rows: DataFrame) -> DataFrame:
    """Log rows from (k, v, seq)."""
    return rows.select("k", encoded("v").alias("e"), "seq").select("k", "e.kind", "e.payload", "seq")


def deletes(keys: DataFrame) -> DataFrame:
    """Log rows from (k, seq)."""
    return keys.select("k", F.lit(TOMBSTONE).alias("kind"), F.lit(None).cast("binary").alias("payload"), "seq")


def framed(log: DataFrame) -> DataFrame:
    """Log rows with a checksum over kind, key and payload, as they are written."""
    return log.withColumn("crc", _checksum())


def _checksum() -> Column:
    return F.crc32(F.concat(F.col("kind").cast("string").cast("binary"), "k", F.coalesce("payload", F.lit(b""))))


def intact(frames: DataFrame) -> DataFrame:
    """The log up to its first broken record: one whose checksum is missing (cut off) or does not fit."""
    broken = frames.where(F.col("crc").isNull() | (F.col("crc") != _checksum())).agg(F.min("seq").alias("__stop"))
    return frames.join(F.broadcast(broken), F.col("__stop").isNull() | (F.col("seq") < F.col("__stop"))).drop("__stop", "crc")  # one row


def live(log: DataFrame) -> DataFrame:
    """The newest version of every key that is not deleted: k, kind, payload, seq."""
    newest = log.groupBy("k").agg(F.max_by(F.struct("kind", "payload", "seq"), "seq").alias("e"))
    return newest.select("k", "e.kind", "e.payload", "e.seq").where(F.col("kind") != TOMBSTONE)


def get(log: DataFrame, key: bytes) -> DataFrame:
    """The value of one key, or no row. The key's filter reaches the scan."""
    return live(log.where(F.col("k") == F.lit(key)))


def successor(prefix: bytes) -> bytes | None:
    """The least key above all keys that begin with ``prefix``; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def prefix_scan(log: DataFrame, prefix: bytes = b"") -> DataFrame:
    """Live keys that begin with ``prefix``, by key. A key range, so that statistics of the files prune."""
    if prefix:
        log = log.where(F.col("k") >= F.lit(prefix))
        end = successor(prefix)
        log = log.where(F.col("k") < F.lit(end)) if end is not None else log
    return live(log).orderBy("k")


def compacted(log: DataFrame) -> DataFrame:
    """What a full compaction keeps: one version of each live key, ordered within files by key."""
    return live(log).repartitionByRange("k").sortWithinPartitions("k")


def length(log: DataFrame) -> DataFrame:
    return live(log).agg(F.count("*").alias("n"))
