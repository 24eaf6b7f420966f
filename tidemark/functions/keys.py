"""Packed keys: metric keys, Morton codes, cell keys, checksums, Bloom filter sizes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HASH, _TIME, _VARIANT = (1 << 20) - 1, (1 << 40) - 1, 15


def metric_key(name_hash: Column, ts: Column, variant: Column) -> Column:
    """20 bits of name hash, 40 of time, 4 of variant; hashes from 2**19 on give negative keys."""
    high = F.shiftleft(name_hash.bitwiseAND(F.lit(_HASH)), 44)
    return high.bitwiseOR(F.shiftleft(ts.bitwiseAND(F.lit(_TIME)), 4)).bitwiseOR(variant.cast("long"))


def metric_key_parts(key: Column) -> tuple[Column, Column, Column]:
    return F.shiftrightunsigned(key, 44), F.shiftright(key, 4).bitwiseAND(F.lit(_TIME)), key.bitwiseAND(F.lit(_VARIANT))


# A byte's bits spread to every third place, step by step.
_SPREAD = ((8, 0x00F00F), (4, 0x0C30C3), (2, 0x249249))


def morton(x: Column, y: Column, z: Column) -> Column:
    """24-bit code of three bytes, x in the lowest bit."""
    out = F.lit(0)
    for k, c in enumerate((x, y, z)):
        c = c.cast("int")
        for step, mask in _SPREAD:
            c = c.bitwiseOR(F.shiftleft(c, step)).bitwiseAND(F.lit(mask))
        out = out.bitwiseOR(F.shiftleft(c, k))
    return out


def unmorton(code: Column) -> tuple[Column, Column, Column]:
    out = []
    for k in range(3):
        c = F.shiftright(code, k).bitwiseAND(F.lit(_SPREAD[-1][1]))
        for (step, _), mask in zip(reversed(_SPREAD), (0x0C30C3, 0x00F00F, 0xFF), strict=True):
            c = c.bitwiseOR(F.shiftright(c, step)).bitwiseAND(F.lit(mask))
        out.append(c)
    return out[0], out[1], out[2]


def world_byte(x: Column, low: float, high: float) -> Column:
    """A coordinate as a byte: clamped to [low, high], in single precision, truncated."""
    share = ((x.cast("float") - F.lit(low).cast("float")) / F.lit(high - low).cast("float")).cast("float")
    return (F.least(F.greatest(share, F.lit(0.0).cast("float")), F.lit(1.0).cast("float")) * F.lit(255.0).cast("float")).cast("float").cast("int")


def cell_key(code: Column, version: Column) -> Column:
    return F.shiftleft(code.cast("long"), 16).bitwiseOR(version.cast("long").bitwiseAND(F.lit(0xFFFF)))


def crc32(data: Column) -> Column:
    """CRC-32/IEEE."""
    return F.crc32(data)


@F.pandas_udf(T.LongType())
def xxh64(data: pd.Series) -> pd.Series:
    """xxHash64 with seed 0 as a signed long; Spark's own xxhash64 has another seed."""
    import xxhash

    return pd.Series([None if d is None else int.from_bytes(xxhash.xxh64(d, seed=0).digest(), "big", signed=True) for d in data], dtype="Int64")


def bloom_size(n: Column, p: float) -> tuple[Column, Column]:
    """Bits and hash functions of a Bloom filter for n keys at a false positive rate p."""
    m = F.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, F.ceil(m / n * math.log(2))


def bloom_positions(key: Column, bits: int, hashes: int) -> Column:
    """The bits of a key in a Bloom filter: double hashing with two 32-bit halves of its MD5."""
    digest = F.md5(key)
    h1, h2 = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (h1 + i * h2.bitwiseOR(F.lit(1))) % bits)


def bloom_build(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """A Bloom filter as a table of 64-bit words that are not zero: word, bits."""
    at = keys.select(F.explode(bloom_positions(F.col(key).cast("binary"), bits, hashes)).alias("at"))
    return at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))


def bloom_contains(probes: DataFrame, key: str, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``probes`` (distinct keys) with ``maybe``: whether all bits of the key are set. No key that was put in is missed."""
    at = probes.select(key, F.explode(bloom_positions(F.col(key).cast("binary"), bits, hashes)).alias("at"))
    words = filter_.withColumnRenamed("bits", "__bits")
    joined = at.withColumn("word", F.floor(F.col("at") / 64)).join(words, "word", "left")
    is_set = F.coalesce(F.expr("shiftright(__bits, cast(at % 64 as int)) & 1L"), F.lit(0).cast("long"))
    return joined.groupBy(key).agg((F.min(is_set) == 1).alias("maybe"))


def in_box(code: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    x, y, z = unmorton(code)
    return x.between(low[0], high[0]) & y.between(low[1], high[1]) & z.between(low[2], high[2])
