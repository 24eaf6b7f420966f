"""Checksummed frames: a 30-byte header (magic, length, checksum of both, checksum of the data), then the data.

Numbers are little-endian; a checksum is one byte for its kind (0: CRC-32, 1: xxHash64) and eight for its value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import keys

MAGIC = b"TDMK"
HEADER = 30
CRC32, XXH64 = 0, 1


def little_endian(value: Column, size: int) -> Column:
    """The low ``size`` bytes of a long, least first."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)]))


def checksum(data: Column, kind: int = CRC32) -> Column:
    """Nine bytes."""
    value = keys.crc32(data) if kind == CRC32 else keys.xxh64(data)
    return F.concat(F.lit(bytes([kind])), little_endian(value, 8))


def frame(data: Column, kind: int = CRC32) -> Column:
    head = F.concat(F.lit(MAGIC), little_endian(F.octet_length(data), 8))
    return F.concat(head, checksum(head, kind), checksum(data, kind), data)


def status(framed: Column, kind: int = CRC32) -> Column:
    """``ok``, or the first check that fails: short, magic, header, length, data. Null for null."""
    head, data = F.substring(framed, 1, 12), body(framed)
    return (
        F.when(framed.isNull(), None)
        .when(F.octet_length(framed) < HEADER, "short")
        .when(F.substring(framed, 1, 4) != F.lit(MAGIC), "magic")
        .when(F.substring(framed, 13, 9) != checksum(head, kind), "header")
        .when(F.substring(framed, 5, 8) != little_endian(F.octet_length(data), 8), "length")
        .when(F.substring(framed, 22, 9) != checksum(data, kind), "data")
        .otherwise("ok")
    )


def body(framed: Column) -> Column:
    return F.substring(framed, F.lit(HEADER + 1), F.greatest(F.octet_length(framed) - HEADER, F.lit(0)))
