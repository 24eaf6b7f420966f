"""Values sealed with AES-GCM, bound to the row that they belong to.

The key is a literal of the plan: keep plans and event logs of sealed tables as secret as the key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 600_000
CONTEXT = b"tidemark database key"


def derive_key(passphrase: bytes, context: bytes = CONTEXT, rounds: int = ROUNDS) -> bytes:
    """32 bytes for AES-256 by PBKDF2 over SHA-256; one passphrase gives other keys in other contexts."""
    return hashlib.pbkdf2_hmac("sha256", passphrase, context, rounds, 32)


def check_key(key: bytes) -> bytes:
    if len(key) not in (16, 24, 32):
        raise ValueError("an AES key has 16, 24 or 32 bytes")
    return key


def seal(value: Column, key: bytes, *bound_to: Column) -> Column:
    """``value`` (binary or string) sealed; it opens only beside the same ``bound_to``. Null stays null."""
    return F.aes_encrypt(value, F.lit(key), aad=_aad(bound_to))


def unseal(box: Column, key: bytes, *bound_to: Column) -> Column:
    """The sealed bytes; a wrong key, damage or another row is an error."""
    return F.aes_decrypt(box, F.lit(key), aad=_aad(bound_to))


def _aad(bound_to: tuple[Column, ...]) -> Column | None:
    return F.concat_ws(":", *[F.hex(c) for c in bound_to]) if bound_to else None


def sealed_points(points: DataFrame, key: bytes) -> DataFrame:
    """series, sealed, seq from series, t, v, seq: times and values are both hidden."""
    text = F.concat_ws(",", F.col("t").cast("string"), F.coalesce(F.col("v").cast("string"), F.lit("")))
    return points.select("series", seal(text, key, F.col("series"), F.col("seq")).alias("sealed"), "seq")


def opened_points(rows: DataFrame, key: bytes) -> DataFrame:
    parts = F.split(unseal(F.col("sealed"), key, F.col("series"), F.col("seq")).cast("string"), ",")
    return rows.withColumn("__p", parts).select("series", F.col("__p")[0].cast("long").alias("t"), F.nullif(F.col("__p")[1], F.lit("")).cast("float").alias("v"), "seq")


def sealed_rows(rows: DataFrame, key: bytes) -> DataFrame:
    """Each row of any shape as one sealed column."""
    return rows.select(seal(F.to_json(F.struct("*")), key).alias("sealed"))


def opened_rows(rows: DataFrame, key: bytes, schema: T.StructType) -> DataFrame:
    return rows.select(F.from_json(unseal(F.col("sealed"), key).cast("string"), schema).alias("r")).select("r.*")
