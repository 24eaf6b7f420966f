"""Helpers that several operators share: scratch tables, bounded samples, text slices."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master may fall back to a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        path = tempfile.mkdtemp(prefix="spark-ck-")
        spark.conf.set("spark.checkpoint.dir", path)
        return path
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(df[name], F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` with the smallest hashes of ``key``; all of them if it has no more.

    The choice depends on the keys alone, so reruns agree whatever the partitioning.
    """
    total = df.count()
    if total <= rows:
        return df
    bound = int(-(2**63) + 2**64 * (rows / total))
    return df.where(F.xxhash64(key, F.lit(41)) < F.lit(bound))
