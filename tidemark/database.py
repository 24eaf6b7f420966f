"""A folder of Parquet tables as a database: points, blobs, and model segments."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import sealing
from tidemark.operators import cells as cell_store
from tidemark.operators import keyvalue, models, series

_POINTS = "series string, t long, v float, seq long"
_SEALED = "series string, sealed binary, seq long"
_BLOBS = "k binary, kind int, payload binary, seq long"


class Database:
    """open / put / put_batch / put_numpy / get / scan / aggregate / downsample / flush / stats / close, and blobs.

    Every put is an atomic append of Parquet files, visible at once; write in batches. One writer
    at a time; any number of readers. Rows are numbered on from the largest stored number, so a
    later put is always the later one.

    Blobs lie in numbered versions of one table. A compaction writes the next version; readers take
    the newest that is complete, so a crash in between leaves the old one in force.

    With a ``key`` (16, 24 or 32 bytes, see ``sealing.derive_key``) times, values, blobs and models are
    sealed on storage; names of series and keys of blobs stay readable. Bounds on time then cannot
    prune files.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "default", key: bytes | None = None):
        self.spark, self.path, self.series_name = spark, path.rstrip("/"), name
        self._key = None if key is None else sealing.check_key(key)
        self._last: dict[str, int] = {}  # largest number stored in each table, once asked for

    @classmethod
    def open(cls, spark: SparkSession, path: str, name: str = "default", key: bytes | None = None) -> Database:
        return cls(spark, path, name, key)

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def _folder(self, path: str):
        """Hadoop's file system and path of ``path``."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def _read(self, table: str, schema: str) -> DataFrame:
        fs, folder = self._folder(f"{self.path}/{table}")
        if not fs.exists(folder):  # nothing was put yet
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")

    def _next(self, table: str, rows: DataFrame) -> int:
        """The number after the largest of ``rows``; later puts of this object go on from what they have given."""
        if table not in self._last:
            self._last[table] = rows.agg(F.max("seq")).first()[0] or 0
        return self._last[table] + 1

    def _numbered(self, table: str, rows: DataFrame, count: int) -> list[int]:
        base = self._next(table, rows)
        self._last[table] = base + count - 1
        return list(range(base, base + count))

    def points(self) -> DataFrame:
        return self._all_points().where(F.col("series") == self.series_name)

    def _all_points(self) -> DataFrame:
        if self._key is None:
            return self._read("points", _POINTS)
        return sealing.opened_points(self._read("points", _SEALED), self._key)

    def _append(self, points: DataFrame) -> None:
        rows = points if self._key is None else sealing.sealed_points(points, self._key)
        rows.write.mode("append").parquet(f"{self.path}/points")

    def put(self, t: int, v: float) -> None:
        self.put_batch([(t, v)])

    def put_batch(self, rows: Iterable[tuple[int, float]]) -> None:
        rows = list(rows)
        seq = self._numbered("points", self._all_points(), len(rows))
        data = [(self.series_name, int(t), float(v), n) for (t, v), n in zip(rows, seq, strict=True)]
        self._append(self.spark.createDataFrame(data, _POINTS))

    def put_numpy(self, t: np.ndarray, v: np.ndarray) -> None:
        if t.ndim != 1 or t.shape != v.shape:
            raise ValueError("times and values must be two arrays of one length")
        self.put_batch(zip(t.tolist(), v.tolist(), strict=True))

    def put_frame(self, points: DataFrame) -> None:
        """Append a DataFrame of t and v: the way in for large data. Points are ordered by partition and place in it.

        A partition takes 2**33 numbers, so the numbers last for some 10**9 partitions.
        """
        self._put_rows(points.withColumn("series", F.lit(self.series_name)))

    def _put_rows(self, points: DataFrame) -> None:
        base = self._next("points", self._all_points())
        del self._last["points"]  # the next put asks the table
        rows = points.select("series", F.col("t").cast("long"), F.col("v").cast("float"), (F.monotonically_increasing_id() + base).alias("seq"))
        self._append(rows)

    def put_cells(self, rows: DataFrame, version: int, kind: str = cell_store.KEYFRAMES) -> None:
        """Append values of space cells (code, v) under a version, as keyframes or deltas."""
        self._put_rows(cell_store.stored(rows.withColumn("seq", F.lit(0)), F.lit(version), kind))

    def cells(self, kind: str = cell_store.KEYFRAMES) -> DataFrame:
        """code, version, v of what is stored."""
        return cell_store.values(self._all_points().where(F.col("series") == kind))

    def cell_region(self, low: tuple[int, int, int], high: tuple[int, int, int], kind: str = cell_store.KEYFRAMES) -> DataFrame:
        return cell_store.region(self._all_points().where(F.col("series") == kind), low, high)

    def query(self) -> series.SeriesQuery:
        return series.SeriesQuery(self.points())

    def get(self, t: int) -> float | None:
        row = series.point_get(self.points(), t).first()
        return None if row is None else row[0]

    def scan(self, start: int, end: int) -> DataFrame:
        return self.query().range(start, end).execute()

    def scan_numpy(self, start: int, end: int) -> np.ndarray:
        got = self.scan(start, end).select(F.col("t").cast("double"), F.col("v").cast("double")).toPandas()
        return got.to_numpy(float).reshape(-1, 2)

    def aggregate(self, start: int, end: int, name: str) -> float:
        return self.query().range(start, end).aggregate(name).scalar()

    def downsample(self, start: int, end: int, interval: int, name: str) -> DataFrame:
        return self.query().range(start, end).group_by(interval).aggregate(name).execute()

    def fit(self, capacity: int = 1000, lossless: bool = False) -> DataFrame:
        """Fit models to all points and write them as the segments table."""
        rows = models.fitted(self.points(), capacity, lossless)
        rows = rows if self._key is None else sealing.sealed_rows(rows, self._key)
        rows.write.mode("overwrite").parquet(f"{self.path}/segments")
        return self.segments()

    def segments(self) -> DataFrame:
        """The fitted models."""
        rows = self.spark.read.parquet(f"{self.path}/segments")
        return rows if self._key is None else sealing.opened_rows(rows, self._key, models.fitted(self.points(), 1).schema)

    def stats(self) -> dict:
        """Segments and their sizes, if models were fitted, and what is stored of points and blobs: rows, tables and bytes."""
        fs, folder = self._folder(f"{self.path}/segments")
        fitted = models.stats(self.segments()).first().asDict() if fs.exists(folder) else {"total_segments": 0}
        stored = {"points": self.points().count(), "blob_tables": len(self._versions())}
        for table in ("points", "blobs"):
            fs, folder = self._folder(f"{self.path}/{table}")
            stored[f"{table}_bytes"] = fs.getContentSummary(folder).getLength() if fs.exists(folder) else 0
        return fitted | stored

    def flush(self) -> None:
        """Nothing waits: a put is on storage when it returns."""

    def close(self) -> None:
        self.flush()

    def _versions(self) -> list[int]:
        """Numbers of the complete blob tables, the one in force last."""
        fs, folder = self._folder(f"{self.path}/blobs")
        names = [x.getPath() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        whole = [p.getName() for p in names if fs.exists(self._folder(f"{p.toString()}/_SUCCESS")[1])]
        return sorted(int(n[1:]) for n in whole if n[:1] == "v" and n[1:].isdigit())

    def _table(self) -> str:
        return f"blobs/v{max(self._versions(), default=0)}"

    def _log(self) -> DataFrame:
        """The blob table as it lies on storage."""
        return self._read(self._table(), _BLOBS)

    def blobs(self) -> DataFrame:
        if self._key is None:
            return self._log()
        return self._log().withColumn("payload", sealing.unseal(F.col("payload"), self._key, F.col("k"), F.col("seq")))

    def _append_blobs(self, rows: DataFrame) -> None:
        if self._key is not None:
            rows = rows.withColumn("payload", sealing.seal(F.col("payload"), self._key, F.col("k"), F.col("seq")))
        rows.write.mode("append").parquet(f"{self.path}/{self._table()}")

    def put_blob(self, key: bytes, value: bytes) -> None:
        self.put_blobs([(key, value)])

    def put_blobs(self, rows: Iterable[tuple[bytes, bytes]]) -> None:
        rows = list(rows)
        seq = self._numbered("blobs", self.blobs(), len(rows))
        df = self.spark.createDataFrame([(k, v, n) for (k, v), n in zip(rows, seq, strict=True)], "k binary, v binary, seq long")
        self._append_blobs(keyvalue.puts(df))

    def delete_blob(self, key: bytes) -> None:
        seq = self._numbered("blobs", self.blobs(), 1)[0]
        self._append_blobs(keyvalue.deletes(self.spark.createDataFrame([(key, seq)], "k binary, seq long")))

    def get_blob(self, key: bytes) -> bytes | None:
        row = keyvalue.get(self.blobs(), key).select(keyvalue.decoded("kind", "payload").alias("v")).first()
        return None if row is None else bytes(row[0])

    def scan_blob_prefix(self, prefix: bytes = b"") -> DataFrame:
        return keyvalue.prefix_scan(self.blobs(), prefix).select("k", keyvalue.decoded("kind", "payload").alias("v"))

    def blob_len(self) -> int:
        return keyvalue.length(self.blobs()).first()[0]

    def blob_files(self) -> int:
        """Files of the blob table in force: each put adds some, a compaction makes them few."""
        fs, folder = self._folder(f"{self.path}/{self._table()}")
        return sum(x.getPath().getName().endswith(".parquet") for x in fs.listStatus(folder)) if fs.exists(folder) else 0

    def compact_blobs(self, files: int = 0) -> bool:
        """Write the newest version of each live key as the next table, if the one in force has at least ``files`` files; then delete the older ones.

        The next table counts once it is whole. A reader that began before goes on until its files go.
        """
        if self.blob_files() < files:
            return False
        done = max(self._versions(), default=0)
        self._next("blobs", self.blobs())  # numbers go on though tombstones leave
        keyvalue.compacted(self._log()).write.mode("overwrite").parquet(f"{self.path}/blobs/v{done + 1}")
        for n in self._versions()[:-1]:
            fs, folder = self._folder(f"{self.path}/blobs/v{n}")
            fs.delete(folder, True)
        return True
