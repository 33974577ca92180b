"""A table of bars that a stream of ticks adds to: pieces by batch, merged when read.

A batch writes only what its own ticks make: for each bar that they touch its
first and last price with their places in time, highest, lowest and sum.  Such
pieces merge in any order, so a tick that comes late, however late, revises its
bar without state kept by the stream.  Pieces lie in folders by symbol bucket.

A manifest lists the folders that make up a version; it is written after them
and counts once Spark has marked it complete.  What no manifest lists is not
there, so a crash between the two changes nothing, and a batch that is run again
after its manifest is passed over.  Once ``fan`` folders of one level have
gathered they are merged into one of the next, so a piece is rewritten once a
level.  Older manifests but for ``keep``, and folders that none lists, are
deleted.  One stream writes at a time; any number may read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

PIECE = "symbol string, date timestamp, first struct<ts: timestamp, seq: bigint>, open double, high double, low double, last struct<ts: timestamp, seq: bigint>, close double, volume double, bucket int"
MANIFEST = "folder string, level int, batch long, version long"


def pieces(ticks: DataFrame, unit: str, buckets: int) -> DataFrame:
    """The piece of each bar that the ticks (symbol, ts, seq, price) touch."""
    at = F.struct("ts", "seq")
    bars = ticks.filter("symbol is not null and ts is not null and price is not null").groupBy("symbol", F.window("ts", unit).alias("w"))
    made = bars.agg(F.min(at).alias("first"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(at).alias("last"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return made.select("symbol", F.col("w.start").alias("date"), "first", "open", "high", "low", "last", "close", "volume", bucket_of(F.col("symbol"), buckets).alias("bucket"))


def bucket_of(symbol: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(buckets)).cast("int")


def merged(rows: DataFrame) -> DataFrame:
    """One piece for each bar."""
    names = [f.strip().split(" ")[0] for f in ("symbol", "date", "first", "open", "high", "low", "last", "close", "volume", "bucket")]
    made = rows.groupBy("symbol", "date", "bucket").agg(F.min_by("open", "first").alias("open"), F.min("first").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last").alias("close"), F.max("last").alias("last"), F.sum("volume").alias("volume"))
    return made.select(*names)


class BarTable:
    """Bars under the folder ``path``, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, unit: str = "1 hour", buckets: int = 16, fan: int = 8, keep: int = 2):
        self.spark, self.path, self.unit, self.buckets, self.fan, self.keep = spark, path.rstrip("/"), unit, buckets, fan, keep
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- versions ---

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop.Path(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in self._files.listStatus(at)] if self._files.exists(at) else []

    def versions(self) -> list[int]:
        """The numbers of the versions that are there, ascending."""
        found = [int(n.removeprefix("v")) for n in self._names("manifest")]
        return sorted(v for v in found if self._files.exists(self._hadoop.Path(f"{self.path}/manifest/v{v}/_SUCCESS")))

    def listed(self, version: int | None = None) -> list[tuple[str, int, int]]:
        """(folder, level, batch) of a version, the newest unless one is named: a row for each of a few folders."""
        there = self.versions()
        if not there:
            return []
        rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/v{there[-1] if version is None else version}")
        return sorted((r.folder, r.level, r.batch) for r in rows.collect())

    def last_batch(self) -> int:
        return max((batch for _, _, batch in self.listed()), default=-1)

    def _commit(self, rows: list[tuple[str, int, int]]) -> None:
        version = max(self.versions(), default=-1) + 1
        frame = self.spark.createDataFrame([(*r, version) for r in rows], MANIFEST)
        frame.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/v{version}")

    def _write(self, rows: DataFrame, level: int, batch: int) -> tuple[str, int, int]:
        folder = f"folder=level{level}-{batch}-{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/pieces/{folder}")
        return folder, level, batch

    # --- reading and writing ---

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], PIECE)
        return self.spark.read.schema(PIECE).option("basePath", f"{self.path}/pieces").parquet(*(f"{self.path}/pieces/{f}" for f in folders))

    def read(self, *symbols: str, version: int | None = None) -> DataFrame:
        """symbol, date, open, high, low, close, volume; named symbols read their buckets only."""
        rows = self._read([f for f, _, _ in self.listed(version)])
        if symbols:
            wanted = {r[0] for r in self.spark.createDataFrame([(s,) for s in symbols], "symbol string").select(bucket_of(F.col("symbol"), self.buckets)).collect()}
            rows = rows.filter(F.col("bucket").isin(*wanted) & F.col("symbol").isin(*symbols))
        return merged(rows).select("symbol", "date", "open", "high", "low", "close", "volume")

    def add(self, ticks: DataFrame, batch: int) -> bool:
        """Add a batch; False where a version has it already."""
        rows = self.listed()
        if any(batch <= seen for _, _, seen in rows):
            return False
        self._commit([*rows, self._write(pieces(ticks, self.unit, self.buckets), 0, batch)])
        self.compact()
        return True

    def compact(self) -> None:
        """Merge full levels, then delete what is left over."""
        rows = self.listed()
        for level in range(64):
            own = [r for r in rows if r[1] == level]
            if len(own) < self.fan:
                break
            whole = self._write(merged(self._read([f for f, _, _ in own])), level + 1, max(b for _, _, b in own))
            rows = [r for r in rows if r[1] != level] + [whole]
            self._commit(rows)
        self.clean()

    def clean(self) -> None:
        """Delete old manifests and the folders that none of the others lists."""
        there = self.versions()
        for version in there[: -self.keep]:
            self._files.delete(self._hadoop.Path(f"{self.path}/manifest/v{version}"), True)
        live = {f for version in there[-self.keep :] for f, _, _ in self.listed(version)}
        for folder in self._names("pieces"):
            if folder not in live:
                self._files.delete(self._hadoop.Path(f"{self.path}/pieces/{folder}"), True)


def stored(ticks: DataFrame, table: BarTable, checkpoint: str) -> DataStreamWriter:
    """A query that adds each batch of a stream of ticks to the table."""
    return ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: table.add(batch, number) and None)
