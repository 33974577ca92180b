"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.lineage import shared_folder

#: One word: a run of code points other than blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_TABLES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[back] = path
    return back


def bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Write ``df`` to the shared folder as a table bucketed and sorted by ``keys``; joins on them need no exchange of it.

    It has as many buckets as the session has shuffle partitions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").saveAsTable(table)
    back = spark.table(table)
    _WRITTEN[back], _TABLES[back] = path, table
    return back


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`materialise` or :func:`bucketed` wrote for these frames; nothing may read them any more."""
    for frame in frames:
        spark, path = frame.sparkSession, _WRITTEN.pop(frame)
        if table := _TABLES.pop(frame, None):
            spark.sql(f"DROP TABLE {table}")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs whose frames are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pieces(batches: Iterator, rows: int = 500) -> Iterator:
    """Arrow batches in pieces of at most ``rows`` rows, so that a Python worker holds what it made of few rows at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def apart(docs: DataFrame, needed: Iterable[str], operator: Callable[[DataFrame], DataFrame], more: tuple[str, ...] = ()) -> DataFrame:
    """``operator`` on ``docs`` whose other columns have names that clash with none of its own.

    The columns of ``docs`` come back under their names, then ``more`` that the
    operator made; a column of ``docs`` named like one of these is replaced.
    """
    docs = docs.drop(*more)
    names = [c if c in set(needed) else f"__own{k}" for k, c in enumerate(docs.columns)]
    out = operator(docs.toDF(*names))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)), *more)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")
