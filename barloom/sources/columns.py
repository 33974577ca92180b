"""Column files: one array of 32-bit floats for each instrument and field, placed by a shared calendar.

``<folder>/features/<instrument>/<field>.day.bin`` has a value for each line of
``<folder>/calendars/day.txt``.  Files are read by Spark's binary reader, so
they may lie wherever Spark can read; they are written through a data source
whose tasks write beside the table and whose commit moves what they wrote into
place, the calendar last.  What lies beyond the calendar does not count, so an
append is there at once or not at all, and a job that fails leaves nothing.
"""

from __future__ import annotations

import sys
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FIELDS = ("open", "high", "low", "close", "volume")


def read_columns(spark: SparkSession, folder: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """symbol, date and the fields (null where a file has none); values beyond the calendar are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.day.bin").load(f"{folder}/features").select("path", "content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = array("f", content[: len(content) // 4 * 4])
                if sys.byteorder == "big":
                    values.byteswap()
                *_, symbol, name = path.split("/")
                n = len(values)
                numbers = [None if v != v else float(v) for v in values]
                yield pa.RecordBatch.from_arrays([pa.array([symbol] * n), pa.array([name.removesuffix(".day.bin")] * n), pa.array(range(n), pa.int64()), pa.array(numbers, pa.float64())], ["symbol", "field", "place", "value"])

    long = files.mapInArrow(unpack, "symbol string, field string, place long, value double").filter(F.col("field").isin(*fields))
    lines = spark.read.text(f"{folder}/calendars/day.txt").select(F.to_date("value").alias("date")).filter("date is not null")
    calendar = lines.withColumn("place", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))  # a calendar has few days
    wide = long.groupBy("symbol", "place").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))
    return wide.join(F.broadcast(calendar), "place").filter(F.coalesce(*fields).isNotNull()).select("symbol", "date", *fields)


# --- writing ---


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _ColumnWriter(DataSourceWriter):
    """Rows (symbol, field, values) as files; with ``append`` the values follow those that are there."""

    def __init__(self, path: str, calendar: str, append: bool):
        self.path, self.calendar, self.append, self.job = path.rstrip("/"), calendar, append, uuid.uuid4().hex

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")

    def write(self, rows: Iterator[Row]) -> _Written:
        files, root = self._at()
        done = []
        for row in rows:
            name = f"features/{row.symbol}/{row.field}.day.bin"
            values = array("f", (float("nan") if v is None else v for v in row["values"]))
            if sys.byteorder == "big":
                values.byteswap()
            before = b""
            if self.append and files.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                with files.open_input_stream(f"{root}/{name}") as file:
                    before = file.read()
            files.create_dir(f"{root}/_jobs/{self.job}/features/{row.symbol}", recursive=True)
            with files.open_output_stream(f"{root}/_jobs/{self.job}/{name}") as file:
                file.write(before[: row.before * 4] + array("f", [float("nan")] * (row.before - len(before) // 4)).tobytes() + values.tobytes())
            done.append(name)
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = self._at()
        for name in (n for m in messages if m for n in m.files):
            files.create_dir(f"{root}/{name.rpartition('/')[0]}", recursive=True)
            files.move(f"{root}/_jobs/{self.job}/{name}", f"{root}/{name}")
        files.create_dir(f"{root}/calendars", recursive=True)
        with files.open_output_stream(f"{root}/calendars/day.txt") as file:
            file.write(self.calendar.encode())
        self._clean(files, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean(*self._at())

    def _clean(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/_jobs/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/_jobs/{self.job}")


class ColumnFiles(DataSource):
    """The format ``column_files``: options ``path`` and ``calendar`` (its lines)."""

    @classmethod
    def name(cls) -> str:
        return "column_files"

    def schema(self) -> str:
        return "symbol string, field string, before int, values array<float>"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ColumnWriter(self.options["path"], self.options["calendar"], not overwrite)


def laid(bars: DataFrame, dates: list, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(symbol, field, values): every symbol's fields on all dates, gaps filled forward and then back."""
    spark = bars.sparkSession
    calendar = spark.createDataFrame([(d, k) for k, d in enumerate(dates)], "date date, place int")  # a row a date
    grid = bars.select("symbol").distinct().crossJoin(F.broadcast(calendar)).join(bars.select("symbol", "date", *fields), ["symbol", "date"], "left")  # what is written has this many values
    past = Window.partitionBy("symbol").orderBy("place")
    filled = {f: F.coalesce(F.last(f, ignorenulls=True).over(past.rowsBetween(Window.unboundedPreceding, 0)), F.first(f, ignorenulls=True).over(past.rowsBetween(0, Window.unboundedFollowing))) for f in fields}
    whole = grid.select("symbol", "place", *(x.cast("float").alias(f) for f, x in filled.items()))
    gathered = whole.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias("rows"))  # a symbol's dates
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"rows.{f}").alias("values")) for f in fields))
    return gathered.select("symbol", F.inline(each))


def write_columns(bars: DataFrame, folder: str, fields: tuple[str, ...] = FIELDS, append: bool = False) -> None:
    """Write bars (symbol, date, fields) as column files on the calendar of their dates.

    Written anew, the result depends on the bars only, not on what lay there.
    Appended, later dates follow: their gaps are filled from the values that are
    there, symbols that are new have none before, symbols without new bars keep
    their last values.
    """
    spark = bars.sparkSession
    spark.dataSource.register(ColumnFiles)
    days = sorted(r.date for r in bars.select("date").distinct().collect())  # a calendar has few days
    before: list = []
    rows = bars
    if append:
        before = sorted(r.date for r in _calendar(spark, folder).collect())
        if days and before and days[0] <= before[-1]:
            raise ValueError(f"{days[0]} does not follow {before[-1]}, the last date that is there")
        last = read_columns(spark, folder, fields).filter(F.col("date") == F.lit(before[-1]))
        rows = bars.select("symbol", "date", *fields).unionByName(last)
    skip = 1 if append else 0  # the date that only carries the old values
    made = laid(rows, [*before[-1:], *days], fields).select("symbol", "field", F.lit(len(before)).cast("int").alias("before"), F.slice("values", 1 + skip, max(1, len(days))).alias("values"))
    lines = "".join(f"{d}\n" for d in [*before, *days])
    made.write.format("column_files").mode("append" if append else "overwrite").option("path", folder).option("calendar", lines).save()


def _calendar(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(f"{folder}/calendars/day.txt").select(F.to_date("value").alias("date")).filter("date is not null")


def instruments(spark: SparkSession, folder: str) -> DataFrame:
    """symbol, first_date, last_date of every instrument that has a close."""
    return read_columns(spark, folder, ("close",)).groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def write_instruments(spark: SparkSession, folder: str, universe: str) -> None:
    """``<folder>/instruments/<universe>``: text lines of instrument, first and last date, separated by tabs."""
    rows = instruments(spark, folder)
    rows.select(F.concat_ws("\t", F.lower("symbol"), F.col("first_date").cast("string"), F.col("last_date").cast("string")).alias("value")).coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(f"{folder}/instruments/{universe}")
