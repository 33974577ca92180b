"""What a user keeps: a watch list, what is fetched and how fresh it is, back-tests by id, and files of all of it.

Tables go in and come out; a change by key is a new table.  Back-tests are
folders of Parquet by run, of which the metrics are written last, so a run is
there or not.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.symbols import market_of

# --- rows by key ---


def added(table: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """``table`` with the rows of ``new`` whose key it lacks; of equal keys in ``new`` one stays."""
    return table.unionByName(new.dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti"))


def updated(table: DataFrame, values: DataFrame, *key: str) -> DataFrame:
    """``table`` with the other columns of ``values`` (a row a key) where the key is in both."""
    names = [c for c in values.columns if c not in key]
    fresh = values.select(*key, *(F.col(c).alias(f"__{c}") for c in names), F.lit(True).alias("__set"))
    joined = table.join(fresh, list(key), "left")
    return joined.select(*(F.when(F.col("__set"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns))


def removed(table: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    """``table`` without the rows whose key is in ``keys``; a null key is no key."""
    return table.join(keys.select(*key).dropna(), list(key), "left_anti")


# --- the watch list: symbol, name, market, tags (separated by commas), added_at ---


def watch(listed: DataFrame, new: DataFrame) -> DataFrame:
    """The list with the symbols of ``new`` (symbol, name, tags, added_at) that it lacks, and their market where it is known."""
    return added(listed, new.withColumn("market", market_of(F.col("symbol"))).select(listed.columns), "symbol")


def tagged(listed: DataFrame, tag: str) -> DataFrame:
    """The symbols that have the tag, all of them for an empty one."""
    tag = tag.strip()
    return listed.filter(F.array_contains(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), lambda x: F.trim(x)), tag)) if tag else listed


def listed_quotes(listed: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The listed symbols with their latest close, change and volume; ``ok`` tells whether there is a quote.  Largest change first."""
    quotes = snapshots.select("symbol", "date", "close", "change_pct", "volume", F.lit(True).alias("__ok"))
    out = listed.join(quotes, "symbol", "left").withColumn("ok", F.col("__ok").isNotNull()).drop("__ok")
    return out.orderBy(F.col("change_pct").desc_nulls_last(), "symbol")


# --- freshness ---


def is_fresh(first: dt.date, last: dt.date, now: dt.datetime, ttl: int = 6 * 3600, slack_days: int = 4) -> Column:
    """Whether what was fetched (fetched_at, first_date, last_date) can stand in for first to last.

    It must be at most ``ttl`` seconds old (and at most a minute ahead of the
    clock), reach back to ``first``, and end at most ``slack_days`` before ``last``.
    """
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("fetched_at").cast("timestamp"))
    covers = (F.col("first_date") <= F.lit(first)) & (F.datediff(F.lit(last), F.col("last_date")) <= slack_days)
    return F.coalesce(age.between(-60, ttl) & covers, F.lit(False))


# --- back-tests ---


class RunStore:
    """Back-tests in the folder ``path``, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, table: str, run: str) -> str:
        return f"{self.path}/{table}/run={run}"

    def _there(self, run: str) -> bool:
        return self._files.exists(self._hadoop.Path(f"{self._folder('metrics', run)}/_SUCCESS"))

    def save(self, run: str, metrics: DataFrame, equity: DataFrame, trades: DataFrame) -> None:
        """Keep a run under a new name.  metrics: one row a symbol, with what names the run (strategy, created_at, ...)."""
        if self._there(run):
            raise ValueError(f"there is a run of this name: {run!r}")
        for table, frame in (("equity", equity), ("trades", trades), ("metrics", metrics)):
            frame.write.mode("overwrite").parquet(self._folder(table, run))

    def load(self, run: str) -> dict[str, DataFrame]:
        if not self._there(run):
            raise KeyError(run)
        return {t: self.spark.read.parquet(self._folder(t, run)) for t in ("metrics", "equity", "trades")}

    def runs(self, symbol: str | None = None, limit: int | None = None) -> DataFrame:
        """The metrics of all runs with their ``run``, newest (created_at) first."""
        out = self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/metrics").withColumn("run", F.col("run").cast("string"))
        out = (out if symbol is None else out.filter(F.col("symbol") == symbol)).orderBy(F.col("created_at").desc(), "run")
        return out if limit is None else out.limit(limit)

    def remove(self, run: str) -> bool:
        there = self._there(run)
        for table in ("metrics", "trades", "equity"):
            self._files.delete(self._hadoop.Path(self._folder(table, run)), True)
        return there


def compared(runs: DataFrame, *metrics: str) -> DataFrame:
    """Each run's symbols side by side with the best of each metric: run, symbol, metric, value, place (1 is the largest, ties by run)."""
    long = runs.select("run", "symbol", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))))
    return long.withColumn("place", F.row_number().over(Window.partitionBy("symbol", "metric").orderBy(F.col("value").desc_nulls_last(), "run")))


def export(datasets: dict[str, DataFrame], folder: str, form: str = "csv") -> None:
    """Each dataset as a folder of csv (with names) or json files."""
    for name, frame in datasets.items():
        writer = frame.write.mode("overwrite")
        (writer.option("header", True).csv if form == "csv" else writer.json)(f"{folder.rstrip('/')}/{name}")


# --- exports ---


def flat_runs(runs: DataFrame, metrics: str = "metrics") -> DataFrame:
    """``runs`` with each entry of the map ``metrics`` as a column ``metric_...``; an entry that a run lacks is null."""
    names = sorted(r.name for r in runs.select(F.explode(F.map_keys(metrics)).alias("name")).distinct().collect())  # a name for each metric
    return runs.select(*(c for c in runs.columns if c != metrics), *(F.try_element_at(metrics, F.lit(n)).alias(f"metric_{n}") for n in names))


def flat_signals(signals: DataFrame, context: str = "context") -> DataFrame:
    """``signals`` with title and body out of the JSON ``context``, a body in one line; what is no JSON gives empty texts."""
    parsed = F.try_parse_json(context)
    text = lambda path: F.coalesce(F.try_variant_get(parsed, path, "string"), F.lit(""))
    return signals.withColumns({"title": text("$.title"), "body": F.replace(text("$.body"), F.lit("\n"), F.lit(" / "))}).drop(context)


def export_all(loaders: dict[str, Callable[[], DataFrame]], folder: str, names: list[str] | None = None, form: str = "csv") -> list[tuple[str, int, str | None]]:
    """Each dataset as :func:`export` writes it: (name, rows, why it was left out).

    One that cannot be loaded or has no rows is left out and does not stop the
    others; unknown names and forms are errors before anything is written.
    """
    unknown = sorted(set(names or ()) - set(loaders))
    if unknown or form not in ("csv", "json"):
        raise ValueError(f"unknown datasets: {unknown}" if unknown else f"unknown form: {form!r}")
    report: list[tuple[str, int, str | None]] = []
    for name in names or loaders:
        try:
            frame = loaders[name]()
            rows = frame.count()
            if rows:
                export({name: frame}, folder, form)
        except Exception as error:  # a dataset's fault is its own
            report.append((name, 0, f"{type(error).__name__}: {error}".splitlines()[0][:200]))
        else:
            report.append((name, rows, None if rows else "no rows"))
    return report
