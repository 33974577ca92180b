"""Bars out of the stored tables, and what every bar source goes through.

A bar has symbol, date, open, high, low, close, volume and amount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.panel import ffill

BAR = ("open", "high", "low", "close", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _aggregate(ticks: DataFrame, order: Column, amount_scale: int) -> DataFrame:
    """ticks: symbol, date, price, volume, amount; first and last price by ``order``; amounts are summed exactly."""
    return ticks.groupBy("symbol", "date").agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("volume").cast("double").alias("volume"),
        F.sum(F.col("amount").cast(f"decimal(18,{amount_scale})")).cast("double").alias("amount"),
    )


def brand_week_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of unit prices by brand: a panel of 25 symbols."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    ticks = lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("p_brand").alias("symbol"),
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.col("l_extendedprice").alias("amount"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("at"),
    )
    return _aggregate(ticks, F.col("at"), 2)


def event_bars(spark: SparkSession, sf_dir: str, by: str = "event_type", unit: str = "hour") -> DataFrame:
    """Bars of event values by type or user and hour or day."""
    date = F.to_date("ts") if unit == "day" else F.date_trunc(unit, "ts").cast("timestamp_ntz")
    ticks = table(spark, sf_dir, "events").select(F.col(by).cast("string").alias("symbol"), date.alias("date"), F.col("value").alias("price"), F.lit(1).alias("volume"), F.col("value").alias("amount"), F.struct("ts", "event_id").alias("at"))
    return _aggregate(ticks, F.col("at"), 6)


def normalise(raw: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Bars as every reader hands them on.

    Columns are parsed as doubles; of rows of one symbol and date the last to
    arrive stays; rows without a positive close go; high and low are widened so
    that they bound open and close (a missing one counts as the close).
    """
    missing = [c for c in BAR if c not in raw.columns]
    if missing:
        raise ValueError(f"bars lack {', '.join(missing)}")
    parsed = raw.withColumns({c: F.col(c).try_cast("double") for c in BAR})
    newest = Window.partitionBy("symbol", "date").orderBy(F.col(arrival).desc())
    kept = parsed.withColumn("__turn", F.row_number().over(newest)).filter((F.col("__turn") == 1) & (F.col("close") > 0))
    return kept.select("symbol", "date", "open", F.greatest("high", "open", "close").alias("high"), F.least("low", "open", "close").alias("low"), "close", "volume")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Bars after ``new`` was written over ``stored``: last write wins by (symbol, date)."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    newest = Window.partitionBy("symbol", "date").orderBy(F.col("__new").desc())
    return both.withColumn("__turn", F.row_number().over(newest)).filter("__turn = 1").drop("__turn", "__new")


def coverage(bars: DataFrame) -> DataFrame:
    """What is stored of each symbol: rows, first and last date."""
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def on_calendar(bars: DataFrame) -> DataFrame:
    """Every symbol on the union of all dates; gaps carry the last close, volume 0 (``traded`` tells them apart)."""
    grid = bars.select("date").distinct().crossJoin(bars.select("symbol").distinct())
    joined = grid.join(bars, ["symbol", "date"], "left").withColumn("traded", F.col("close").isNotNull())
    return joined.select("symbol", "date", ffill("close").alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"), "traded")


def snapshot(bars: DataFrame) -> DataFrame:
    """The latest bar of each symbol with its change since the one before."""
    newest = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    ranked = bars.withColumn("__turn", F.row_number().over(newest)).withColumn("prev_close", F.lead("close").over(newest)).filter("__turn = 1").drop("__turn")
    return ranked.withColumn("change_pct", 100 * (F.try_divide("close", "prev_close") - 1))


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    return bars.withColumn("__turn", F.row_number().over(newest)).filter(F.col("__turn") <= n).drop("__turn")


def scan_top(snapshots: DataFrame, sort_by: str = "change_pct", n: int = 30) -> DataFrame:
    """The market table: rows with a close and a change, by ``sort_by`` (change_pct where it is unknown) downwards, first n; ties by symbol."""
    key = sort_by if sort_by in snapshots.columns else "change_pct"
    return snapshots.dropna(subset=["close", "change_pct"]).orderBy(F.col(key).desc_nulls_last(), "symbol").limit(n)


def first_available(candidates: DataFrame, prefer: tuple[str, ...] = ()) -> DataFrame:
    """Failover as a ranked merge: of the sources' rows for one (symbol, date) that of the best source stays.

    candidates: symbol, date, source, health (0 well, 1 untried, 2 failed), priority, ...  Sources in
    ``prefer`` come first, in its order; then health, priority and name decide.
    """
    wish = F.coalesce(*(F.when(F.col("source") == s, i) for i, s in enumerate(prefer)), F.lit(len(prefer)))
    best = Window.partitionBy("symbol", "date").orderBy(wish, "health", "priority", "source")
    return candidates.withColumn("__turn", F.row_number().over(best)).filter("__turn = 1").drop("__turn")
