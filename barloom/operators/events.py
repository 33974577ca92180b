"""Factors out of dated events: what was last published, what comes next, how much is coming.

bars: symbol, date, ...; events: symbol, a date and a value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.panel import div, ffill, lag, so_far


def align_events(bars: DataFrame, events: DataFrame, value: str = "value", published: str = "publish_date", limit: int | None = None, name: str = "aligned") -> DataFrame:
    """``name``: the value of the latest event published by the bar's date, null after it has stood for ``limit`` bars more than one.

    A union, a window and a filter: no range join.  Of events published on one
    day the largest in the order of its value, null first, counts last.
    """
    told = events.filter(F.col(published).isNotNull()).select("symbol", F.col(published).cast("date").alias("date"), F.struct(F.col(published).cast("date").alias("d"), F.col(value).cast("double").alias("v")).alias("__e"))
    seen = bars.withColumns({"__kind": F.lit(1), "__e": F.lit(None).cast("struct<d:date,v:double>")})
    both = seen.unionByName(told.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy("date", "__kind", "__e.v").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__e", F.last("__e", ignorenulls=True).over(order)).filter("__kind = 1")
    result = F.col("__e.v")
    if limit is not None:
        age = F.row_number().over(Window.partitionBy("symbol", "__e.d").orderBy("date")) - 1
        result = F.when(age <= limit, result)
    return out.withColumn(name, result).select(*bars.columns, name)


def days_to_event(bars: DataFrame, events: DataFrame, date: str = "date", most: int = 120, name: str = "days_to_event") -> DataFrame:
    """Calendar days to the next event on or after the bar's date, null beyond ``most``."""
    told = events.filter(F.col(date).isNotNull()).select("symbol", F.col(date).cast("date").alias("date")).withColumns({"__kind": F.lit(1), "__next": F.col("date")})
    both = bars.withColumns({"__kind": F.lit(0), "__next": F.lit(None).cast("date")}).unionByName(told, allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy("date", "__kind").rowsBetween(0, Window.unboundedFollowing)
    gap = F.datediff(F.first("__next", ignorenulls=True).over(order), F.col("date")).cast("double")
    out = both.withColumn("__gap", gap).filter("__kind = 0")
    return out.withColumn(name, F.when(F.col("__gap") <= most, F.col("__gap"))).select(*bars.columns, name)


def event_pressure(bars: DataFrame, events: DataFrame, date: str = "date", ratio: str | None = "ratio", window: int = 60, decay: float = 30.0, name: str = "event_pressure") -> DataFrame:
    """The ratios (1 where there is no such column) of the events of the next ``window`` days, each times exp(-days / decay).

    A range join on the symbol; both sides carry the number of their period of
    ``window`` days, so a bar meets the events of two periods only.
    """
    size = F.col(ratio) if ratio and ratio in events.columns else F.lit(1.0)
    period = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / (window + 1))
    told = events.filter(F.col(date).isNotNull()).groupBy("symbol", F.col(date).cast("date").alias("__d")).agg(F.sum(F.coalesce(size.cast("double"), F.lit(0.0))).alias("__r"))
    told = told.withColumn("__p", period(F.col("__d"))).withColumnRenamed("symbol", "__s")
    asked = bars.select("symbol", "date").distinct().withColumn("__own", period(F.col("date")))
    asked = asked.withColumn("__p", F.explode(F.array(F.col("__own"), F.col("__own") + 1))).drop("__own")
    gap = F.datediff("__d", "date")
    met = asked.join(told, (asked.symbol == told["__s"]) & (asked["__p"] == told["__p"]) & (gap >= 0) & (gap <= window))
    sums = met.groupBy("symbol", "date").agg(F.sum(F.col("__r") * F.exp(-gap / decay)).alias(name))
    return bars.join(sums, ["symbol", "date"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def holder_change(bars: DataFrame, events: DataFrame, value: str = "holders", published: str = "publish_date", limit: int = 90, name: str = "holder_change") -> DataFrame:
    """Minus the relative change from one value to the next new one; a value seen before is not new; stays until the next."""
    out = align_events(bars, events, value, published, limit, "__v")
    first = F.row_number().over(Window.partitionBy("symbol", "__v").orderBy("date")) == 1
    out = out.withColumn("__new", F.when(first, F.col("__v")))
    out = out.withColumn("__old", F.last("__new", ignorenulls=True).over(so_far().rowsBetween(Window.unboundedPreceding, -1)))
    change = F.when(F.col("__new").isNotNull(), -(div(F.col("__new"), F.col("__old")) - 1))
    return out.withColumn("__c", change).withColumn(name, ffill("__c")).select(*bars.columns, name)


def balance_momentum(bars: DataFrame, events: DataFrame, value: str, published: str = "publish_date", window: int = 20, name: str = "balance_momentum") -> DataFrame:
    """(x - x before ``window`` bars) over the latter's size; null for symbols with ``window`` values or fewer."""
    out = align_events(bars, events, value, published, None, "__v")
    enough = F.count("__v").over(Window.partitionBy("symbol")) > window
    base = lag("__v", window)
    return out.withColumn(name, F.when(enough, div(F.col("__v") - base, F.abs(base)))).select(*bars.columns, name)


#: Heads under which tables of whole markets name a security (fixed by the formats).
CODES = ("代码", "股票代码", "证券代码")


def picked(table: DataFrame, dates: tuple[str, ...], values: tuple[str, ...], published: str = "publish_date", value: str = "value", codes: tuple[str, ...] = CODES) -> DataFrame:
    """symbol, ``published`` and ``value`` of a table whose columns go by one of several names.

    The first name that the table has counts; codes are filled up to six digits,
    texts that are no date or number go.  A table that lacks one of the three
    gives no rows.
    """
    found = [next((n for n in names if n in table.columns), None) for names in (codes, dates, values)]
    if None in found:
        return table.sparkSession.createDataFrame([], f"symbol string, {published} date, {value} double")
    code, day, number = (F.col(f"`{n}`") for n in found)
    text = code.cast("string")
    out = table.select(F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text).alias("symbol"), F.coalesce(day.try_cast("date"), F.to_date(F.try_to_timestamp(day.cast("string"), F.lit("yyyyMMdd")))).alias(published), number.try_cast("double").alias(value))
    return out.dropna()
