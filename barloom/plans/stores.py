"""Queries on what a user keeps."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.lineage import cut, shared_folder
from barloom.operators import backtest as bt
from barloom.operators import signals as sig
from barloom.plans.backtests import METRICS, POSITIONS, TRADES, VECTOR
from barloom.plans.registry import WEEK, query, r, rounded
from barloom.plans.signals import EMA_CROSS
from barloom.sources import store
from barloom.sources.bars import brand_week_bars, coverage, snapshot, table

# the list: customers, tagged by segment and nation; those of the second half of the nations come later, some twice
_LISTED = "listed AS (SELECT c_name AS symbol, CAST(NULL AS VARCHAR) AS name, c_mktsegment || ', n' || c_nationkey AS tags FROM customer)"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col("c_name").alias("symbol"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("market"), F.concat("c_mktsegment", F.lit(", n"), F.col("c_nationkey").cast("string")).alias("tags"), F.col("c_nationkey").alias("added_at"))


@query(
    "watch_list",
    f"""WITH {_LISTED}, named AS (SELECT symbol, CASE WHEN tags LIKE '%, n3' THEN 'three' END AS name, tags FROM listed)
SELECT symbol, name, tags FROM named WHERE tags NOT LIKE 'MACHINERY%'""",
)
def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added in two parts that overlap, some named by key, some removed by key."""
    rows = _customers(spark, sf_dir)
    listed = store.watch(rows.filter("added_at < 15"), rows.filter("added_at > 10").withColumn("added_at", F.col("added_at")))
    listed = store.updated(listed, listed.filter("tags like '%, n3'").select("symbol", F.lit("three").alias("name")), "symbol")
    return store.removed(listed, rows.filter("tags like 'MACHINERY%'"), "symbol").select("symbol", "name", "tags")


@query("watch_by_tag", f"WITH {_LISTED} SELECT symbol, tags FROM listed WHERE list_contains(list_transform(string_split(tags, ','), lambda x: trim(x)), 'n7')")
def watch_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.tagged(_customers(spark, sf_dir), " n7").select("symbol", "tags")


@query(
    "watch_quotes",
    f"""WITH {WEEK}, last AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM bars),
snap AS (SELECT symbol, close, 100 * (close / pc - 1) AS change_pct FROM last QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
SELECT symbol, {r("close")} AS close, {r("change_pct")} AS change_pct, close IS NOT NULL AS ok FROM (SELECT DISTINCT p_brand AS symbol FROM part UNION SELECT 'Brand#none') LEFT JOIN snap USING (symbol)""",
)
def watch_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).union(spark.createDataFrame([("Brand#none",)], "symbol string")).distinct()
    out = store.listed_quotes(brands, snapshot(brand_week_bars(spark, sf_dir)))
    return out.select("symbol", rounded("close").alias("close"), rounded("change_pct").alias("change_pct"), "ok")


_META = "meta AS (SELECT symbol, min(date) AS first_date, max(date) AS last_date, CAST(max(date) AS TIMESTAMP) + to_hours(12) - to_minutes(60 * (CAST(regexp_extract(symbol, '[0-9]+') AS INT) % 9)) AS fetched_at FROM bars GROUP BY 1), ends AS (SELECT min(first_date) AS f, max(last_date) AS l FROM meta)"


@query("cache_fresh", f"WITH {WEEK}, {_META} SELECT symbol, fetched_at <= l + to_hours(12) AND fetched_at >= l + to_hours(6) AND first_date <= f + 7 AND l - last_date <= 4 AS fresh FROM meta, ends")
def cache_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was fetched up to nine hours ago, against the last noon that is stored."""
    meta = coverage(brand_week_bars(spark, sf_dir))
    hours = F.regexp_extract("symbol", "[0-9]+", 0).cast("int") % 9
    meta = meta.withColumn("fetched_at", F.timestamp_seconds(F.unix_date("last_date") * 86_400 + (12 - hours) * 3600))
    first, last = meta.agg(F.min("first_date"), F.max("last_date")).first()
    noon = dt.datetime.combine(last, dt.time(12), dt.timezone.utc)
    return meta.select("symbol", store.is_fresh(first + dt.timedelta(7), last, noon).alias("fresh"))


@query("cache_clear", f"WITH {WEEK} SELECT symbol, count(*) AS n_rows FROM bars WHERE symbol NOT IN ('Brand#1', 'Brand#2') GROUP BY 1")
def cache_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("Brand#1",), ("Brand#2",), (None,)], "symbol string")
    return coverage(store.removed(brand_week_bars(spark, sf_dir), gone, "symbol")).select("symbol", "n_rows")


@query(
    "runs_compared",
    f"""WITH RECURSIVE {WEEK}, {EMA_CROSS}, {VECTOR}, {TRADES}, {METRICS}, held AS (SELECT symbol, arg_max(close, date) / arg_min(close, date) - 1 AS total_return FROM bars GROUP BY 1),
both_runs AS (SELECT 'ema' AS run, symbol, total_return FROM met UNION ALL SELECT 'hold', symbol, total_return FROM held)
SELECT run, symbol, 'total_return' AS metric, {r("total_return")} AS value, row_number() OVER (PARTITION BY symbol ORDER BY total_return DESC, run) AS place FROM both_runs""",
)
def runs_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs saved, a third saved and removed, and the two compared by what is read back."""
    kept = store.RunStore(spark, f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}")
    # written once each: nine saved tables come from them
    bars = cut(brand_week_bars(spark, sf_dir))
    ema = cut(bt.vectorised(sig.ema_cross(bars)))
    trades = bt.trades_of(ema)
    hold = bars.groupBy("symbol").agg((F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")) - 1).alias("total_return"))
    named = lambda frame, at: frame.withColumn("created_at", F.lit(at).cast("timestamp"))
    kept.save("ema", named(bt.metrics(ema, trades).select("symbol", "total_return"), "2024-01-01"), ema, trades)
    kept.save("hold", named(hold, "2024-01-02"), bars, trades.limit(0))
    kept.save("gone", named(hold, "2024-01-03"), bars, trades.limit(0))
    kept.remove("gone")
    return store.compared(kept.runs(), "total_return").select("run", "symbol", "metric", rounded("value").alias("value"), "place")
