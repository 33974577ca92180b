"""Queries on bars and their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import symbols as sym
from barloom.plans.registry import WEEK, events_sql, query, r, rounded, shown
from barloom.sources import bars as src

OHLCV = ("open", "high", "low", "close", "volume", "amount")
_SHOW = ", ".join(f"{r(c)} AS {c}" for c in OHLCV)


@query("bars_brand_week", f"WITH {WEEK} SELECT symbol, date, {_SHOW} FROM bars")
def bars_brand_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(src.brand_week_bars(spark, sf_dir), *OHLCV)


@query("bars_event_hour", f"WITH {events_sql()} SELECT symbol, date, {_SHOW} FROM bars")
def bars_event_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(src.event_bars(spark, sf_dir), *OHLCV)


@query("bars_user_day", f"WITH {events_sql('user_id', 'day')} SELECT symbol, date, {_SHOW} FROM bars")
def bars_user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(src.event_bars(spark, sf_dir, "user_id", "day"), *OHLCV)


def _raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as badly made bars: text prices, several for one day, highs under closes, prices that are none."""
    lines = src.table(spark, sf_dir, "lineitem")
    close = F.when(F.col("l_linenumber") == 3, "n/a").when(F.col("l_linenumber") == 4, "-1").otherwise(F.col("l_extendedprice").cast("string"))
    return lines.select(
        (F.col("l_partkey") % 50).cast("string").alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_discount").cast("string").alias("open"),
        F.col("l_tax").cast("string").alias("high"),
        F.col("l_quantity").cast("string").alias("low"),
        close.alias("close"),
        F.col("l_quantity").cast("string").alias("volume"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("arrival"),
    )


@query(
    "norm_bars",
    """
WITH raw AS (
  SELECT CAST(l_partkey % 50 AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, l_discount AS open, l_tax AS high, l_quantity AS low, l_quantity AS volume,
         CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN -1 ELSE l_extendedprice END AS close,
         row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS arrival
  FROM lineitem)
SELECT symbol, date, round(open, 6) AS open, round(greatest(high, open, close), 6) AS high, round(least(low, open, close), 6) AS low, round(close, 6) AS close, volume
FROM raw QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY arrival DESC) = 1 AND close > 0
""",
)
def norm_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = src.normalise(_raw_ticks(spark, sf_dir))
    return found.select("symbol", "date", F.round("open", 6).alias("open"), F.round("high", 6).alias("high"), F.round("low", 6).alias("low"), F.round("close", 6).alias("close"), "volume")


@query(
    "gap_ffill_calendar",
    f"""
WITH {events_sql("user_id", "day")},
grid AS (SELECT * FROM (SELECT DISTINCT symbol FROM bars) CROSS JOIN (SELECT DISTINCT date FROM bars))
SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close,
       coalesce(volume, 0) AS volume, close IS NOT NULL AS traded
FROM grid LEFT JOIN bars USING (symbol, date)
""",
)
def gap_ffill_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.on_calendar(src.event_bars(spark, sf_dir, "user_id", "day"))


@query(
    "snapshot_latest",
    f"""
WITH {WEEK},
last AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close FROM bars)
SELECT symbol, date, {r("close")} AS close, {r("prev_close")} AS prev_close, {r("100 * (close / prev_close - 1)")} AS change_pct
FROM last QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1
""",
)
def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(src.snapshot(src.brand_week_bars(spark, sf_dir)), "close", "prev_close", "change_pct")


@query(
    "scan_topn",
    f"""
WITH {WEEK},
last AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close FROM bars),
snap AS (SELECT *, 100 * (close / prev_close - 1) AS change_pct FROM last QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
SELECT symbol, {r("close")} AS close, {r("change_pct")} AS change_pct FROM snap
WHERE change_pct IS NOT NULL ORDER BY snap.change_pct DESC, symbol LIMIT 10
""",
)
def scan_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(src.scan_top(src.snapshot(src.brand_week_bars(spark, sf_dir)), "no such column", 10), "close", "change_pct", keys=("symbol",))


@query(
    "cache_upsert",
    f"""
WITH {events_sql("user_id", "day")},
new AS (SELECT symbol, date, open, high, low, close * 2 AS close, volume, amount FROM bars WHERE day(date) > 15
        UNION ALL SELECT 'new' || symbol, date, open, high, low, close, volume, amount FROM bars WHERE day(date) = 1)
SELECT symbol, date, {r("close")} AS close, volume FROM new
UNION ALL SELECT symbol, date, {r("close")} AS close, volume FROM bars WHERE (symbol, date) NOT IN (SELECT (symbol, date) FROM new)
""",
)
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = src.event_bars(spark, sf_dir, "user_id", "day")
    revised = stored.filter(F.dayofmonth("date") > 15).withColumn("close", F.col("close") * 2)
    fresh = stored.filter(F.dayofmonth("date") == 1).withColumn("symbol", F.concat(F.lit("new"), "symbol"))
    return src.upsert(stored, revised.unionByName(fresh)).select("symbol", "date", rounded("close").alias("close"), "volume")


@query("cache_stats", f"WITH {events_sql('user_id', 'day')} SELECT symbol, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY symbol")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.coverage(src.event_bars(spark, sf_dir, "user_id", "day"))


@query(
    "failover_ranked",
    f"""
WITH {WEEK},
sources(source, health, priority) AS (VALUES ('alpha', 2, 1), ('beta', 0, 3), ('gamma', 0, 2), ('delta', 1, 0)),
offered AS (
  SELECT symbol, date, close, source, health, priority FROM bars CROSS JOIN sources
  WHERE CASE source WHEN 'alpha' THEN true WHEN 'beta' THEN day(date) % 2 = 0 WHEN 'gamma' THEN day(date) % 3 = 0 ELSE day(date) % 5 = 0 END)
SELECT symbol, date, {r("close")} AS close, source FROM offered
QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY CASE WHEN source = 'delta' THEN 0 ELSE 1 END, health, priority, source) = 1
""",
)
def failover_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = src.brand_week_bars(spark, sf_dir)
    day = F.dayofmonth("date")
    offers = [("alpha", 2, 1, F.lit(True)), ("beta", 0, 3, day % 2 == 0), ("gamma", 0, 2, day % 3 == 0), ("delta", 1, 0, day % 5 == 0)]
    rows = F.array_compact(F.array(*(F.when(has, F.struct(F.lit(n).alias("source"), F.lit(h).alias("health"), F.lit(p).alias("priority"))) for n, h, p, has in offers)))
    offered = bars.select("symbol", "date", "close", F.inline(rows))
    return src.first_available(offered, ("delta",)).select("symbol", "date", rounded("close").alias("close"), "source")


SPELLINGS = ["600519.sh", " 600519 ", "000001", "920001", "830001", "430001", "300750", "688001", "900901", "700", "00700", "0700.HK", "9988.hk", "AAPL", "aapl.us", "SH600519", "sz000001", "BJ920000", "btc-usdt", "ETH-USDC", "'600036'", '"000002"', "BRK-B", "510300", "159915", "1.HK"]


@query(
    "symbol_normalize",
    "WITH given AS (SELECT unnest(["
    + ", ".join("'" + s.replace("'", "''") + "'" for s in SPELLINGS)
    + """]) AS raw), keys AS (SELECT raw, p_partkey, upper(trim(trim(trim(raw), '"'), '''')) AS s FROM given CROSS JOIN part),
named AS (
SELECT raw, p_partkey AS k, CASE
  WHEN regexp_matches(s, '^[A-Z0-9]+-[A-Z0-9]+$') THEN s
  WHEN length(s) = 8 AND s[1:2] IN ('SH', 'SZ', 'BJ') AND regexp_matches(s[3:], '^[0-9]+$') THEN s[3:] || '.' || s[1:2]
  WHEN s LIKE '%.HK' AND regexp_matches(s, '^[0-9]+[.]HK$') THEN lpad(replace(s, '.HK', ''), greatest(5, length(s) - 3)::INT, '0') || '.HK'
  WHEN contains(s, '.') THEN s
  WHEN regexp_matches(s, '^[0-9]{6}$') THEN s || CASE WHEN s LIKE '92%' OR s[1] IN ('4', '8') THEN '.BJ' WHEN s[1] IN ('0', '3') THEN '.SZ' ELSE '.SH' END
  WHEN regexp_matches(s, '^[0-9]{1,5}$') THEN lpad(s, 5, '0') || '.HK'
  WHEN regexp_matches(s, '^[A-Z][A-Z-]{0,6}$') THEN s || '.US'
  ELSE s END AS symbol FROM keys)
SELECT raw, k, symbol, split_part(symbol, '.', 1) AS code, CASE
  WHEN regexp_matches(symbol, '^[0-9]{6}[.](SH|SZ|BJ)$') THEN 'A' WHEN regexp_matches(symbol, '^[0-9]{4,5}[.]HK$') THEN 'HK'
  WHEN regexp_matches(symbol, '^[A-Z.]+[.](US|NY|NQ)$') THEN 'US' WHEN regexp_matches(symbol, '^[A-Z0-9]+-[A-Z0-9]+$') THEN 'CRYPTO' END AS market FROM named
""",
)
def symbol_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    given = parts.withColumn("raw", F.explode(F.array(*map(F.lit, SPELLINGS))))
    named = given.withColumn("symbol", sym.normalise_symbol(F.col("raw")))
    return named.select("raw", "k", "symbol", sym.bare_code(F.col("symbol")).alias("code"), sym.market_of(F.col("symbol")).alias("market"))
