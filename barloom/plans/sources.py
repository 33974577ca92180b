"""Queries on recorded replies, connectors and column files; what they read is made of the tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.lineage import shared_folder
from barloom.operators import minutes
from barloom.plans.registry import WEEK, events_sql, full, lagged, query, r, rounded, shown
from barloom.sources import columns, connectors, lists, replies
from barloom.sources.bars import brand_week_bars, event_bars


def _shared(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_NUM = "substr(symbol, 7)"  # Brand#12: 12
_LAST = "lb AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"


def _text(x: Column | str, digits: int = 4) -> Column:
    return rounded(x, digits).cast("string")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bar of each symbol as a list of each of three services writes it, one list a service and one that is broken."""
    from barloom.sources.bars import snapshot

    last = snapshot(brand_week_bars(spark, sf_dir)).withColumns({"n": F.substring("symbol", 7, 9), **{c: rounded(c, 4) for c in ("open", "high", "low", "close", "prev_close", "change_pct")}})
    stock = F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(F.struct(F.lpad("n", 5, "0").alias("f12"), F.col("symbol").alias("f14"), F.col("close").alias("f2"), F.col("change_pct").alias("f3"), F.col("volume").alias("f5"), F.round("amount", 2).alias("f6"), F.col("high").alias("f15"), F.col("low").alias("f16"), F.col("open").alias("f17"), F.col("prev_close").alias("f18")))).alias("diff")).alias("data")))
    coin = F.to_json(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("B"), "n", F.when(F.col("n").cast("int") % 5 == 0, "EUR").otherwise("USDT")).alias("symbol"), _text("close").alias("lastPrice"), _text("change_pct").alias("priceChangePercent"), F.col("volume").cast("string").alias("volume"), F.round("amount", 2).cast("string").alias("quoteVolume"), _text("high").alias("highPrice"), _text("low").alias("lowPrice"), _text("open").alias("openPrice"), _text("prev_close").alias("prevClosePrice")))))
    pair = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("C"), "n", F.lit("/USDT")), F.struct(F.col("close").alias("last"), F.when(F.col("n").cast("int") % 7 > 0, F.col("change_pct")).alias("percentage"), F.col("volume").alias("baseVolume"), "high", "low", "open", F.col("prev_close").alias("previousClose"))))))
    row = lambda source, market, body: F.struct(F.lit(source).alias("source"), F.lit(market).alias("market"), body.alias("body"))
    made = last.agg(F.array(row("eastmoney", "HK", stock), row("binance", "CRYPTO", coin), row("okx", "CRYPTO", pair), row("binance", "CRYPTO", F.lit("{broken"))).alias("x"))
    return made.select(F.inline("x"))


_SHOWN = ("close", "change_pct", "amount", "high", "low", "open", "prev_close")


@query(
    "spot_lists",
    f"""WITH {WEEK}, {_LAST}, v AS (SELECT {_NUM} AS n, symbol AS s, volume, round(amount, 2) AS amount, {", ".join(f"{r(c, 4)} AS {c}" for c in ("open", "high", "low", "close"))}, {r("pc", 4)} AS prev_close, {r("100 * (close / pc - 1)", 4)} AS change_pct FROM lb),
l AS (SELECT 'eastmoney' AS source, lpad(n, 5, '0') || '.HK' AS symbol, s AS name, row_number() OVER (ORDER BY lpad(n, 5, '0')) AS place, * EXCLUDE (n, s) FROM v
UNION ALL SELECT 'binance', 'B' || n || '-USDT', 'B' || n, row_number() OVER (ORDER BY amount DESC), * EXCLUDE (n, s) FROM v WHERE n::INT % 5 <> 0
UNION ALL SELECT 'okx', 'C' || n || '-USDT', 'C' || n, row_number() OVER (ORDER BY close * volume DESC), * EXCLUDE (n, s) REPLACE (close * volume AS amount) FROM v WHERE n::INT % 7 > 0)
SELECT source, symbol, name, CAST(place AS INT) AS place, volume, {", ".join(f"{r(c, 3)} AS {c}" for c in _SHOWN)}, CAST(NULL AS VARCHAR) AS fault FROM l WHERE place <= 15
UNION ALL SELECT 'binance', NULL, NULL, NULL, NULL, {", ".join("NULL" for _ in _SHOWN)}, 'not json'""",
)
def spot_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 of lists in three shapes, parsed in one pass; a broken list keeps a row."""
    found = replies.spots(_listed(spark, sf_dir), top=15)
    return found.select("source", "symbol", "name", "place", "volume", *(rounded(c, 3).alias(c) for c in _SHOWN), "fault")


@query("history_replies", f"WITH {WEEK}, s AS (SELECT *, CASE {_NUM}::INT % 5 WHEN 0 THEN 'eastmoney' WHEN 1 THEN 'binance' WHEN 2 THEN 'sina' WHEN 3 THEN 'yahoo' ELSE 'netease' END AS source FROM bars) SELECT source, symbol, date, {r('open', 3)} AS open, {r('high', 3)} AS high, {r('low', 3)} AS low, {r('close', 3)} AS close, volume, CAST(NULL AS VARCHAR) AS fault FROM s UNION ALL SELECT 'netease', 'Brand#0', NULL, NULL, NULL, NULL, NULL, NULL, 'a page, not data'")
def history_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol's bars as one of five services writes them, parsed in one pass."""
    bars = brand_week_bars(spark, sf_dir).withColumn("at", F.unix_timestamp(F.col("date").cast("timestamp")))
    each = bars.withColumn("k", F.substring("symbol", 7, 9).cast("int") % 5)
    day = F.col("date").cast("string")
    text = {c: F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")}
    rows = F.array_sort(F.collect_list(F.struct("date", "at", *text)))
    grouped = each.groupBy("symbol", "k").agg(
        F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(F.concat_ws(",", day, *(text[c] for c in ("open", "close", "high", "low", "volume"))))).alias("klines")).alias("data"))).alias("b0"),
        F.to_json(F.array_sort(F.collect_list(F.array((F.col("at") * 1000).cast("string"), *text.values())))).alias("b1"),
        F.to_json(F.array_sort(F.collect_list(F.struct(day.alias("day"), *(v.alias(c) for c, v in text.items()))))).alias("b2"),
        rows.alias("x"),
        F.array_join(F.array_append(F.array_sort(F.collect_list(F.concat_ws(",", day, *(text[c] for c in ("close", "high", "low", "open", "volume"))))), F.lit("")), "\n").alias("b4"),
    )
    numbers = lambda c: F.transform("x", lambda e: e[c].cast("double")).alias(c)
    quote = F.struct(*map(numbers, text))
    chart = F.to_json(F.struct(F.struct(F.array(F.struct(F.transform("x", lambda e: e["at"]).alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))).alias("result")).alias("chart")))
    body = F.when(F.col("k") == 0, F.col("b0")).when(F.col("k") == 1, F.col("b1")).when(F.col("k") == 2, F.col("b2")).when(F.col("k") == 3, chart).otherwise(F.concat(F.lit("日期,收盘价,最高价,最低价,开盘价,成交量\n"), "b4"))
    source = F.element_at(F.array(*map(F.lit, ("eastmoney", "binance", "sina", "yahoo", "netease"))), F.col("k") + 1)
    got = grouped.select(source.alias("source"), F.lit("A").alias("market"), "symbol", F.encode(body, "UTF-8").alias("body"))

    @F.pandas_udf("binary")
    def gbk(source: pd.Series, body: pd.Series) -> pd.Series:
        """The CSV comes in GBK, which Spark's own encode() does not write."""
        return source.combine(body, lambda s, b: bytes(b).decode().encode("gbk") if s == "netease" else bytes(b))

    broken = spark.createDataFrame([("netease", "A", "Brand#0", b"<html>none</html>")], got.schema)
    parsed = replies.histories(got.withColumn("body", gbk("source", "body")).unionByName(broken))
    return parsed.select("source", "symbol", "date", *(rounded(c, 3).alias(c) for c in ("open", "high", "low", "close")), "volume", "fault")


@query(
    "connector_failover",
    f"""WITH {WEEK}, n AS (SELECT symbol || '.US' AS symbol, * EXCLUDE (symbol), {_NUM}::INT AS n FROM bars WHERE date >= DATE '1998-01-01')
SELECT 'US' AS market, symbol, date, {r("close", 4)} AS close, CASE WHEN n % 3 > 0 THEN 'main' ELSE 'backup' END AS source, CAST(NULL AS VARCHAR) AS fault FROM n WHERE n % 3 > 0 OR n % 2 = 0
UNION ALL SELECT 'US', symbol, NULL, NULL, s, 'ConnectionError: refused' FROM (SELECT DISTINCT symbol FROM n WHERE n % 3 = 0 AND n % 2 > 0), (VALUES ('down')) d(s)""",
)
def connector_failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols through the format: the first connector is down, the second has two thirds, the third half of them; who has none keeps the reasons."""
    bars = brand_week_bars(spark, sf_dir).withColumns({"n": F.substring("symbol", 7, 9).cast("int"), "symbol": F.concat("symbol", F.lit(".US"))})
    paths = {"main": _shared(spark, "main"), "backup": _shared(spark, "backup")}
    bars.filter("n % 3 > 0").drop("n").write.parquet(paths["main"])
    bars.filter("n % 2 = 0").drop("n").write.parquet(paths["backup"])

    def refused(*_):
        raise ConnectionError("refused")

    registry = connectors.Registry()
    registry.register(connectors.Connector("down", frozenset({"US"}), {"bars": refused}, 1))
    for k, (name, path) in enumerate(paths.items()):
        registry.register(connectors.parquet_connector(name, path, {"US"}, 10 + k))
    connectors.enable(spark, registry, "services")
    symbols = ",".join(f"Brand#{r.n}.US" for r in bars.select("n").distinct().collect())  # the names to ask for
    found = spark.read.format("services").option("symbols", symbols).load().filter("market = 'US' and (date >= date'1998-01-01' or date is null)")
    return found.select("market", "symbol", "date", rounded("close", 4).alias("close"), "source", "fault")


_GRID = """g AS (SELECT s.symbol, d.date, b.close, b.volume FROM (SELECT DISTINCT symbol FROM part) s CROSS JOIN (SELECT DISTINCT date FROM part) d LEFT JOIN part b ON b.symbol = s.symbol AND b.date = d.date),
f AS (SELECT symbol, date, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date), first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close,
  coalesce(last_value(volume IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date), first_value(volume IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS volume FROM g)"""


@query("column_files", f"WITH {WEEK}, part AS (SELECT * FROM bars), {_GRID} SELECT symbol, date, {r('CAST(CAST(close AS FLOAT) AS DOUBLE)', 3)} AS close, volume FROM f")
def column_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars written as column files, the last year appended, and read again."""
    bars = brand_week_bars(spark, sf_dir).select("symbol", "date", "close", "volume")
    folder = _shared(spark, "columns")
    early, late = bars.filter("date < date'2001-01-01'"), bars.filter("date >= date'2001-01-01'")
    columns.write_columns(early, folder, ("close", "volume"))
    columns.write_columns(late, folder, ("close", "volume"), append=True)
    found = columns.read_columns(spark, folder, ("close", "volume"))
    return found.select("symbol", "date", rounded("close", 3).alias("close"), "volume")


@query("column_instruments", f"WITH {WEEK}, d AS (SELECT min(date) AS a, max(date) AS b FROM bars) SELECT DISTINCT symbol, a AS first_date, b AS last_date FROM bars, d")
def column_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last dates of the instruments, as their files tell."""
    folder = _shared(spark, "columns")
    columns.write_columns(brand_week_bars(spark, sf_dir).select("symbol", "date", "close"), folder, ("close",))
    return columns.instruments(spark, folder)


_SECONDS = "CASE p_partkey % 6 WHEN 0 THEN lpad(((p_partkey * 7919) % 1000000)::VARCHAR, 6, '0') WHEN 1 THEN lpad(((p_partkey * 31) % 100000)::VARCHAR, 5, '0') WHEN 2 THEN chr(65 + (p_partkey % 26)::INT) || chr(65 + (p_partkey % 7)::INT) WHEN 3 THEN 'SZ' || lpad((p_partkey % 500)::VARCHAR, 6, '0') WHEN 4 THEN '' ELSE 'x' || p_partkey END"


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' keys as lines of an exported list."""
    key = F.col("p_partkey")
    digits = lambda x, n: F.lpad(x.cast("string"), n, "0")
    code = F.when(key % 6 == 0, digits(key * 7919 % 1_000_000, 6)).when(key % 6 == 1, digits(key * 31 % 100_000, 5)).when(key % 6 == 2, F.concat(F.char(65 + key % 26), F.char(65 + key % 7))).when(key % 6 == 3, F.concat(F.lit("SZ"), digits(key % 500, 6))).when(key % 6 == 4, "").otherwise(F.concat(F.lit("x"), key.cast("string")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(code, F.when(code != "", "\t1.0").otherwise("")).alias("value"), key)


_CLASS = f"""e AS (SELECT row_number() OVER (ORDER BY p_partkey) AS place, {_SECONDS} AS code FROM part),
c AS (SELECT place, nullif(code, '') AS code, CASE WHEN regexp_matches(code, '^(SH|SZ|BJ)') THEN substr(code, 3) || '.' || substr(code, 1, 2) WHEN regexp_matches(code, '^[0-9]{{6}}$') THEN code || CASE WHEN code[1] IN ('6', '9') THEN '.SH' WHEN code[1] IN ('0', '3') THEN '.SZ' WHEN code[1] IN ('4', '8') THEN '.BJ' END
  WHEN regexp_matches(code, '^[0-9]{{5}}$') THEN code || '.HK' WHEN regexp_matches(code, '^[A-Z]{{1,5}}$') THEN code || '.US' END AS symbol FROM e)"""


@query(
    "list_import",
    f"""WITH {_CLASS} SELECT CAST(place AS INT) AS place, code, symbol, CASE WHEN symbol LIKE '%.HK' THEN 'HK' WHEN symbol LIKE '%.US' THEN 'US' WHEN symbol IS NOT NULL THEN 'A' END AS market,
  CASE WHEN code IS NULL THEN 'blank' WHEN symbol IS NULL AND regexp_matches(code, '^[0-9]{{6}}$') THEN 'no such board' WHEN symbol IS NULL THEN 'not a symbol' END AS reason FROM c""",
)
def list_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list made of the parts' keys as files: symbols, and the lines that are none with the reason."""
    return lists.classified(_imported(spark, sf_dir))


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list as text files in the order of the keys, read again line by line."""
    folder = _shared(spark, "list")
    _exported(spark, sf_dir).repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").select("value").write.text(folder)
    return lists.file_lines(spark, f"{folder}/*.txt")


@query(
    "resolve_symbols",
    f"""WITH {_CLASS}, l AS (SELECT 0 AS source, place, symbol FROM c WHERE symbol IS NOT NULL
UNION ALL SELECT 1, c_custkey, lpad((c_custkey % 900)::VARCHAR, 5, '0') || '.HK' FROM customer UNION ALL SELECT 2, s_suppkey, chr(65 + (s_suppkey % 26)::INT) || 'A.US' FROM supplier)
SELECT symbol, min(row(source, place))[1] AS source, CAST(min(row(source, place))[2] AS BIGINT) AS place FROM l GROUP BY symbol""",
)
def resolve_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An imported list, a watch list of customers and a book of suppliers, each symbol where it comes first."""
    watched = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("place"), F.concat(F.lpad((F.col("c_custkey") % 900).cast("string"), 5, "0"), F.lit(".HK")).alias("symbol"))
    held = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("place"), F.concat(F.char(65 + F.col("s_suppkey") % 26), F.lit("A.US")).alias("symbol"))
    return lists.united(lists.classified(_imported(spark, sf_dir)), watched, held).select("symbol", "source", "place")


_MIN = ("ret1", "ret30", "close_ma5", "ma30", "ma_cross", "bb_upper", "bb_width", "atr", "volatility10", "vma30", "v_ratio", "rsi14", "hl_ratio", "co_ratio", "up_shadow", "body")
_MTR = f"greatest(high - low, abs(high - {lagged('close')}), abs(low - {lagged('close')}))"
_MSD, _M10 = full(10, "stddev_samp(close)", "close"), full(10, "avg(close)", "close")


@query(
    "minute_features",
    f"""WITH {events_sql("event_type", "hour")}, a AS (SELECT *, {_MTR} AS tr, close / {lagged("close")} - 1 AS ret1, coalesce(greatest(close - {lagged("close")}, 0), 0) AS gain, coalesce(greatest({lagged("close")} - close, 0), 0) AS loss, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM bars),
f AS (SELECT symbol, date, n, ret1, close / {lagged("close", 30)} - 1 AS ret30, close / {full(5, "avg(close)", "close")} AS close_ma5, {full(30, "avg(close)", "close")} AS ma30, {full(5, "avg(close)", "close")} - {_M10} AS ma_cross, ({_M10} + 2 * {_MSD}) / close - 1 AS bb_upper, (4 * {_MSD} / close) / ({_M10} / close + 1) AS bb_width,
  {full(10, "avg(tr)", "tr")} / close AS atr, {full(10, "stddev_samp(ret1)", "ret1")} * sqrt(10::DOUBLE) AS volatility10, {full(30, "avg(volume)", "volume")} AS vma30, volume / {full(5, "avg(volume)", "volume")} AS v_ratio,
  100 - 100 / (1 + {full(14, "avg(gain)", "gain")} / ({full(14, "avg(loss)", "loss")} + 1e-10::DOUBLE)) AS rsi14, (high - low) / close AS hl_ratio, (close - open) / (high - low + 1e-10::DOUBLE) AS co_ratio, (high - close) / (close - low + 1e-10::DOUBLE) AS up_shadow, abs(close - open) / (high - low + 1e-10::DOUBLE) AS body,
  CASE WHEN stddev_pop(volume) OVER w * stddev_pop(close) OVER w > 0 THEN 1 END AS both_move FROM a WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT symbol, date, {", ".join(f"{r(c, 4)} AS {c}" for c in _MIN)} FROM f WHERE n > 30 AND both_move IS NOT NULL""",
)
def minute_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of intraday bars of the events (hours, which is how dense the events are)."""
    return shown(minutes.minute_features(event_bars(spark, sf_dir)), *_MIN, digits=4)


@query(
    "minute_ensemble",
    """WITH q AS (SELECT event_type || '.HK' AS symbol, CAST(ts AS DATE) AS date, ts, event_id, value FROM events), d AS (SELECT symbol, date, avg(value) AS score FROM q GROUP BY 1, 2),
m1 AS (SELECT symbol, date, arg_max(value, row(ts, event_id)) AS score1 FROM q WHERE event_id % 2 = 0 GROUP BY 1, 2), m2 AS (SELECT symbol, date, arg_max(value / 2, row(ts, event_id)) AS score2 FROM q WHERE event_id % 5 = 0 GROUP BY 1, 2)
SELECT symbol, """ + r("(score * 0.5::DOUBLE + coalesce(score1, 0) * 0.3::DOUBLE + coalesce(score2, 0) * 0.2::DOUBLE) / (0.5::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE)", 5) + " AS score FROM d LEFT JOIN m1 USING (symbol, date) LEFT JOIN m2 USING (symbol, date) WHERE date = (SELECT max(date) FROM d)",
)
def minute_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by day with the last ones of two frequencies of that day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("symbol", F.concat("event_type", F.lit(".HK")))
    daily = events.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.avg("value").alias("score"))
    often = lambda n, scale: events.filter(F.col("event_id") % n == 0).select("symbol", F.struct("ts", "event_id").alias("at"), "ts", (F.col("value") / scale).alias("score"))
    aligned = minutes.day_scores(daily, often(2, 1), often(5, 2))
    return shown(minutes.ensemble_of_day(aligned, {"score": 0.5, "score1": 0.3, "score2": 0.2}), "score", keys=("symbol",), digits=5)
