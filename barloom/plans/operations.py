"""Queries on the screener, the monitor, the briefing, the book and the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import journal as jn
from barloom.operators import screen as sc
from barloom.operators import signals as sig
from barloom.plans.registry import WEEK, full, lagged, prev, query, r, rounded, w
from barloom.plans.signals import EMA_CROSS, HELD
from barloom.plans.technical import MACD, rsi_sql
from barloom.sources.bars import brand_week_bars, snapshot, table

_SPIKE = f"volume / nullif({full(20, 'avg(volume)', 'volume', prev(20))}, 0) >= 2"
_CONDITIONS = {
    "above_ma": f"close > {full(20, 'avg(close)', 'close')}",
    "below_ma": f"close < {full(20, 'avg(close)', 'close')}",
    "volume_spike": _SPIKE,
    "near_high": f"close >= max(high) OVER {w(60)} * 0.97::DOUBLE",
    "near_low": f"close <= min(low) OVER {w(60)} * 1.03::DOUBLE",
    "breakout": f"close > {full(20, 'max(close)', 'close', prev(20))}",
    "pullback": f"close > {full(60, 'avg(close)', 'close')} AND abs(close / nullif({full(20, 'avg(close)', 'close')}, 0) - 1) <= 0.02",
    "squeeze": f"bw <= {full(60, 'quantile_cont(bw, 0.2)', 'bw', least=30)}",
}


def _screen_sql(names: list[str], mode: str) -> str:
    flags = ", ".join(f"coalesce({_CONDITIONS[n]}, false) AS {n}" for n in names)
    width = f"4 * {full(20, 'stddev_samp(close)', 'close')} / nullif({full(20, 'avg(close)', 'close')}, 0) AS bw"
    matched = "list_filter([" + ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in names) + "], lambda x: x IS NOT NULL)"
    least = len(names) if mode == "all" else 1
    return f"""WITH {WEEK}, bb AS (SELECT *, {width} FROM bars), c AS (SELECT symbol, date, close, 100 * (close / {lagged("close")} - 1) AS change_pct, count(*) OVER (PARTITION BY symbol) AS n,
row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back, {flags} FROM bb), m AS (SELECT *, {matched} AS m FROM c WHERE back = 1 AND n >= 25)
SELECT symbol, date, {r("close")} AS close, {r("change_pct")} AS change_pct, CAST(len(m) AS INT) AS score, array_to_string(m, ',') AS matched FROM m WHERE len(m) >= {least}"""


def _screen(spark: SparkSession, sf_dir: str, names: list[str], mode: str) -> DataFrame:
    out = sc.screen(brand_week_bars(spark, sf_dir), names, mode)
    return out.select("symbol", "date", rounded("close").alias("close"), rounded("change_pct").alias("change_pct"), "score", "matched")


@query("screen_all", _screen_sql(["above_ma", "near_high"], "all"))
def screen_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screen(spark, sf_dir, ["above_ma", "near_high"], "all")


@query("screen_any", _screen_sql(list(_CONDITIONS), "any"))
def screen_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screen(spark, sf_dir, list(_CONDITIONS), "any")


_X = {"golden_cross": ("x", ">", "<="), "death_cross": ("x", "<", ">="), "macd_golden": ("m", ">", "<="), "macd_death": ("m", "<", ">=")}
_CROSSED = ", ".join(f"coalesce({v} {now} 0 AND {lagged(v)} {was} 0, false)::INT AS {n}" for n, (v, now, was) in _X.items())
_NAMES = sorted([*_X, "rsi_oversold", "rsi_overbought"])
_FLAGS = ", ".join([*(f"max({n}) OVER {w(3)} = 1 AS {n}" for n in _X), "coalesce(rsi < 30, false) AS rsi_oversold", "coalesce(rsi > 70, false) AS rsi_overbought"])
_MATCHED = "list_filter([" + ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in _NAMES) + "], lambda x: x IS NOT NULL)"


@query(
    "screen_crosses",
    f"""WITH RECURSIVE {WEEK}, {rsi_sql()}, {EMA_CROSS}, {MACD}, a AS (SELECT b.symbol, b.date, b.close, e.x, macd.dif - macd.dea AS m, rsi.rsi FROM bars b JOIN ecd e USING (symbol, date) JOIN macd USING (symbol, date) JOIN rsi USING (symbol, date)),
x AS (SELECT *, 100 * (close / {lagged("close")} - 1) AS change_pct, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back, {_CROSSED} FROM a),
f AS (SELECT symbol, date, close, change_pct, n, back, {_FLAGS} FROM x), s AS (SELECT *, {_MATCHED} AS m FROM f WHERE back = 1 AND n >= 25)
SELECT symbol, date, {r("close")} AS close, {r("change_pct")} AS change_pct, CAST(len(m) AS INT) AS score, array_to_string(m, ',') AS matched FROM s WHERE len(m) >= 1""",
)
def screen_crosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screen(spark, sf_dir, sorted(sc.RECURSIVE), "any")


def _limit_sql(top: str) -> str:
    return f"lm AS (SELECT *, {lagged('close')} AS pc FROM bars), lt AS (SELECT *, round_even(pc * (1 + 0.1::DOUBLE), 2) AS top, round_even(pc * (1 - 0.1::DOUBLE), 2) AS bottom FROM lm)"


_LIMITS = _limit_sql("") + ", li AS (SELECT *, coalesce(abs(close - top) <= 0.011 OR high >= top, false) AS limit_up, coalesce(abs(close - bottom) <= 0.011 OR low <= bottom, false) AS limit_down FROM lt)"


@query("limit_up_down", f"WITH {WEEK}, {_LIMITS} SELECT symbol, date, limit_up, limit_down FROM li")
def limit_up_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.limit_moves(brand_week_bars(spark, sf_dir)).select("symbol", "date", "limit_up", "limit_down")


RULE_ROWS = [
    (1, None, "price_cross", 2000.0, "up", 60),
    (2, None, "price_cross", 1500.0, "down", 60),
    (3, None, "price_pct", 25.0, None, 60),
    (4, None, "volume_spike", 1.2, None, 60),
    (5, None, "limit_up", None, None, 60),
    (6, None, "limit_down", None, None, 60),
    (7, "Brand#3", "price_cross", 1.0, "up", 60),
    (8, None, "stop_loss", None, None, 60),
    (9, None, "take_profit", None, None, 60),
    (10, None, "event", None, None, 60),
]
_BOOKED = "bk AS (SELECT symbol, avg(close) * 0.5 AS stop_loss, avg(close) * 1.5 AS take_profit FROM bars GROUP BY 1)"
_CAL = "cal AS (SELECT symbol, max(date) AS event_date FROM bars WHERE symbol LIKE '%2%' GROUP BY 1)"
_RULES_SQL = "rules(rule_id, rs, type, level, direction) AS (VALUES " + ", ".join(f"({i}, {'NULL' if s is None else repr(s)}, {t!r}, {'NULL' if v is None else v}::DOUBLE, {'NULL' if d is None else repr(d)})" for i, s, t, v, d, _ in RULE_ROWS) + ")"


@query(
    "monitor_rules",
    f"""WITH {WEEK}, {_LIMITS}, {_BOOKED}, {_CAL}, {_RULES_SQL}, f AS (SELECT *, 100 * (close / pc - 1) AS chg, volume / nullif({full(20, "avg(volume)", "volume", prev(20))}, 0) AS vr FROM li),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1), j AS (SELECT * FROM l JOIN rules ON rs IS NULL OR rs = symbol LEFT JOIN bk USING (symbol) LEFT JOIN cal USING (symbol))
SELECT CAST(rule_id AS INT) AS rule_id, symbol, date, type FROM j WHERE coalesce(CASE type WHEN 'price_cross' THEN CASE direction WHEN 'down' THEN close <= level ELSE close >= level END WHEN 'price_pct' THEN abs(chg) >= level
  WHEN 'volume_spike' THEN vr >= level WHEN 'limit_up' THEN limit_up WHEN 'limit_down' THEN limit_down WHEN 'stop_loss' THEN low <= stop_loss WHEN 'take_profit' THEN high >= take_profit WHEN 'event' THEN event_date - date BETWEEN 0 AND 1 END, false)""",
)
def monitor_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = brand_week_bars(spark, sf_dir)
    rules = spark.createDataFrame(RULE_ROWS, sc.RULES)
    booked = bars.groupBy("symbol").agg((F.avg("close") * 0.5).alias("stop_loss"), (F.avg("close") * 1.5).alias("take_profit"))
    calendar = bars.filter(F.contains("symbol", F.lit("2"))).groupBy("symbol").agg(F.max("date").alias("event_date"))
    return sc.fired(sc.monitor_facts(bars), rules, booked, calendar)


@query(
    "cooldown",
    """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase')),
k AS (SELECT user_id, rn, ts, ts AS last, true AS kept FROM e WHERE rn = 1 UNION ALL
  SELECT e.user_id, e.rn, e.ts, CASE WHEN e.ts - k.last >= INTERVAL 2880 MINUTE THEN e.ts ELSE k.last END, e.ts - k.last >= INTERVAL 2880 MINUTE FROM k JOIN e ON e.user_id = k.user_id AND e.rn = k.rn + 1)
SELECT user_id, ts FROM k WHERE kept""",
)
def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    firings = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "ts").distinct()
    return sc.after_cooldown(firings, 2880, ("user_id",))


@query(
    "briefing_changes",
    f"""WITH RECURSIVE {WEEK}, {EMA_CROSS}, {HELD}, a AS (SELECT symbol, date, h, coalesce({lagged("h")}, 0) AS was, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM held)
SELECT symbol, date, {r("close")} AS close, CASE WHEN h > 0 AND was <= 0 THEN 'enter' WHEN h <= 0 AND was > 0 THEN 'exit' WHEN h > 0 THEN 'holding' ELSE 'flat' END AS change FROM a JOIN bars USING (symbol, date) WHERE back = 1 AND n >= 30""",
)
def briefing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sc.signal_changes(brand_week_bars(spark, sf_dir), sig.ema_cross)
    return out.select("symbol", "date", rounded("close").alias("close"), "change")


@query(
    "market_status",
    f"WITH {WEEK}, a AS (SELECT *, {full(200, 'avg(close)', 'close', least=50)} AS ma FROM bars) SELECT symbol, date, {r('close')} AS close, {r('ma')} AS ma, {r('100 * (close / ma - 1)')} AS distance_pct, coalesce(close > ma, false) AS above FROM a QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1",
)
def market_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sc.market_status(brand_week_bars(spark, sf_dir))
    return out.select("symbol", "date", *(rounded(c).alias(c) for c in ("close", "ma", "distance_pct")), "above")


@query(
    "stop_breaches",
    f"WITH {WEEK}, {_BOOKED.replace('* 0.5', '* 0.7')}, l AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1), s AS (SELECT symbol, CASE WHEN symbol LIKE '%1' THEN NULL ELSE stop_loss END AS st FROM bk) SELECT symbol, {r('close')} AS close, CASE WHEN st IS NULL OR st <= 0 THEN 'no_stop' WHEN close <= st THEN 'breached' WHEN close <= st * 1.02::DOUBLE THEN 'near' ELSE 'ok' END AS state FROM l JOIN s USING (symbol)",
)
def stop_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = brand_week_bars(spark, sf_dir)
    booked = bars.groupBy("symbol").agg((F.avg("close") * 0.7).alias("s")).select("symbol", F.when(~F.endswith("symbol", F.lit("1")), F.col("s")).alias("stop_loss"))
    return sc.stop_states(booked, snapshot(bars)).select("symbol", rounded("close").alias("close"), "state")


_RECOS = f"""recos AS (SELECT date AS reco_date, symbol, 'momentum' AS strategy, close AS entry_price, CAST(CASE WHEN day(date) > 15 THEN 10 ELSE 5 END AS INT) AS horizon
  FROM (SELECT *, close / {lagged("close", 5)} - 1 AS m FROM bars) WHERE m > 0.5)"""
_SETTLED = f"""{_RECOS}, nb AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM bars), ib AS (SELECT date AS d, close AS c FROM bars WHERE symbol = 'Brand#1'),
pl AS (SELECT r.*, n + horizon AS k FROM recos r JOIN nb ON nb.symbol = r.symbol AND nb.date = r.reco_date), ex AS (SELECT pl.*, nb.date AS exit_date, nb.close AS exit_price FROM pl LEFT JOIN nb ON nb.symbol = pl.symbol AND nb.n = pl.k),
b1 AS (SELECT ex.*, ib.c AS be FROM ex ASOF LEFT JOIN ib ON ex.reco_date >= ib.d), b2 AS (SELECT b1.*, ib.c AS bx FROM b1 ASOF LEFT JOIN ib ON b1.exit_date >= ib.d),
settled AS (SELECT reco_date, symbol, strategy, horizon, exit_date, CASE WHEN exit_price IS NULL THEN 'open' ELSE 'closed' END AS status, exit_price / entry_price - 1 AS ret, exit_price / entry_price - 1 - (bx / be - 1) AS excess FROM b2)"""


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.functions.panel import div, lag

    bars = brand_week_bars(spark, sf_dir)
    marked = bars.withColumn("m", div(F.col("close"), lag("close", 5)) - 1).filter("m > 0.5")
    recos = marked.select(F.col("date").alias("reco_date"), "symbol", F.lit("momentum").alias("strategy"), F.col("close").alias("entry_price"), F.when(F.dayofmonth("date") > 15, 10).otherwise(5).alias("horizon"))
    return jn.settle(recos, bars, bars.filter("symbol = 'Brand#1'"))


@query("journal_settle", f"WITH {WEEK}, {_SETTLED} SELECT reco_date, symbol, horizon, exit_date, status, {r('ret')} AS ret, {r('excess')} AS excess FROM settled")
def journal_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(spark, sf_dir).select("reco_date", "symbol", "horizon", "exit_date", "status", rounded("return").alias("ret"), rounded("excess").alias("excess"))


@query(
    "journal_scoreboard",
    f"""WITH {WEEK}, {_SETTLED}, c AS (SELECT * FROM settled WHERE status = 'closed') SELECT strategy, count(*) AS n_closed, (SELECT count(*) FROM settled WHERE status = 'open') AS n_open, {r("avg(ret)")} AS mean_return,
  {r("quantile_cont(ret, 0.5)")} AS median_return, {r("avg((ret > 0)::INT)")} AS win_rate, {r("avg(excess)")} AS mean_excess, {r("avg((excess > 0)::INT)")} AS beat_rate, {r("avg(excess) / (stddev_samp(excess) / sqrt(count(excess)))", 4)} AS t_stat FROM c GROUP BY strategy""",
)
def journal_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jn.scoreboard(_settled(spark, sf_dir))
    return out.select("strategy", "n_closed", "n_open", *(rounded(c).alias(c) for c in ("mean_return", "median_return", "win_rate", "mean_excess", "beat_rate")), rounded("t_stat", 4).alias("t_stat"))


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    action = F.when(F.col("l_returnflag") == "R", "trim").otherwise("buy")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return lines.select(F.concat(F.lit("S"), (F.col("l_suppkey") % 50).cast("string")).alias("symbol"), order.alias("at"), action.alias("action"), F.col("l_quantity").alias("shares"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


_LEDGER = """lt AS (SELECT 'S' || (l_suppkey % 50) AS symbol, l_returnflag = 'R' AS selling, l_quantity AS q, l_extendedprice / l_quantity AS px,
  row_number() OVER (PARTITION BY l_suppkey % 50 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem),
lf AS (SELECT symbol, rn, CASE WHEN selling THEN 0 ELSE q END AS have, CASE WHEN selling THEN 0 ELSE px END AS cost, 0.0::DOUBLE AS gained, CASE WHEN selling THEN 1 ELSE 0 END AS rejected FROM lt WHERE rn = 1
  UNION ALL SELECT t.symbol, t.rn,
    CASE WHEN NOT t.selling THEN f.have + t.q WHEN t.q > f.have + 1e-9 THEN f.have WHEN f.have - t.q <= 1e-9 THEN 0 ELSE f.have - t.q END,
    CASE WHEN NOT t.selling THEN (f.cost * f.have + t.px * t.q) / (f.have + t.q) WHEN t.q > f.have + 1e-9 THEN f.cost WHEN f.have - t.q <= 1e-9 THEN 0 ELSE f.cost END,
    CASE WHEN t.selling AND t.q <= f.have + 1e-9 THEN f.gained + (t.px - f.cost) * t.q ELSE f.gained END, f.rejected + CASE WHEN t.selling AND t.q > f.have + 1e-9 THEN 1 ELSE 0 END
  FROM lf f JOIN lt t ON t.symbol = f.symbol AND t.rn = f.rn + 1),
pos AS (SELECT symbol, have AS shares, cost AS cost_price, gained AS realized_pnl, CASE WHEN have > 0 THEN 'open' ELSE 'closed' END AS status, rn AS n_trades, CAST(rejected AS BIGINT) AS rejected FROM lf QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1)"""


@query("ledger_fold", f"WITH RECURSIVE {_LEDGER} SELECT symbol, shares, {r('cost_price', 4)} AS cost_price, {r('realized_pnl', 2)} AS realized_pnl, status, n_trades, rejected FROM pos")
def ledger_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jn.ledger(_trades(spark, sf_dir))
    return out.select("symbol", "shares", rounded("cost_price", 4).alias("cost_price"), rounded("realized_pnl", 2).alias("realized_pnl"), "status", "n_trades", "rejected")


@query(
    "book_summary",
    f"""WITH RECURSIVE {_LEDGER}, v AS (SELECT *, shares * cost_price AS value FROM pos WHERE status = 'open')
SELECT count(*) AS n_open, {r("sum(value)", 1)} AS value, arg_max(symbol, row(value, symbol)) AS heaviest, {r("max(value) / sum(value)")} AS max_weight, {r("(SELECT sum(realized_pnl) FROM pos)", 1)} AS realized_pnl, (SELECT CAST(sum(rejected) AS BIGINT) FROM pos) AS rejected FROM v""",
)
def book_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "symbol string, close double, prev_close double")
    out = jn.book_summary(jn.ledger(_trades(spark, sf_dir)), none)
    return out.select("n_open", rounded("value", 1).alias("value"), "heaviest", rounded("max_weight").alias("max_weight"), rounded("realized_pnl", 1).alias("realized_pnl"), "rejected")


