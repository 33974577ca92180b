"""Queries on back-tests, costs, the next day and portfolios."""

from __future__ import annotations

from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import costs as fees
from barloom.operators import backtest as bt
from barloom.operators import portfolio as pf
from barloom.operators import robust
from barloom.operators import signals as sig
from barloom.plans.evaluate import PANEL, _panel
from barloom.plans.registry import WEEK, events_sql, ewm, full, lagged, led, numbered, query, r, rounded, shown, w
from barloom.plans.signals import EMA_CROSS, ternary
from barloom.sources.bars import brand_week_bars, event_bars, table

# a limit day is a move of 9.9 per cent
POSITIONS = f"""ps AS (SELECT b.symbol, b.date, b.close, CASE WHEN signal = 'BUY' AND close >= pc * 1.099::DOUBLE OR signal = 'SELL' AND close <= pc * 0.901::DOUBLE THEN 'HOLD' ELSE signal END AS signal
  FROM (SELECT *, coalesce({lagged("close")}, close) AS pc FROM bars) b JOIN sig_ema USING (symbol, date)),
po AS (SELECT symbol, date, close, coalesce(last_value(CASE signal WHEN 'BUY' THEN 1.0::DOUBLE WHEN 'SELL' THEN 0 END IGNORE NULLS) OVER {w("all")}, 0) AS pos FROM ps)"""
_FLAT, _SLIP = "0.00025::DOUBLE", "0.0005::DOUBLE"
VECTOR = f"""{POSITIONS}, vt AS (SELECT *, coalesce({lagged("pos")}, 0) AS was, coalesce(close / {lagged("close")} - 1, 0) AS ret FROM po),
vg AS (SELECT *, 1 + was * ret - abs(pos - was) * ({_FLAT} + {_SLIP}) AS g FROM vt),
vec AS (SELECT symbol, date, close, pos, 1000000.0::DOUBLE * product(g) OVER {w("all")} AS equity FROM vg)"""
TRADES = f"""tr0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n, coalesce({lagged("pos")}, 0) AS was FROM po),
tr1 AS (SELECT *, sum((pos > 0 AND was <= 0)::INT) OVER {w("all")} AS trade FROM tr0),
tr2 AS (SELECT symbol, trade, min(date) FILTER (WHERE pos > 0 AND was <= 0) AS entry_date, min(date) FILTER (WHERE pos <= 0 AND was > 0) AS exit_date,
  min(close) FILTER (WHERE pos > 0 AND was <= 0) * (1 + {_SLIP}) AS entry_price, min(close) FILTER (WHERE pos <= 0 AND was > 0) * (1 - {_SLIP}) AS exit_price,
  min(n) FILTER (WHERE pos <= 0 AND was > 0) - min(n) FILTER (WHERE pos > 0 AND was <= 0) AS hold_bars FROM tr1 GROUP BY 1, 2),
trades AS (SELECT *, (exit_price - entry_price) / entry_price - 2 * {_FLAT} AS pnl_pct FROM tr2 WHERE exit_date IS NOT NULL)"""


def _ema_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.vectorised(sig.ema_cross(brand_week_bars(spark, sf_dir)))


@query("bt_vectorized", f"WITH RECURSIVE {WEEK}, {EMA_CROSS}, {VECTOR} SELECT symbol, date, pos, {r('equity', 3)} AS equity FROM vec")
def bt_vectorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ema_run(spark, sf_dir).select("symbol", "date", "pos", rounded("equity", 3).alias("equity"))


_COST = "(CASE WHEN {v} > 0 THEN greatest({v} * 0.00025::DOUBLE, 5) + {v} * CASE WHEN {selling} THEN 0.001::DOUBLE ELSE 0 END + {v} * 0.00001::DOUBLE ELSE 0 END)"
_VALUE = "(e.equity * abs(x.pos - x.was))"
MINIMUM = f"""{POSITIONS}, mt AS (SELECT *, coalesce({lagged("pos")}, 0) AS was, coalesce(close / {lagged("close")} - 1, 0) AS ret, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM po),
me AS (
  SELECT symbol, rn, date, 1000000.0::DOUBLE - CASE WHEN pos > 0 THEN {_COST.format(v="(1000000.0::DOUBLE * pos)", selling="false")} + 1000000.0::DOUBLE * pos * {_SLIP} ELSE 0 END AS equity FROM mt WHERE rn = 1
  UNION ALL
  SELECT x.symbol, x.rn, x.date, greatest(0, e.equity * (1 + x.was * x.ret) - CASE WHEN x.pos <> x.was THEN {_COST.format(v=_VALUE, selling="x.pos < x.was")} + {_VALUE} * {_SLIP} ELSE 0 END)
  FROM me e JOIN mt x ON x.symbol = e.symbol AND x.rn = e.rn + 1)"""


@query("bt_min_commission", f"WITH RECURSIVE {WEEK}, {EMA_CROSS}, {MINIMUM} SELECT symbol, date, {r('equity', 3)} AS equity FROM me")
def bt_min_commission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.vectorised(sig.ema_cross(brand_week_bars(spark, sf_dir)), fees.A_SHARE).select("symbol", "date", rounded("equity", 3).alias("equity"))


@query("bt_trades", f"WITH RECURSIVE {WEEK}, {EMA_CROSS}, {POSITIONS}, {TRADES} SELECT symbol, entry_date, exit_date, {r('entry_price')} AS entry_price, {r('exit_price')} AS exit_price, hold_bars, {r('pnl_pct')} AS pnl_pct FROM trades")
def bt_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.trades_of(_ema_run(spark, sf_dir)).select("symbol", "entry_date", "exit_date", rounded("entry_price").alias("entry_price"), rounded("exit_price").alias("exit_price"), "hold_bars", rounded("pnl_pct").alias("pnl_pct"))


DRAWDOWN = f"""dd0 AS (SELECT *, max(equity) OVER {w("all")} AS peak FROM vec), dd1 AS (SELECT *, sum((equity >= peak)::INT) OVER {w("all")} AS island FROM dd0),
dd2 AS (SELECT symbol, island, count(*) FILTER (WHERE equity < peak) AS run, min(equity / peak - 1) AS dd FROM dd1 GROUP BY 1, 2),
dd AS (SELECT symbol, min(dd) AS max_drawdown, CAST(max(run) AS BIGINT) AS max_dd_days FROM dd2 GROUP BY 1)"""


@query("max_drawdown", f"WITH RECURSIVE {WEEK}, {EMA_CROSS}, {VECTOR}, {DRAWDOWN} SELECT symbol, {r('max_drawdown')} AS max_drawdown, max_dd_days FROM dd")
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.drawdowns(_ema_run(spark, sf_dir)).select("symbol", rounded("max_drawdown").alias("max_drawdown"), "max_dd_days")


METRICS = f"""{DRAWDOWN}, st AS (SELECT *, CASE WHEN abs(equity / {lagged("equity")} - 1) < 1e-12 THEN 0 ELSE equity / {lagged("equity")} - 1 END AS ret FROM vec),
ag AS (SELECT symbol, arg_max(equity, date) / arg_min(equity, date) - 1 AS total_return, count(*) AS num_bars, avg(ret) AS m, stddev_samp(ret) AS sd, stddev_samp(ret) FILTER (WHERE ret < 0) AS dsd FROM st GROUP BY 1),
tg AS (SELECT symbol, count(*) AS num_trades, avg((pnl_pct > 0)::INT) AS win_rate, avg(pnl_pct) FILTER (WHERE pnl_pct > 0) AS avg_win, avg(pnl_pct) FILTER (WHERE pnl_pct <= 0) AS avg_loss,
  sum(pnl_pct) FILTER (WHERE pnl_pct > 0) AS won, sum(pnl_pct) FILTER (WHERE pnl_pct <= 0) AS lost FROM trades GROUP BY 1),
an AS (SELECT *, CASE WHEN total_return <= -1 THEN -1 WHEN num_bars < 21 THEN total_return ELSE pow(1 + total_return, 252.0::DOUBLE / num_bars) - 1 END AS annual_return FROM ag),
met AS (SELECT symbol, total_return, annual_return, coalesce(CASE WHEN sd > 0 THEN m / sd * sqrt(252::DOUBLE) END, 0) AS sharpe, coalesce(CASE WHEN dsd > 0 THEN m / dsd * sqrt(252::DOUBLE) END, 0) AS sortino,
  CASE WHEN max_drawdown < 0 THEN annual_return / -max_drawdown ELSE 0 END AS calmar, max_drawdown, max_dd_days, coalesce(sd, 0) * sqrt(252::DOUBLE) AS volatility, coalesce(win_rate, 0) AS win_rate,
  CASE WHEN -lost > 0 THEN coalesce(won, 0) / -lost WHEN won IS NOT NULL THEN 'inf'::DOUBLE ELSE 0 END AS profit_factor, coalesce(avg_win, 0) AS avg_win, coalesce(avg_loss, 0) AS avg_loss, coalesce(num_trades, 0) AS num_trades, num_bars
  FROM an JOIN dd USING (symbol) LEFT JOIN tg USING (symbol))"""
_FIGURES = ("total_return", "annual_return", "sharpe", "sortino", "calmar", "max_drawdown", "volatility", "win_rate", "profit_factor", "avg_win", "avg_loss")


@query("bt_metrics", f"WITH RECURSIVE {WEEK}, {EMA_CROSS}, {VECTOR}, {TRADES}, {METRICS} SELECT symbol, num_trades, num_bars, max_dd_days, {', '.join(f'{r(c)} AS {c}' for c in _FIGURES)} FROM met")
def bt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _ema_run(spark, sf_dir)
    return shown(bt.metrics(run, bt.trades_of(run)), *_FIGURES, keys=("symbol", "num_trades", "num_bars", "max_dd_days"))


_PX = "(s.close * (1 + 0.0005::DOUBLE))"
_FEE = "(1 + 0.00025::DOUBLE)"
EVENT = f"""ev0 AS (SELECT b.symbol, b.date, close, signal, row_number() OVER (PARTITION BY b.symbol ORDER BY b.date) AS rn, coalesce({lagged("close").replace("symbol", "b.symbol").replace("date", "b.date")}, close) AS pc FROM bars b JOIN sig_ema USING (symbol, date)),
ev AS (
  SELECT symbol, rn, date, 1000000.0::DOUBLE AS cash, 0.0::DOUBLE AS shares, 0.0::DOUBLE AS paid, 1000000.0::DOUBLE AS equity, NULL::DOUBLE AS closed_pct FROM ev0 WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, date, cash - bought * px * {_FEE} + sold * spx * (1 - 0.00025::DOUBLE), shares + bought - sold, CASE WHEN bought > 0 THEN px ELSE paid END,
         cash - bought * px * {_FEE} + sold * spx * (1 - 0.00025::DOUBLE) + (shares + bought - sold) * close,
         CASE WHEN sold > 0 THEN (sold * spx * (1 - 0.00025::DOUBLE) - sold * paid * {_FEE}) / (sold * paid * {_FEE}) END
  FROM (SELECT s.symbol, s.rn, s.date, s.close, e.cash, e.shares, e.paid, {_PX} AS px, s.close * (1 - 0.0005::DOUBLE) AS spx,
          CASE WHEN s.signal = 'BUY' AND e.shares = 0 AND s.close < s.pc * 1.099::DOUBLE THEN floor(e.cash / ({_PX} * {_FEE})) ELSE 0 END AS bought,
          CASE WHEN s.signal = 'SELL' AND e.shares > 0 AND s.close > s.pc * 0.901::DOUBLE THEN e.shares ELSE 0 END AS sold
        FROM ev e JOIN ev0 s ON s.symbol = e.symbol AND s.rn = e.rn + 1))"""


@query("bt_event_driven", f"WITH RECURSIVE {WEEK}, {EMA_CROSS}, {EVENT} SELECT symbol, date, shares, {r('equity', 3)} AS equity, {r('closed_pct')} AS closed_pct FROM ev")
def bt_event_driven(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = bt.event_driven(sig.ema_cross(brand_week_bars(spark, sf_dir)))
    return run.select("symbol", "date", "shares", rounded("equity", 3).alias("equity"), rounded("closed_pct").alias("closed_pct"))


@query("bt_event_continuous")
def bt_event_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A managed strategy's positions as shares of the equity, A-share fees and lots, one bar late."""
    run = bt.event_driven(sig.builtin_strategies()["managed_trend"](brand_week_bars(spark, sf_dir)), fees.A_SHARE, 1e8, 1)
    return run.select("symbol", "date", "shares", rounded("equity", 2).alias("equity"), rounded("closed_pct").alias("closed_pct"), "held_bars")


# --- the next day ---

_NEXT = f"nx AS (SELECT symbol, {led('high')} / close - 1 AS mfe, {led('low')} / close - 1 AS mae, {led('close')} / close - 1 AS ret, {led('open')} / close - 1 AS gap FROM bars)"


@query(
    "nextday_baseline",
    f"""WITH {events_sql("user_id", "day").replace("value AS price", "value + 10 AS price")}, {_NEXT}
SELECT symbol, count(*) AS n, {r("avg(mfe)")} AS mfe_mean, {r("quantile_cont(mfe, 0.5)")} AS mfe_median, {r("quantile_cont(mae, 0.5)")} AS mae_median, {r("avg(ret)")} AS close_ret_mean,
  {r("avg(gap)")} AS overnight_mean, {r("avg((ret > 0)::INT)")} AS pct_up_close, {r("quantile_cont(mfe, 0.5) / nullif(abs(quantile_cont(mae, 0.5)), 0)", 4)} AS mfe_over_mae
FROM nx WHERE mfe IS NOT NULL GROUP BY symbol""",
)
def nextday_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir, "user_id", "day").withColumns({c: F.col(c) + 10 for c in ("open", "high", "low", "close")})
    out = bt.next_day_baseline(bars)
    return out.select("symbol", "n", *(rounded(c).alias(c) for c in ("mfe_mean", "mfe_median", "mae_median", "close_ret_mean", "overnight_mean", "pct_up_close")), rounded("mfe_over_mae", 4).alias("mfe_over_mae"))


_SPREAD = "nullif(high - low, 0)"
_V20 = full(20, "avg(volume)", "volume")


@query(
    "nextday_dataset",
    f"""WITH {WEEK}, a AS (SELECT *, (high - low) / close AS range_pct FROM bars)
SELECT symbol, date, {r("range_pct")} AS range_pct, {r(f"{full(5, 'avg(range_pct)', 'range_pct')} / nullif({full(20, 'avg(range_pct)', 'range_pct')}, 0)")} AS range_expand,
  {r(f"(close - low) / {_SPREAD}")} AS close_pos, {r(f"(high - greatest(close, open)) / {_SPREAD}")} AS upper_shadow, {r(f"(least(close, open) - low) / {_SPREAD}")} AS lower_shadow,
  {r(f"close / {lagged('close', 5)} - 1")} AS ret5, {r(f"close / {full(20, 'avg(close)', 'close')} - 1")} AS dist_ma20, {r(f"volume / nullif({_V20}, 0)")} AS vol_ratio,
  {r(f"open / {lagged('close')} - 1")} AS overnight, {r("close / open - 1")} AS intraday, {r(f"{led('high')} / close - 1")} AS y_mfe, {r(f"{led('low')} / close - 1")} AS y_mae, {r(f"{led('close')} / close - 1")} AS y_close
FROM a""",
)
def nextday_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bt.next_day_dataset(brand_week_bars(spark, sf_dir))
    return shown(out, "range_pct", "range_expand", "close_pos", "upper_shadow", "lower_shadow", "ret5", "dist_ma20", "vol_ratio", "overnight", "intraday", "y_mfe", "y_mae", "y_close")


_FEE_A = repr(fees.A_SHARE.both_ways(10_000.0)) + "::DOUBLE"


def _limit_sql(target: str) -> str:
    return f"""lo0 AS (SELECT symbol, date, close, {led("open")} AS o1, {led("high")} AS h1, {led("low")} AS l1, {led("close")} AS c1, close / {lagged("close")} - 1 >= 0.099::DOUBLE AS up FROM bars),
lo1 AS (SELECT *, close * (1 + {target}) AS lim, close * (1 - 0.5::DOUBLE) AS flr FROM lo0 WHERE c1 IS NOT NULL AND NOT coalesce(up, false)),
lo2 AS (SELECT *, CASE WHEN l1 <= flr THEN 'stop' WHEN o1 >= lim THEN 'gap_open' WHEN h1 >= lim THEN 'limit' ELSE 'close' END AS reason,
  CASE WHEN l1 <= flr THEN least(flr, o1) WHEN o1 >= lim THEN o1 WHEN h1 >= lim THEN lim ELSE c1 END AS px FROM lo1),
lo AS (SELECT *, px / close - 1 AS gross, px / close - 1 - {_FEE_A} AS net, h1 / close - 1 AS mfe, reason IN ('gap_open', 'limit') AS filled FROM lo2)"""


@query("nextday_limit", f"WITH {WEEK}, {_limit_sql('0.05::DOUBLE')} SELECT symbol, date, {r('px')} AS exit_price, {r('net')} AS net, reason, filled FROM lo")
def nextday_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bt.limit_orders(brand_week_bars(spark, sf_dir), F.lit(0.05), fees.A_SHARE, stop=0.5)
    return out.select("symbol", "date", rounded("exit_price").alias("exit_price"), rounded("net").alias("net"), "reason", "filled")


_SCAN = _limit_sql("target").replace("SELECT symbol, date, close, lead", "SELECT symbol, date, close, target, lead").replace("FROM bars)", "FROM bars CROSS JOIN (SELECT unnest([0.01, 0.05, 0.2]::DOUBLE[]) AS target))").replace("PARTITION BY symbol", "PARTITION BY symbol, target")


@query(
    "nextday_scan",
    f"""WITH {WEEK}, {_SCAN} SELECT symbol, target, count(*) AS n_trades, {r("avg(filled::INT)")} AS fill_rate, {r("avg(net)")} AS mean_net, {r("quantile_cont(net, 0.5)")} AS median_net, {r("avg((net > 0)::INT)")} AS win_rate,
  {r("avg(greatest(gross, 0) / greatest(mfe, 1e-9))", 4)} AS capture_rate FROM lo GROUP BY 1, 2""",
)
def nextday_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bt.scan_targets(brand_week_bars(spark, sf_dir), [0.01, 0.05, 0.2], fees.A_SHARE, stop=0.5)
    return out.select("symbol", "target", "n_trades", *(rounded(c).alias(c) for c in ("fill_rate", "mean_net", "median_net", "win_rate")), rounded("capture_rate", 4).alias("capture_rate"))


# --- costs ---

_MODELS = """models(name, commission_rate, min_commission, stamp_duty_sell, stamp_duty_buy, transfer_fee, platform_fee, slippage_rate) AS (SELECT column0, column1::DOUBLE, column2::DOUBLE, column3::DOUBLE, column4::DOUBLE, column5::DOUBLE, column6::DOUBLE, column7::DOUBLE FROM (VALUES
  ('a_share', 0.00025, 5, 0.001, 0, 0.00001, 0, 0.0005), ('hk', 0.00025, 50, 0.001, 0.001, 0.00005, 0.00005, 0.0008), ('us', 0, 0, 0.0000278, 0, 0, 0, 0.0005), ('crypto', 0.001, 0, 0, 0, 0, 0, 0.001), ('flat', 0.00025, 0, 0, 0, 0, 0, 0.0005)) t(column0, column1, column2, column3, column4, column5, column6, column7))"""


def _ratio(v: str, duty: str) -> str:
    return f"((greatest({v} * commission_rate, min_commission) + {v} * {duty} + {v} * (transfer_fee + platform_fee)) / {v})"


_BREAK = f"({_ratio('{v}', 'stamp_duty_buy')} + {_ratio('{v}', 'stamp_duty_sell')} + 2 * slippage_rate)"


@query("cost_table", f"WITH {_MODELS}, v AS (SELECT DISTINCT o_totalprice AS value FROM orders WHERE o_totalprice > 0) SELECT value, name, {r(_ratio('value', 'stamp_duty_buy') + ' * 1e4', 4)} AS one_way_bps, {r(_BREAK.format(v='value') + ' * 100', 4)} AS breakeven_pct FROM v CROSS JOIN models")
def cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "orders").filter("o_totalprice > 0").select(F.col("o_totalprice").alias("value")).distinct()
    return fees.cost_table(values).select("value", "name", rounded("one_way_bps", 4).alias("one_way_bps"), rounded("breakeven_pct", 4).alias("breakeven_pct"))


@query(
    "advise",
    f"""WITH {_MODELS}, c AS (SELECT DISTINCT c_acctbal + 1000 AS capital FROM customer WHERE c_acctbal > -999), a AS (SELECT capital, m.*, CASE WHEN min_commission > 0 THEN greatest(min_commission / greatest(0.001::DOUBLE - commission_rate, 1e-9), min_commission / 0.001::DOUBLE) ELSE 0 END AS min_ticket FROM c CROSS JOIN models m),
b AS (SELECT *, CAST(CASE WHEN min_ticket > 0 THEN least(20, greatest(1, floor(capital / min_ticket))) ELSE 20 END AS INT) AS positions FROM a), d AS (SELECT *, capital / positions AS ticket FROM b)
SELECT capital, name, {r("min_ticket")} AS min_ticket, positions, {r("ticket")} AS ticket, {r("0.02::DOUBLE / " + _BREAK.format(v="ticket"), 4)} AS round_trips, {r("252 / greatest(0.02::DOUBLE / " + _BREAK.format(v="ticket") + ", 1e-9)", 3)} AS hold_bars FROM d""",
)
def advise(spark: SparkSession, sf_dir: str) -> DataFrame:
    capital = table(spark, sf_dir, "customer").filter("c_acctbal > -999").select((F.col("c_acctbal") + 1000).alias("capital")).distinct()
    names = fees.schedules(spark).select("name")
    out = fees.ticket_limits(capital.crossJoin(F.broadcast(names)))
    return out.select("capital", "name", rounded("min_ticket").alias("min_ticket"), "positions", rounded("ticket").alias("ticket"), rounded("round_trips", 4).alias("round_trips"), rounded("hold_bars", 3).alias("hold_bars"))


# --- portfolios ---


@query(
    "rebalance_mask",
    f"""WITH {events_sql("user_id", "day")}, d AS (SELECT DISTINCT date FROM bars), t AS (SELECT date, year(date) || '-' || weekofyear(date) AS wk, year(date) || '-' || month(date) AS mo FROM d)
SELECT date, coalesce(wk <> lag(wk) OVER (ORDER BY date), true) AS weekly, coalesce(mo <> lag(mo) OVER (ORDER BY date), true) AS monthly FROM t""",
)
def rebalance_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = event_bars(spark, sf_dir, "user_id", "day")
    weekly = pf.rebalance_days(bars, "weekly").withColumnRenamed("rebalance", "weekly")
    return weekly.join(pf.rebalance_days(bars, "monthly").withColumnRenamed("rebalance", "monthly"), "date")


@query("inverse_vol", f"WITH {WEEK}, a AS (SELECT symbol, date, close / {lagged('close')} - 1 AS ret FROM bars) SELECT symbol, date, {r('1 / nullif(' + full(20, 'stddev_samp(ret)', 'ret') + ', 0)')} AS inv_vol FROM a")
def inverse_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(pf.inverse_vol(brand_week_bars(spark, sf_dir)), "inv_vol")


@query(
    "ml_score_matrix",
    f"""WITH {WEEK}, {PANEL}, pr AS (SELECT symbol, date, pred FROM panel), dy AS (SELECT date, max(CASE WHEN k % 4 = 0 THEN date END) OVER (ORDER BY date) AS chosen FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM pr))),
rk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred DESC, symbol) AS place, count(*) OVER (PARTITION BY date) AS n FROM pr WHERE pred IS NOT NULL)
SELECT symbol, dy.date, {r("(least(n, 10) - place + 1) / least(n, 10)::DOUBLE")} AS score FROM dy JOIN rk ON rk.date = chosen WHERE n >= 3 AND place <= 10""",
)
def ml_score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(pf.score_matrix(_panel(spark, sf_dir).select("symbol", "date", "pred"), 10, 4), "score")


@query("score_matrix_local", f"WITH {WEEK}, {PANEL}, rk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred DESC, symbol) AS place FROM panel WHERE pred IS NOT NULL) SELECT symbol, date, {r('1 - 0.5::DOUBLE * (place - 1) / 9')} AS score FROM rk WHERE place <= 10")
def score_matrix_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(pf.linear_weights(_panel(spark, sf_dir).select("symbol", "date", "pred")), "score")


def _inputs(spark: SparkSession, sf_dir: str, config: pf.PortfolioConfig) -> DataFrame:
    bars = brand_week_bars(spark, sf_dir)
    scores = pf.score_matrix(_panel(spark, sf_dir).select("symbol", "date", "pred"), 10, 4)
    wanted = bars.select("symbol", "date").join(scores, ["symbol", "date"], "left")
    return pf.inputs(bars, pf.desires(wanted), config)


@query("portfolio_run")
def portfolio_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is held or closed on each date."""
    config = pf.PortfolioConfig(cash=1e8, rebalance="monthly")
    runs = pf.run_portfolios(_inputs(spark, sf_dir, config), {"base": config})
    rows = runs.positions.join(runs.days.select("run", "date", "equity", "turnover"), ["run", "date"])
    return rows.select("run", "date", "symbol", F.round("weight", 6).alias("weight"), F.round("equity", 2).alias("equity"), F.round("turnover", 2).alias("turnover"), F.round("closed_pct", 6).alias("closed_pct"))


@query("target_weights")
def target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of each rebalancing date under the three allocations."""
    config = pf.PortfolioConfig(cash=1e8, rebalance="weekly")
    weights = pf.target_weights(_inputs(spark, sf_dir, config), {a: replace(config, allocation=a) for a in ("equal", "inverse_vol", "score")})
    return weights.select("run", "date", "symbol", F.round("weight", 6).alias("weight"))


@query("compare_allocations")
def compare_allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = pf.PortfolioConfig(cash=1e8, rebalance="weekly")
    summary = pf.run_summary(pf.compare_allocations(_inputs(spark, sf_dir, config), config))
    return summary.select("run", *(F.round(c, 6).alias(c) for c in ("total_return", "annual_turnover", "avg_positions", "cash_pct_mean", "max_drawdown")), "max_positions_held", "num_trades", "max_dd_days")


@query("portfolio_contribution")
def portfolio_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = pf.PortfolioConfig(cash=1e8, rebalance="signal", allocation="score")
    runs = pf.run_portfolios(_inputs(spark, sf_dir, config), {"base": config})
    return pf.contributions(runs).select("run", "symbol", "trades", F.round("total_pnl", 2).alias("total_pnl"), F.round("win_rate", 6).alias("win_rate"), F.round("avg_pnl_pct", 6).alias("avg_pnl_pct"))


@query("backtest_model")
def backtest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = pf.PortfolioConfig(cash=1e8, max_positions=10, allocation="score")
    runs = pf.backtest_model(brand_week_bars(spark, sf_dir), _panel(spark, sf_dir).select("symbol", "date", "pred"), config=config)
    return runs.days.select("date", F.round("equity", 2).alias("equity"), F.round("turnover", 2).alias("turnover"), "n_held")


@query("backtest_predictions")
def backtest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = pf.PortfolioConfig(cash=1e8, max_positions=10, rebalance="weekly", allocation="score")
    out = pf.backtest_predictions(brand_week_bars(spark, sf_dir), _panel(spark, sf_dir).select("symbol", "date", "pred"), config=config)
    return out.select(*(F.round(c, 6).alias(c) for c in ("net_return", "gross_return", "cost_drag", "benchmark_return", "excess_return")), "n_symbols")


@query("equal_weight_bh", f"WITH {WEEK}, a AS (SELECT symbol, arg_max(close, date) / arg_min(close, date) - 1 AS x FROM bars GROUP BY 1) SELECT {r('avg(x)')} AS equal_weight_return, count(*) AS n_symbols FROM a")
def equal_weight_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.equal_weight_hold(brand_week_bars(spark, sf_dir)).select(rounded("equal_weight_return").alias("equal_weight_return"), "n_symbols")


# --- robustness ---


@query(
    "multi_symbol",
    f"""WITH RECURSIVE {WEEK}, {EMA_CROSS}, {VECTOR}, {TRADES}, {METRICS}
SELECT count(*) AS n_symbols, {r("quantile_cont(sharpe, 0.5)")} AS median, {r("avg(sharpe)")} AS mean, {r("stddev_samp(sharpe)")} AS std, {r("min(sharpe)")} AS min, {r("max(sharpe)")} AS max,
  {r("avg((sharpe > 0)::INT)")} AS positive_share, {r("avg((total_return > 0)::INT)")} AS profitable_share, {r("min(max_drawdown)")} AS worst_drawdown, CAST(sum(num_trades) AS BIGINT) AS num_trades FROM met""",
)
def multi_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust.multi_symbol(brand_week_bars(spark, sf_dir), sig.ema_cross)
    return shown(out, "median", "mean", "std", "min", "max", "positive_share", "profitable_share", "worst_drawdown", keys=("n_symbols", "num_trades"))


_GRID = {"fast": [3, 5], "slow": [15, 20]}


def _ema(fast: int, slow: int) -> sig.Strategy:
    return partial(sig.ema_cross, fast=fast, slow=slow)


def sweep_sql(base: str) -> str:
    """CTEs up to ``met`` over the cases of _GRID: the symbol is that of ``base`` (symbol, date, close), a tab and the case."""
    averages = ", ".join(ewm(f"c{n}", "ecx", "close", f"2.0 / {n + 1}") for n in (*_GRID["fast"], *_GRID["slow"]))
    cases = " UNION ALL ".join(f"SELECT ecx.symbol || chr(9) || 'fast={f},slow={s}' AS symbol, date, close, c{f}.y - c{s}.y AS x FROM ecx JOIN c{f} USING (symbol, rn) JOIN c{s} USING (symbol, rn)" for f in _GRID["fast"] for s in _GRID["slow"])
    signal = ternary(f"x > 0 AND {lagged('x')} <= 0", f"x < 0 AND {lagged('x')} >= 0")
    return f"""{WEEK.replace("bars AS (", "weeks AS (")}, base AS ({base}), {numbered("base", "ecx")}, {averages}, crossed AS ({cases}),
bars AS (SELECT symbol, date, close FROM crossed), sig_ema AS (SELECT symbol, date, {signal} AS signal FROM crossed), {VECTOR}, {TRADES}, {METRICS}"""


_SWEPT = sweep_sql("SELECT symbol, date, close FROM weeks")
_CASE = "split_part(symbol, chr(9), 1) AS symbol, split_part(symbol, chr(9), 2) AS \"case\""


@query("param_sweep", f"WITH RECURSIVE {_SWEPT} SELECT {_CASE}, num_trades, {r('total_return')} AS total_return, {r('sharpe')} AS sharpe, {r('max_drawdown')} AS max_drawdown FROM met")
def param_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust.param_sweep(brand_week_bars(spark, sf_dir), _ema, _GRID)
    return shown(out, "total_return", "sharpe", "max_drawdown", keys=("symbol", "case", "num_trades"))


_PARTED = """WITH k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM weeks)
SELECT symbol || chr(10) || CASE WHEN k <= floor(n * (1 - 0.3::DOUBLE)) - 5 THEN 'in' ELSE 'out' END AS symbol, date, close FROM k"""
OPTIMISED = f"""{sweep_sql(_PARTED)}, sw AS (SELECT split_part(symbol, chr(10), 1) AS symbol, split_part(split_part(symbol, chr(10), 2), chr(9), 1) AS part, split_part(symbol, chr(9), 2) AS label, sharpe FROM met),
best AS (SELECT symbol, label, sharpe AS in_sample FROM sw WHERE part = 'in' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, label) = 1),
opt AS (SELECT best.symbol, best.label, in_sample, sw.sharpe AS out_of_sample FROM best LEFT JOIN sw ON sw.symbol = best.symbol AND sw.label = best.label AND part = 'out')"""


@query("optimize_split", f"WITH RECURSIVE {OPTIMISED} SELECT symbol, label AS \"case\", {r('in_sample')} AS in_sample, {r('out_of_sample')} AS out_of_sample FROM opt")
def optimize_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(robust.optimise(brand_week_bars(spark, sf_dir), _ema, _GRID), "in_sample", "out_of_sample", keys=("symbol", "case"))


def plateau_sql(rows: str) -> str:
    """A CTE ``pl`` (symbol, plateau) of ``rows`` (symbol, label, sharpe): the two best of the four cases, by their parameters' spread."""
    value = lambda p: f"CAST(regexp_extract(label, '{p}=([0-9]+)', 1) AS DOUBLE)"
    spread = lambda p: f"stddev_pop({p}) FILTER (WHERE place <= 2) / nullif(max({p}) - min({p}), 0)"
    return f"""pr AS (SELECT symbol, {value("fast")} AS fast, {value("slow")} AS slow, row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, label) AS place FROM {rows}),
pl AS (SELECT symbol, greatest(0, least(1, 1 - ({spread("fast")} + {spread("slow")}) / 2 / 0.29::DOUBLE)) AS plateau FROM pr GROUP BY symbol)"""


_LABELLED = "(SELECT split_part(symbol, chr(9), 1) AS symbol, split_part(symbol, chr(9), 2) AS label, sharpe FROM met)"


@query("plateau_score", f"WITH RECURSIVE {_SWEPT}, {plateau_sql(_LABELLED)} SELECT symbol, {r('plateau')} AS plateau FROM pl")
def plateau_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = robust.param_sweep(brand_week_bars(spark, sf_dir), _ema, _GRID)
    return shown(robust.plateau(sweep, ["fast", "slow"]), "plateau", keys=("symbol",))


@query(
    "robust_walk_forward",
    f"""WITH RECURSIVE {WEEK}, {EMA_CROSS}, {VECTOR}, k AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1) / 40) AS INT) AS fold, count(*) OVER (PARTITION BY symbol) AS n FROM vec)
SELECT symbol, fold, {r("arg_max(equity, date) / arg_min(equity, date) - 1")} AS total_return, count(*) AS num_bars FROM k WHERE fold < 5 AND n - (fold + 1) * 40 - 5 >= 120 GROUP BY 1, 2""",
)
def robust_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust.walk_forward(brand_week_bars(spark, sf_dir), sig.ema_cross)
    return shown(out, "total_return", keys=("symbol", "fold", "num_bars"))


@query("random_benchmark")
def random_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(robust.random_benchmark(brand_week_bars(spark, sf_dir), sig.ema_cross), "actual", "random_mean", "percentile", "p_value", keys=("symbol",))
