"""Queries on signals, strategies, sizes and stops."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import risk
from barloom.operators import signals as sig
from barloom.plans.registry import WEEK, ewm, full, lagged, numbered, prev, query, r, rounded, w
from barloom.plans.technical import KDJ, KELTNER, MID, SD, SUPERTREND, adx_sql, atr_sql, rsi_sql
from barloom.sources.bars import brand_week_bars


def ternary(buy: str, sell: str) -> str:
    return f"CASE WHEN coalesce({sell}, false) THEN 'SELL' WHEN coalesce({buy}, false) THEN 'BUY' ELSE 'HOLD' END"


#: name: (strategy, CTEs after bars that end in (symbol, date, signal) named f).
EMA_CROSS = f"""{numbered("bars", "ecx")}, {ewm("ecf", "ecx", "close", "2.0 / 6")}, {ewm("ecs", "ecx", "close", "2.0 / 21")},
ecd AS (SELECT symbol, date, ecf.y - ecs.y AS x FROM ecx JOIN ecf USING (symbol, rn) JOIN ecs USING (symbol, rn)),
sig_ema AS (SELECT symbol, date, {ternary(f"x > 0 AND {lagged('x')} <= 0", f"x < 0 AND {lagged('x')} >= 0")} AS signal FROM ecd)"""
ADX_TREND = f"""{adx_sql()}, {ewm("a20", "ax", "close", "2.0 / 21")},
aab AS (SELECT adx.*, close > a20.y AS above FROM adx JOIN a20 USING (symbol, rn)), aac AS (SELECT *, coalesce({lagged("above")}, false) AS was FROM aab),
sig_adx AS (SELECT symbol, date, {ternary("adx > 25 AND above AND NOT was", "adx > 25 AND NOT above AND was")} AS signal FROM aac)"""
_ST_TERN = ternary(f"trend = 1 AND {lagged('trend')} = -1", f"trend = -1 AND {lagged('trend')} = 1")
SUPER = f"{SUPERTREND}, sig_st AS (SELECT symbol, date, {_ST_TERN} AS signal FROM sup)"
_RSI_TERN = ternary(f"rsi > 30 AND {lagged('rsi')} <= 30", f"rsi < 70 AND {lagged('rsi')} >= 70")
RSI = f"{rsi_sql()}, sig_rsi AS (SELECT symbol, date, {_RSI_TERN} AS signal FROM rsi)"
_LO, _HI = f"({MID} - 2 * {SD})", f"({MID} + 2 * {SD})"
BOLL = f"sig_boll AS (SELECT symbol, date, {ternary(f'close >= {_LO} AND {lagged('close')} < {_LO}', f'close <= {_HI} AND {lagged('close')} > {_HI}')} AS signal FROM bars)"
Z = f"zs AS (SELECT *, (close - {MID}) / nullif({SD}, 0) AS z FROM bars), sig_z AS (SELECT symbol, date, {ternary(f'z <= -2 AND {lagged('z')} > -2', f'z >= -0.5 AND {lagged('z')} < -0.5')} AS signal FROM zs)"
SINGLE = {
    "sig_ema_cross": (sig.ema_cross, EMA_CROSS, "sig_ema"),
    "sig_adx_trend": (sig.adx_trend, ADX_TREND, "sig_adx"),
    "sig_supertrend": (sig.supertrend_follow, SUPER, "sig_st"),
    "sig_rsi": (sig.rsi_reversal, RSI, "sig_rsi"),
    "sig_bollinger": (sig.bollinger_break, BOLL, "sig_boll"),
    "sig_zscore": (sig.zscore_reversion, Z, "sig_z"),
    "sig_kdj": (
        sig.kdj_cross,
        f"{KDJ}, sig_kdj AS (SELECT symbol, date, {ternary(f'k > d AND {lagged('k')} <= {lagged('d')} AND d < 20', f'k < d AND {lagged('k')} >= {lagged('d')} AND d > 80')} AS signal FROM kdj)",
        "sig_kdj",
    ),
    "sig_cci": (
        sig.cci_reversal,
        f"""ca AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), cb AS (SELECT *, {full(20, "avg(tp)", "tp")} AS ma FROM ca), cc AS (SELECT *, abs(tp - ma) AS dev FROM cb),
cd AS (SELECT symbol, date, (tp - ma) / nullif(0.015 * {full(20, "avg(dev)", "dev")}, 0) AS cci FROM cc),
sig_cci AS (SELECT symbol, date, {ternary(f"cci > -100 AND {lagged('cci')} <= -100", f"cci < 100 AND {lagged('cci')} >= 100")} AS signal FROM cd)""",
        "sig_cci",
    ),
    "sig_donchian": (sig.donchian_breakout, f"sig_dc AS (SELECT symbol, date, {ternary(f'close > {full(20, "max(high)", "high", prev(20))}', f'close < {full(10, "min(low)", "low", prev(10))}')} AS signal FROM bars)", "sig_dc"),
    "sig_keltner": (sig.keltner_breakout, f"{KELTNER}, sig_kc AS (SELECT symbol, date, {ternary('close > upper', 'close < mid')} AS signal FROM kc)", "sig_kc"),
    "sig_vol_breakout": (
        sig.volatility_breakout,
        f"""va AS (SELECT *, greatest({full(20, "max(high)", "high")} - {full(20, "min(close)", "close")}, {full(20, "max(close)", "close")} - {full(20, "min(low)", "low")}) AS rng FROM bars),
sig_vb AS (SELECT symbol, date, {ternary(f"close > open + 0.5 * {lagged('rng')}", f"close < open - 0.5 * {lagged('rng')}")} AS signal FROM va)""",
        "sig_vb",
    ),
}


def _single(name: str, strategy: sig.Strategy, ctes: str, last: str) -> None:
    @query(name, f"WITH RECURSIVE {WEEK}, {ctes} SELECT symbol, date, signal FROM {last}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return strategy(brand_week_bars(spark, sf_dir)).select("symbol", "date", "signal")


for _name, _parts in SINGLE.items():
    _single(_name, *_parts)


_UPPER, _LOWER = full(20, "max(high)", "high", prev(20)), full(20, "min(low)", "low", prev(20))
_WITHIN = "greatest(-1, least(1, coalesce({}, 0)))"
SCORES = {
    "score_rsi": (sig.rsi_score, f"{rsi_sql()}, f AS (SELECT symbol, date, {_WITHIN.format('(50 - rsi) / 30.0')} AS score FROM rsi)"),
    "score_turtle": (
        sig.turtle_score,
        f"""{adx_sql()}, tc AS (SELECT *, {_UPPER} AS u, {_LOWER} AS l FROM adx),
f AS (SELECT symbol, date, {_WITHIN.format("(close - (u + l) / 2) / nullif((u - l) / 2, 0) * least(adx / 20, 1)")} AS score FROM tc)""",
    ),
    "score_atr_channel": (
        sig.atr_channel_score,
        f"""{atr_sql(20)}, {ewm("ce", "atrx", "close", "2.0 / 21")},
f AS (SELECT atr.symbol, atr.date, {_WITHIN.format("(close - ce.y) / nullif(2 * atr, 0)")} AS score FROM atr JOIN ce USING (symbol, rn))""",
    ),
}


def _score(name: str, strategy: sig.Strategy, ctes: str) -> None:
    @query(name, f"WITH RECURSIVE {WEEK}, {ctes} SELECT symbol, date, {r('score')} AS score FROM f")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return strategy(brand_week_bars(spark, sf_dir)).select("symbol", "date", rounded("score").alias("score"))


for _name, _parts in SCORES.items():
    _score(_name, *_parts)


def crossing(score: str, source: str, name: str, buy: float, sell: float) -> str:
    up, down = f"coalesce({score} >= {buy}, false)", f"coalesce({score} <= {sell}, false)"
    return f"""{name}z AS (SELECT *, {up} AS up, {down} AS down FROM {source}), {name} AS (SELECT symbol, date, {ternary(f"up AND NOT coalesce({lagged('up')}, false)", f"down AND NOT coalesce({lagged('down')}, false)")} AS signal FROM {name}z)"""


NORMAL = f"ns AS (SELECT symbol, date, greatest(-1, least(1, coalesce((close - {full(60, 'avg(close)', 'close', least=15)}) / nullif({full(60, 'stddev_samp(close)', 'close', least=15)}, 0) / 2, 0))) AS score FROM bars)"


@query("normalize_score", f"WITH {WEEK}, {NORMAL} SELECT symbol, date, {r('score')} AS score FROM ns")
def normalize_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.normalise_score(brand_week_bars(spark, sf_dir), "close").select("symbol", "date", rounded("score").alias("score"))


@query("score_to_signal", f"WITH {WEEK}, {NORMAL}, {crossing('score', 'ns', 'f', 0.3, -0.3)} SELECT symbol, date, signal FROM f")
def score_to_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.score_to_signal(sig.normalise_score(brand_week_bars(spark, sf_dir), "close")).select("symbol", "date", "signal")


def _num(s: str) -> str:
    return f"CASE {s} WHEN 'BUY' THEN 1.0::DOUBLE WHEN 'SELL' THEN -1.0 ELSE 0.0 END"


def vote_sql(name: str, members: list[str]) -> str:
    """CTEs up to ``name`` (symbol, date, score): the mean of the members' votes where two agree."""
    n = len(members)
    join = " ".join(f"JOIN {m} m{i} USING (symbol, date)" for i, m in enumerate(members) if i)
    votes = ", ".join(f"{_num(f'm{i}.signal')} AS v{i}" for i in range(n))
    score = " + ".join(f"v{i} * (1.0::DOUBLE / {n})" for i in range(n))
    longs, shorts = (" + ".join(f"(v{i} {op} 0)::INT" for i in range(n)) for op in "><")
    return f"""{name}v AS (SELECT symbol, date, {votes} FROM {members[0]} m0 {join}), {name}w AS (SELECT *, {score} AS s, {longs} AS longs, {shorts} AS shorts FROM {name}v),
{name} AS (SELECT symbol, date, CASE WHEN (s > 0 AND longs >= 2) OR (s < 0 AND shorts >= 2) THEN s ELSE 0 END AS score FROM {name}w)"""


TREND_VOTE = f"{EMA_CROSS}, {ADX_TREND}, {SUPER}, {vote_sql('tv', ['sig_ema', 'sig_adx', 'sig_st'])}, {crossing('score', 'tv', 'trend', 0.35, -0.35)}"
REVERSION_VOTE = f"{RSI}, {Z}, {BOLL}, {vote_sql('rv', ['sig_rsi', 'sig_z', 'sig_boll'])}, {crossing('score', 'rv', 'revert', 0.35, -0.35)}"


@query("vote", f"WITH RECURSIVE {WEEK}, {TREND_VOTE} SELECT symbol, date, signal FROM trend")
def vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.builtin_strategies()["trend_vote"](brand_week_bars(spark, sf_dir)).select("symbol", "date", "signal")


REGIME = "reg AS (SELECT *, CASE WHEN adx <= 20 THEN 'range' WHEN adx >= 25 THEN 'trend' ELSE 'transition' END AS regime FROM adx)"


@query("regime", f"WITH RECURSIVE {WEEK}, {adx_sql()}, {REGIME} SELECT symbol, date, regime FROM reg")
def regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.market_regime(brand_week_bars(spark, sf_dir)).select("symbol", "date", "regime")


@query(
    "regime_adaptive",
    f"""WITH RECURSIVE {WEEK}, {TREND_VOTE}, {REVERSION_VOTE}, {REGIME},
j AS (SELECT symbol, date, regime, regime = 'transition' AS mid, t.signal AS ts, v.signal AS rs FROM reg JOIN trend t USING (symbol, date) JOIN revert v USING (symbol, date))
SELECT symbol, date, CASE regime WHEN 'trend' THEN ts WHEN 'range' THEN rs ELSE CASE WHEN NOT coalesce({lagged("mid")}, false) THEN 'SELL' ELSE 'HOLD' END END AS signal FROM j""",
)
def regime_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.builtin_strategies()["regime_switch"](brand_week_bars(spark, sf_dir)).select("symbol", "date", "signal")


@query(
    "filtered",
    f"""WITH RECURSIVE {WEEK}, {EMA_CROSS},
ft AS (SELECT symbol, date, coalesce(volume / nullif({full(20, "avg(volume)", "volume", prev(20))}, 0) >= 1, false) AS a,
  coalesce(abs((close - {MID}) / nullif({SD}, 0)) <= 2.5, false) AS b FROM bars)
SELECT symbol, date, CASE WHEN signal = 'BUY' AND NOT (a AND b) THEN 'HOLD' ELSE signal END AS signal FROM sig_ema JOIN ft USING (symbol, date)""",
)
def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.filtered(sig.ema_cross, [sig.volume_filter, sig.not_overextended])(brand_week_bars(spark, sf_dir)).select("symbol", "date", "signal")


@query(
    "filter_squeeze",
    f"""WITH RECURSIVE {WEEK}, sq AS (SELECT *, 4 * {SD} / nullif({MID}, 0) AS bw FROM bars), {atr_sql()},
q AS (SELECT symbol, date, coalesce(bw <= {full(60, "quantile_cont(bw, 0.3)", "bw", least=20)}, false) AS squeezed FROM sq)
SELECT symbol, date, squeezed, coalesce(100 * atr / close BETWEEN 5 AND 150, false) AS calm FROM q JOIN atr USING (symbol, date)""",
)
def filter_squeeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sig.squeeze_filter(brand_week_bars(spark, sf_dir)).withColumnRenamed("passes", "squeezed")
    return sig.volatility_filter(out, low=5.0, high=150.0).select("symbol", "date", "squeezed", F.col("passes").alias("calm"))


INDEX = "(SELECT * FROM bars WHERE symbol = (SELECT min(symbol) FROM bars))"
GATE = f"""ia AS (SELECT symbol, date, coalesce(close > {full(200, "avg(close)", "close", least=50)}, false)::INT AS above FROM {INDEX}),
ib AS (SELECT *, CASE WHEN count(above) OVER {w(3)} = 3 THEN CASE sum(above) OVER {w(3)} WHEN 3 THEN 1 WHEN 0 THEN 0 END END AS st FROM ia),
gate AS (SELECT date, coalesce(last_value(st IGNORE NULLS) OVER {w("all")}, 0) = 1 AS market_ok FROM ib)"""


def _index(bars: DataFrame) -> DataFrame:
    return bars.join(F.broadcast(bars.agg(F.min("symbol").alias("symbol"))), "symbol")


@query("market_gate", f"WITH {WEEK}, {GATE} SELECT date, market_ok FROM gate")
def market_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.market_filter(_index(brand_week_bars(spark, sf_dir)))


HELD = f"held AS (SELECT symbol, date, coalesce(last_value(CASE signal WHEN 'BUY' THEN 1.0::DOUBLE WHEN 'SELL' THEN 0.0 END IGNORE NULLS) OVER {w('all')}, 0) AS h FROM sig_ema)"


@query("market_filtered", f"WITH RECURSIVE {WEEK}, {EMA_CROSS}, {HELD}, {GATE} SELECT symbol, h.date, CASE WHEN coalesce(market_ok, false) THEN h ELSE 0 END AS position FROM held h ASOF LEFT JOIN gate g ON h.date >= g.date")
def market_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = brand_week_bars(spark, sf_dir)
    return sig.with_market_filter(sig.ema_cross, _index(bars))(bars).select("symbol", "date", "position")


@query(
    "size_vol_target",
    f"""WITH {WEEK}, a AS (SELECT *, ln(close / {lagged("close")}) AS lr FROM bars), b AS (SELECT symbol, date, 8.0::DOUBLE / nullif({full(20, "stddev_samp(lr)", "lr")} * sqrt(252::DOUBLE), 0) AS s FROM a)
SELECT symbol, date, {r("CASE WHEN s IS NULL THEN 0.05 ELSE greatest(0.05, least(1, s)) END")} AS size FROM b""",
)
def size_vol_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.volatility_target(brand_week_bars(spark, sf_dir), target=8.0).select("symbol", "date", rounded("size").alias("size"))


@query(
    "size_atr_risk",
    f"WITH RECURSIVE {WEEK}, {atr_sql()}, b AS (SELECT symbol, date, 0.5::DOUBLE / nullif(2 * atr / nullif(close, 0), 0) AS s FROM atr) SELECT symbol, date, {r('CASE WHEN s IS NULL THEN 0.05 ELSE greatest(0.05, least(1, s)) END')} AS size FROM b",
)
def size_atr_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.atr_risk(brand_week_bars(spark, sf_dir), risk=0.5).select("symbol", "date", rounded("size").alias("size"))


STOPS = f"""{atr_sql()}, sw AS (SELECT a.*, h AS want FROM atr a JOIN held USING (symbol, date)),
fold AS (
  SELECT symbol, rn, CASE WHEN want > 0 THEN want ELSE 0 END AS pos, '' AS why, want > 0 AS inside, false AS locked,
         close - 1.5 * atr AS stop, close + 4 * atr AS target, high AS peak, 0 AS age FROM sw WHERE rn = 1
  UNION ALL
  SELECT symbol, rn,
         CASE WHEN inside THEN CASE WHEN hit = '' THEN want ELSE 0 END WHEN want > 0 AND NOT locked THEN want ELSE 0 END,
         CASE WHEN inside THEN hit ELSE '' END,
         CASE WHEN inside THEN hit = '' ELSE want > 0 AND NOT locked END,
         CASE WHEN inside THEN hit NOT IN ('', 'signal_exit') WHEN want <= 0 THEN false ELSE locked END,
         CASE WHEN NOT inside AND want > 0 AND NOT locked THEN close - 1.5 * atr ELSE stop END,
         CASE WHEN NOT inside AND want > 0 AND NOT locked THEN close + 4 * atr ELSE target END,
         CASE WHEN NOT inside AND want > 0 AND NOT locked THEN high ELSE peak END,
         CASE WHEN NOT inside AND want > 0 AND NOT locked THEN 0 ELSE age END
  FROM (SELECT *, CASE WHEN low <= stop THEN 'stop_loss' WHEN high >= target THEN 'take_profit' WHEN age >= 25 THEN 'time_stop' WHEN want <= 0 THEN 'signal_exit' ELSE '' END AS hit FROM (
    SELECT s.*, f.inside, f.locked, f.target, f.age + 1 AS age, greatest(f.peak, s.high) AS peak,
           CASE WHEN f.inside THEN greatest(f.stop, greatest(f.peak, s.high) - 1.5 * s.atr) ELSE f.stop END AS stop
    FROM fold f JOIN sw s ON s.symbol = f.symbol AND s.rn = f.rn + 1)))"""


@query("apply_stops", f"WITH RECURSIVE {WEEK}, {EMA_CROSS}, {HELD}, {STOPS} SELECT symbol, date, pos AS stopped, why AS exit_reason FROM fold JOIN sw USING (symbol, rn)")
def apply_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = sig.ema_cross(brand_week_bars(spark, sf_dir))
    bars = bars.withColumn("position", sig.held(F.col("signal")))
    return risk.apply_stops(bars, atr_mult=1.5, take_profit=4.0, max_hold=25).select("symbol", "date", "stopped", "exit_reason")


@query(
    "drawdown_throttle",
    f"""WITH RECURSIVE {WEEK}, {EMA_CROSS}, {HELD}, d AS (SELECT symbol, date, close / max(close) OVER {w("all")} - 1 AS dd FROM bars)
SELECT symbol, date, CASE WHEN dd <= -0.6 THEN 0.0 WHEN dd <= -0.3 THEN 0.5 * h ELSE h END AS throttled FROM d JOIN held USING (symbol, date)""",
)
def drawdown_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = sig.ema_cross(brand_week_bars(spark, sf_dir))
    bars = bars.withColumn("position", sig.held(F.col("signal")))
    return risk.drawdown_throttle(bars, warn=0.3, halt=0.6).select("symbol", "date", "throttled")


@query("strategies_all")
def strategies_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the built-in strategies wants on every bar."""
    out = brand_week_bars(spark, sf_dir)
    names = []
    for name, strategy in sig.builtin_strategies().items():
        made = strategy(out)
        out = made.withColumn(f"w_{name}", sig.as_score(made)).drop("signal", "score", "position")
        names.append(f"w_{name}")
    return out.select("symbol", "date", *(rounded(n).alias(n) for n in names))


