"""Queries on technical factors and the 158-feature panel."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.operators import alpha
from barloom.operators import technical as tech
from barloom.plans.registry import WEEK, ewm, full, lagged, numbered, prev, query, r, shown, w
from barloom.sources.bars import brand_week_bars


def _factor(name: str, columns: tuple[str, ...], make: Callable[[DataFrame], DataFrame], body: str, recursive: bool = False) -> None:
    """A query that shows ``columns`` of ``make(bars)``; ``body``: SQL CTEs after bars, the last of which is ``f``."""
    sql = f"WITH {'RECURSIVE ' if recursive else ''}{WEEK}, {body} SELECT symbol, date, {', '.join(f'{r(c)} AS {c}' for c in columns)} FROM f"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(make(brand_week_bars(spark, sf_dir)), *columns)


TR = f"greatest(high - low, abs(high - {lagged('close')}), abs(low - {lagged('close')}))"
MID, SD = full(20, "avg(close)", "close"), full(20, "stddev_samp(close)", "close")
_factor("tech_bollinger", ("bb_mid", "bb_upper", "bb_lower"), tech.bollinger, f"f AS (SELECT symbol, date, {MID} AS bb_mid, {MID} + 2 * {SD} AS bb_upper, {MID} - 2 * {SD} AS bb_lower FROM bars)")
_factor("tech_bandwidth", ("bb_width",), tech.bollinger, f"f AS (SELECT symbol, date, 4 * {SD} / nullif({MID}, 0) AS bb_width FROM bars)")
_UP, _LOW = full(20, "max(high)", "high", prev(20)), full(20, "min(low)", "low", prev(20))
_factor("tech_donchian", ("dc_upper", "dc_lower", "dc_mid"), tech.donchian, f"f AS (SELECT symbol, date, {_UP} AS dc_upper, {_LOW} AS dc_lower, ({_UP} + {_LOW}) / 2 AS dc_mid FROM bars)")
_factor(
    "tech_cci",
    ("cci",),
    tech.cci,
    f"""a AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), b AS (SELECT *, {full(20, "avg(tp)", "tp")} AS ma FROM a),
c AS (SELECT *, abs(tp - ma) AS dev FROM b), f AS (SELECT symbol, date, (tp - ma) / nullif(0.015 * {full(20, "avg(dev)", "dev")}, 0) AS cci FROM c)""",
)
_H14, _L14 = full(14, "max(high)", "high"), full(14, "min(low)", "low")
_factor("tech_williams", ("williams_r",), tech.williams_r, f"f AS (SELECT symbol, date, -100 * ({_H14} - close) / nullif({_H14} - {_L14}, 0) AS williams_r FROM bars)")
_factor(
    "tech_stochastic",
    ("stoch_k", "stoch_d"),
    tech.stochastic,
    f"a AS (SELECT *, 100 * (close - {_L14}) / nullif({_H14} - {_L14}, 0) AS stoch_k FROM bars), f AS (SELECT symbol, date, stoch_k, {full(3, 'avg(stoch_k)', 'stoch_k')} AS stoch_d FROM a)",
)
_factor(
    "tech_roc_mom",
    ("roc", "momentum"),
    lambda b: tech.momentum(tech.roc(b), 20, 5),
    f"f AS (SELECT symbol, date, 100 * (close / {lagged('close', 12)} - 1) AS roc, {lagged('close', 5)} / {lagged('close', 25)} - 1 AS momentum FROM bars)",
)
_factor("tech_zscore", ("zscore",), tech.zscore, f"f AS (SELECT symbol, date, (close - {MID}) / nullif({SD}, 0) AS zscore FROM bars)")
_factor(
    "tech_realized_vol",
    ("realised_vol",),
    tech.realised_vol,
    f"a AS (SELECT *, ln(close / {lagged('close')}) AS lr FROM bars), f AS (SELECT symbol, date, {full(20, 'stddev_samp(lr)', 'lr')} * {math.sqrt(252)!r}::DOUBLE AS realised_vol FROM a)",
)
_factor(
    "tech_obv",
    ("obv",),
    tech.obv,
    f"a AS (SELECT *, coalesce(sign(close - {lagged('close')}), 0) * volume AS flow FROM bars), f AS (SELECT symbol, date, sum(flow) OVER {w('all')} AS obv FROM a)",
)
_factor("tech_volume_ratio", ("volume_ratio",), tech.volume_ratio, f"f AS (SELECT symbol, date, volume / nullif({full(5, 'avg(volume)', 'volume', prev(5))}, 0) AS volume_ratio FROM bars)")

_factor(
    "tech_ema",
    ("ema5", "ema20"),
    lambda b: tech.ema(b, 5, 20),
    f"{numbered()}, {ewm('e1', 'x', 'close', '2.0 / 6')}, {ewm('e2', 'x', 'close', '2.0 / 21')}, f AS (SELECT symbol, date, e1.y AS ema5, e2.y AS ema20 FROM x JOIN e1 USING (symbol, rn) JOIN e2 USING (symbol, rn))",
    True,
)


def rsi_sql(period: int = 14) -> str:
    """CTEs up to ``rsi`` (symbol, rn, date, ..., rsi) from bars."""
    return f"""d AS (SELECT *, close - {lagged("close")} AS chg FROM bars),
g AS (SELECT *, CASE WHEN chg IS NOT NULL THEN greatest(chg, 0) END AS gain, CASE WHEN chg IS NOT NULL THEN greatest(-chg, 0) END AS loss FROM d), {numbered("g", "rx")},
{ewm("rg", "rx", "gain", f"1.0 / {period}")}, {ewm("rl", "rx", "loss", f"1.0 / {period}")},
rsi AS (SELECT rx.*, coalesce(100 - 100 / (1 + rg.y / nullif(rl.y, 0)), 50) AS rsi FROM rx JOIN rg USING (symbol, rn) JOIN rl USING (symbol, rn))"""


_factor("tech_rsi", ("rsi",), tech.rsi, f"{rsi_sql()}, f AS (SELECT symbol, date, rsi FROM rsi)", True)
MACD = f"""{numbered("bars", "mx")}, {ewm("mf", "mx", "close", "2.0 / 13")}, {ewm("ms", "mx", "close", "2.0 / 27")},
md AS (SELECT mx.*, mf.y - ms.y AS dif FROM mx JOIN mf USING (symbol, rn) JOIN ms USING (symbol, rn)), {ewm("me", "md", "dif", "2.0 / 10")},
macd AS (SELECT md.*, me.y AS dea FROM md JOIN me USING (symbol, rn))"""
_factor("tech_macd", ("macd_dif", "macd_dea", "macd_hist"), tech.macd, f"{MACD}, f AS (SELECT symbol, date, dif AS macd_dif, dea AS macd_dea, 2 * (dif - dea) AS macd_hist FROM macd)", True)


def atr_sql(period: int = 14, name: str = "atr") -> str:
    """CTEs up to ``name`` (all of bars, rn, atr)."""
    return f"""{name}t AS (SELECT *, {TR} AS tr FROM bars), {numbered(f"{name}t", f"{name}x")}, {ewm(f"{name}e", f"{name}x", "tr", f"1.0 / {period}")},
{name} AS (SELECT {name}x.*, {name}e.y AS atr FROM {name}x JOIN {name}e USING (symbol, rn))"""


_factor("tech_atr_natr", ("atr", "natr"), tech.atr, f"{atr_sql()}, f AS (SELECT symbol, date, atr, 100 * atr / close AS natr FROM atr)", True)


def adx_sql(period: int = 14) -> str:
    """CTEs up to ``adx`` (all of bars, rn, plus_di, minus_di, adx)."""
    return f"""am AS (SELECT *, {TR} AS tr, greatest(coalesce(high - {lagged("high")}, 0), 0) AS up, greatest(coalesce({lagged("low")} - low, 0), 0) AS dn FROM bars),
ap AS (SELECT *, CASE WHEN up > dn THEN up ELSE 0 END AS plus, CASE WHEN dn > up THEN dn ELSE 0 END AS minus FROM am), {numbered("ap", "ax")},
{ewm("at1", "ax", "tr", f"1.0 / {period}")}, {ewm("at2", "ax", "plus", f"1.0 / {period}")}, {ewm("at3", "ax", "minus", f"1.0 / {period}")},
ad AS (SELECT ax.*, 100 * at2.y / nullif(at1.y, 0) AS plus_di, 100 * at3.y / nullif(at1.y, 0) AS minus_di FROM ax JOIN at1 USING (symbol, rn) JOIN at2 USING (symbol, rn) JOIN at3 USING (symbol, rn)),
ae AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM ad), {ewm("at4", "ae", "dx", f"1.0 / {period}")},
adx AS (SELECT ae.*, coalesce(at4.y, 0) AS adx FROM ae JOIN at4 USING (symbol, rn))"""


_factor("tech_adx", ("plus_di", "minus_di", "adx"), tech.adx, f"{adx_sql()}, f AS (SELECT symbol, date, plus_di, minus_di, adx FROM adx)", True)
_H9, _L9 = full(9, "max(high)", "high"), full(9, "min(low)", "low")
KDJ = f"""kr AS (SELECT *, 100 * (close - {_L9}) / nullif({_H9} - {_L9}, 0) AS rsv FROM bars), {numbered("kr", "kx")}, {ewm("kk", "kx", "rsv", "1.0 / 3")},
ky AS (SELECT kx.*, coalesce(kk.y, 50) AS k FROM kx JOIN kk USING (symbol, rn)), {ewm("kd", "ky", "k", "1.0 / 3")}, kdj AS (SELECT ky.*, kd.y AS d FROM ky JOIN kd USING (symbol, rn))"""
_factor("tech_kdj", ("kdj_k", "kdj_d", "kdj_j"), tech.kdj, f"{KDJ}, f AS (SELECT symbol, date, k AS kdj_k, d AS kdj_d, 3 * k - 2 * d AS kdj_j FROM kdj)", True)
KELTNER = f"{atr_sql(20, 'ka')}, {ewm('ke', 'kax', 'close', '2.0 / 21')}, kc AS (SELECT ka.*, ke.y AS mid, ke.y + 2 * atr AS upper, ke.y - 2 * atr AS lower FROM ka JOIN ke USING (symbol, rn))"
_factor("tech_keltner", ("kc_mid", "kc_upper", "kc_lower"), tech.keltner, f"{KELTNER}, f AS (SELECT symbol, date, mid AS kc_mid, upper AS kc_upper, lower AS kc_lower FROM kc)", True)
SUPERTREND = f"""{atr_sql(10, "sa")},
sb AS (SELECT *, (high + low) / 2 + 3 * atr AS ub, (high + low) / 2 - 3 * atr AS lb, {lagged("close")} AS pc FROM sa),
st AS (
  SELECT symbol, rn, ub AS fu, lb AS fl, CAST(1 AS BIGINT) AS trend FROM sb WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, fu, fl, CASE WHEN was = 1 THEN CASE WHEN close < fl THEN -1 ELSE 1 END ELSE CASE WHEN close > fu THEN 1 ELSE -1 END END FROM (
    SELECT sb.symbol, sb.rn, sb.close, st.trend AS was,
           CASE WHEN sb.ub < st.fu OR sb.pc > st.fu THEN sb.ub ELSE st.fu END AS fu,
           CASE WHEN sb.lb > st.fl OR sb.pc < st.fl THEN sb.lb ELSE st.fl END AS fl
    FROM st JOIN sb ON sb.symbol = st.symbol AND sb.rn = st.rn + 1)),
sup AS (SELECT sb.*, CASE WHEN trend = 1 THEN fl ELSE fu END AS line, trend FROM sb JOIN st USING (symbol, rn))"""
_factor("tech_supertrend", ("st_line", "st_trend"), tech.supertrend, f"{SUPERTREND}, f AS (SELECT symbol, date, line AS st_line, trend AS st_trend FROM sup)", True)


# --- the panel -----------------------------------------------------------------------------------

E = "1e-12::DOUBLE"
_PREPARED = f"""n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS cnt FROM bars), p AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, {lagged("close")} AS c1, {lagged("volume")} AS v1 FROM n WHERE cnt >= 70),
q AS (SELECT *, close - c1 AS dc, volume - v1 AS dv, CASE WHEN close > c1 THEN 1.0::DOUBLE ELSE 0 END AS up, CASE WHEN close < c1 THEN 1.0::DOUBLE ELSE 0 END AS dn,
  ln(volume + {E}) AS lnv, close / c1 AS rc, ln(volume / nullif(v1, 0) + 1) AS rv, abs(close / c1 - 1) * volume AS wv FROM p)"""


def _corr(a: str, b: str, d: int) -> str:
    pair = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN"
    return f"(CASE WHEN count({pair} 1 END) OVER {w(d)} >= {d} THEN covar_pop({a}, {b}) OVER {w(d)} / nullif(stddev_pop({pair} {a} END) OVER {w(d)} * stddev_pop({pair} {b} END) OVER {w(d)}, 0) END)"


def _since(extreme: str, column: str, d: int) -> str:
    return f"(CASE WHEN count({column}) OVER {w(d)} >= {d} THEN len(list({column}) OVER {w(d)}) - list_position(list({column}) OVER {w(d)}, {extreme}({column}) OVER {w(d)}) END)::DOUBLE"


def _feature_sql(d: int) -> dict[str, str]:
    high, low = full(d, "max(high)", "high"), full(d, "min(low)", "low")
    slope, mean = full(d, "regr_slope(close, rn)", "close"), full(d, "avg(close)", "close")
    values = f"list(close) OVER {w(d)}"
    ih, il = _since("max", "high", d), _since("min", "low", d)

    def parts(name: str, change: str) -> dict[str, str]:
        total = f"({full(d, f'sum(abs({change}))', change)} + {E})"
        p, n = (f"{full(d, f'sum(greatest({s}{change}, 0))', change)} / {total}" for s in ("", "-"))
        return {f"{name}P": p, f"{name}N": n, f"{name}D": f"{p} - {n}"}

    up, dn = full(d, "avg(up)", "up"), full(d, "avg(dn)", "dn")
    out = {
        "ROC": f"{lagged('close', d)} / close",
        "MA": f"{mean} / close",
        "STD": f"{full(d, 'stddev_samp(close)', 'close')} / close",
        "BETA": f"{slope} / close",
        "RSQR": full(d, "CASE WHEN var_pop(close) OVER W > 0 THEN regr_r2(close, rn) OVER W END", "close").replace(f"END OVER {w(d)} END", "END END").replace("OVER W", f"OVER {w(d)}"),
        "RESI": f"(close - ({mean} + {slope} * {(d - 1) / 2}::DOUBLE)) / close",
        "MAX": f"{high} / close",
        "MIN": f"{low} / close",
        "QTLU": f"{full(d, 'quantile_cont(close, 0.8)', 'close')} / close",
        "QTLD": f"{full(d, 'quantile_cont(close, 0.2)', 'close')} / close",
        "RANK": f"CASE WHEN count(close) OVER {w(d)} >= {d} THEN (len(list_filter({values}, lambda x: x < close)) + (len(list_filter({values}, lambda x: x = close)) + 1) / 2.0::DOUBLE) / {d} END",
        "RSV": f"(close - {low}) / ({high} - {low} + {E})",
        "IMAX": f"{ih} / {d}",
        "IMIN": f"{il} / {d}",
        "IMXD": f"({ih} - {il}) / {d}",
        "CORR": _corr("close", "lnv", d),
        "CORD": _corr("rc", "rv", d),
        "CNTP": up,
        "CNTN": dn,
        "CNTD": f"{up} - {dn}",
        **parts("SUM", "dc"),
        "VMA": f"{full(d, 'avg(volume)', 'volume')} / (volume + {E})",
        "VSTD": f"{full(d, 'stddev_samp(volume)', 'volume')} / (volume + {E})",
        "WVMA": f"{full(d, 'stddev_samp(wv)', 'wv')} / ({full(d, 'avg(wv)', 'wv')} + {E})",
        **parts("VSUM", "dv"),
    }
    return {f"{k}{d}": v for k, v in out.items()}


FEATURE_SQL = {
    "KMID": "(close - open) / open",
    "KLEN": "(high - low) / open",
    "KMID2": f"(close - open) / (high - low + {E})",
    "KUP": "(high - greatest(open, close)) / open",
    "KUP2": f"(high - greatest(open, close)) / (high - low + {E})",
    "KLOW": "(least(open, close) - low) / open",
    "KLOW2": f"(least(open, close) - low) / (high - low + {E})",
    "KSFT": "(2 * close - high - low) / open",
    "KSFT2": f"(2 * close - high - low) / (high - low + {E})",
    "OPEN0": "open / close",
    "HIGH0": "high / close",
    "LOW0": "low / close",
    "VWAP0": "amount / nullif(volume, 0) / close",
} | {k: v for d in alpha.WINDOWS for k, v in _feature_sql(d).items()}

_GROUPS = {
    "alpha_kbar": list(alpha.SHAPES),
    "alpha_price": list(alpha.PRICES),
    "alpha_roll_price": ["ROC", "MA", "STD", "MAX", "MIN", "RSV"],
    "alpha_roll_reg": ["BETA", "RSQR", "RESI"],
    "alpha_roll_quantile_rank": ["QTLU", "QTLD", "RANK"],
    "alpha_idx": ["IMAX", "IMIN", "IMXD"],
    "alpha_corr": ["CORR", "CORD"],
    "alpha_count_sum": ["CNTP", "CNTN", "CNTD", "SUMP", "SUMN", "SUMD"],
    "alpha_volume": ["VMA", "VSTD", "WVMA", "VSUMP", "VSUMN", "VSUMD"],
}


def _alpha(name: str, kinds: list[str]) -> None:
    names = [f for f in alpha.feature_names() if f in kinds or f.rstrip("0123456789") in kinds and f not in alpha.SHAPES and f not in alpha.PRICES]
    sql = f"WITH {WEEK}, {_PREPARED}, f AS (SELECT symbol, date, {', '.join(f'{FEATURE_SQL[n]} AS {n}' for n in names)} FROM q) SELECT symbol, date, {', '.join(f'{r(n)} AS {n}' for n in names)} FROM f"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(alpha.panel(brand_week_bars(spark, sf_dir), names=names), *names)


for _name, _kinds in _GROUPS.items():
    _alpha(_name, _kinds)


@query("forward_return", f"WITH {WEEK} SELECT symbol, date, {r('lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) / close - 1')} AS label FROM bars")
def forward_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(alpha.forward_return(brand_week_bars(spark, sf_dir)), "label")
