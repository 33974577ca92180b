"""Technical factors: each function adds columns to bars.  Windows look back only."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.panel import div, holds, lag, over_full, rows, so_far
from barloom.functions.recurrence import ewm, per_symbol, span

YEAR = 252


def bollinger(bars: DataFrame, period: int = 20, k: float = 2.0) -> DataFrame:
    """bb_mid, bb_upper, bb_lower and bb_width: mean and k sample deviations."""
    mid = over_full(period, F.avg("close"), "close")
    band = k * over_full(period, F.stddev_samp("close"), "close")
    out = bars.withColumns({"bb_mid": mid, "__band": band})
    return out.withColumns({"bb_upper": F.col("bb_mid") + F.col("__band"), "bb_lower": F.col("bb_mid") - F.col("__band"), "bb_width": div(2 * F.col("__band"), F.col("bb_mid"))}).drop("__band")


def donchian(bars: DataFrame, period: int = 20, prefix: str = "dc") -> DataFrame:
    """{prefix}_upper, _lower, _mid of the ``period`` bars before the current one."""
    frame = rows(-period, -1)
    out = bars.withColumns({f"{prefix}_upper": over_full(period, F.max("high"), "high", frame=frame), f"{prefix}_lower": over_full(period, F.min("low"), "low", frame=frame)})
    return out.withColumn(f"{prefix}_mid", (F.col(f"{prefix}_upper") + F.col(f"{prefix}_lower")) / 2)


def cci(bars: DataFrame, period: int = 20) -> DataFrame:
    """Each deviation is from its own row's mean."""
    out = bars.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    out = out.withColumn("__ma", over_full(period, F.avg("__tp"), "__tp")).withColumn("__dev", F.abs(F.col("__tp") - F.col("__ma")))
    out = out.withColumn("__mad", over_full(period, F.avg("__dev"), "__dev"))
    return out.withColumn("cci", div(F.col("__tp") - F.col("__ma"), 0.015 * F.col("__mad"))).drop("__tp", "__ma", "__dev", "__mad")


def williams_r(bars: DataFrame, period: int = 14) -> DataFrame:
    high, low = over_full(period, F.max("high"), "high"), over_full(period, F.min("low"), "low")
    return bars.withColumn("williams_r", div(-100 * (high - F.col("close")), high - low))


def stochastic(bars: DataFrame, k_period: int = 14, d_period: int = 3) -> DataFrame:
    high, low = over_full(k_period, F.max("high"), "high"), over_full(k_period, F.min("low"), "low")
    out = bars.withColumn("stoch_k", div(100 * (F.col("close") - low), high - low))
    return out.withColumn("stoch_d", over_full(d_period, F.avg("stoch_k"), "stoch_k"))


def roc(bars: DataFrame, period: int = 12) -> DataFrame:
    return bars.withColumn("roc", 100 * (div(F.col("close"), lag("close", period)) - 1))


def momentum(bars: DataFrame, period: int = 20, skip: int = 0) -> DataFrame:
    now = lag("close", skip) if skip else F.col("close")
    return bars.withColumn("momentum", div(now, lag("close", skip + period)) - 1)


def zscore(bars: DataFrame, period: int = 20, column: str = "close") -> DataFrame:
    return bars.withColumn("zscore", div(F.col(column) - over_full(period, F.avg(column), column), over_full(period, F.stddev_samp(column), column)))


def realised_vol(bars: DataFrame, period: int = 20, annualise: bool = True) -> DataFrame:
    out = bars.withColumn("__r", F.ln(div(F.col("close"), lag("close"))))
    return out.withColumn("realised_vol", over_full(period, F.stddev_samp("__r"), "__r") * (math.sqrt(YEAR) if annualise else 1.0)).drop("__r")


def obv(bars: DataFrame) -> DataFrame:
    out = bars.withColumn("__flow", F.coalesce(F.signum(F.col("close") - lag("close")), F.lit(0.0)) * F.col("volume"))
    return out.withColumn("obv", F.sum("__flow").over(so_far())).drop("__flow")


def volume_ratio(bars: DataFrame, period: int = 5) -> DataFrame:
    return bars.withColumn("volume_ratio", div(F.col("volume"), over_full(period, F.avg("volume"), "volume", frame=rows(-period, -1))))


def true_range(bars: DataFrame, name: str = "tr") -> DataFrame:
    before = lag("close")
    return bars.withColumn(name, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def ema(bars: DataFrame, *periods: int) -> DataFrame:
    """ema{n} for each period."""
    return ewm(bars, {f"ema{n}": ("close", span(n)) for n in periods})


def rsi(bars: DataFrame, period: int = 14, name: str = "rsi") -> DataFrame:
    """50 where there was no loss, the first bar included."""
    change = F.col("close") - lag("close")
    gain, loss = (F.when(change.isNotNull(), F.greatest(x, F.lit(0.0))) for x in (change, -change))
    out = bars.withColumns({"__gain": gain, "__loss": loss})
    out = ewm(out, {"__g": ("__gain", 1 / period), "__l": ("__loss", 1 / period)})
    return out.withColumn(name, F.coalesce(100 - 100 / (1 + div(F.col("__g"), F.col("__l"))), F.lit(50.0))).drop("__gain", "__loss", "__g", "__l")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd_dif, macd_dea and macd_hist (twice their difference)."""
    out = ewm(bars, {"__f": ("close", span(fast)), "__s": ("close", span(slow))}).withColumn("macd_dif", F.col("__f") - F.col("__s"))
    out = ewm(out, {"macd_dea": ("macd_dif", span(signal))})
    return out.withColumn("macd_hist", 2 * (F.col("macd_dif") - F.col("macd_dea"))).drop("__f", "__s")


def atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """atr and natr (per cent of the close)."""
    out = ewm(true_range(bars, "__tr"), {"atr": ("__tr", 1 / period)})
    return out.withColumn("natr", 100 * div(F.col("atr"), F.col("close"))).drop("__tr")


def adx(bars: DataFrame, period: int = 14) -> DataFrame:
    """plus_di, minus_di and adx (0 until it is known); moves are cut at 0 before they are compared."""
    up = F.greatest(F.coalesce(F.col("high") - lag("high"), F.lit(0.0)), F.lit(0.0))
    down = F.greatest(F.coalesce(lag("low") - F.col("low"), F.lit(0.0)), F.lit(0.0))
    out = true_range(bars, "__tr").withColumns({"__up": up, "__down": down})
    out = out.withColumns({"__plus": F.when(F.col("__up") > F.col("__down"), F.col("__up")).otherwise(0.0), "__minus": F.when(F.col("__down") > F.col("__up"), F.col("__down")).otherwise(0.0)})
    a = 1 / period
    out = ewm(out, {"__str": ("__tr", a), "__sp": ("__plus", a), "__sm": ("__minus", a)})
    out = out.withColumns({"plus_di": 100 * div(F.col("__sp"), F.col("__str")), "minus_di": 100 * div(F.col("__sm"), F.col("__str"))})
    out = out.withColumn("__dx", 100 * div(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    out = ewm(out, {"__adx": ("__dx", a)})
    return out.withColumn("adx", F.coalesce("__adx", F.lit(0.0))).drop("__tr", "__up", "__down", "__plus", "__minus", "__str", "__sp", "__sm", "__dx", "__adx")


def kdj(bars: DataFrame, n: int = 9, m1: int = 3, m2: int = 3) -> DataFrame:
    """kdj_k, kdj_d, kdj_j; what of K is unknown counts as 50 before D is smoothed."""
    high, low = over_full(n, F.max("high"), "high"), over_full(n, F.min("low"), "low")
    out = ewm(bars.withColumn("__rsv", 100 * div(F.col("close") - low, high - low)), {"__k": ("__rsv", 1 / m1)})
    out = ewm(out.withColumn("kdj_k", F.coalesce("__k", F.lit(50.0))), {"kdj_d": ("kdj_k", 1 / m2)})
    return out.withColumn("kdj_j", 3 * F.col("kdj_k") - 2 * F.col("kdj_d")).drop("__rsv", "__k")


def keltner(bars: DataFrame, period: int = 20, mult: float = 2.0) -> DataFrame:
    """kc_mid, kc_upper, kc_lower: EMA and ``mult`` ATR of one period."""
    out = ewm(true_range(bars, "__tr"), {"kc_mid": ("close", span(period)), "__atr": ("__tr", 1 / period)})
    return out.withColumns({"kc_upper": F.col("kc_mid") + mult * F.col("__atr"), "kc_lower": F.col("kc_mid") - mult * F.col("__atr")}).drop("__tr", "__atr")


def supertrend(bars: DataFrame, period: int = 10, mult: float = 3.0) -> DataFrame:
    """st_line and st_trend (+1, -1): bands that only tighten while the close stays on their side."""
    out = ewm(true_range(bars, "__tr"), {"__atr": ("__tr", 1 / period)})

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        close = frame["close"].to_numpy()
        mid = (frame["high"].to_numpy() + frame["low"].to_numpy()) / 2
        reach = mult * frame["__atr"].to_numpy()
        line, trend = np.empty(len(frame)), np.empty(len(frame), np.int64)
        upper = lower = math.nan
        side = 1
        for i in range(len(frame)):
            new_upper, new_lower = mid[i] + reach[i], mid[i] - reach[i]
            if i:
                new_upper = new_upper if close[i - 1] > upper else min(new_upper, upper)
                new_lower = new_lower if close[i - 1] < lower else max(new_lower, lower)
                if side > 0:
                    side = -1 if close[i] < new_lower else 1
                else:
                    side = 1 if close[i] > new_upper else -1
            upper, lower = new_upper, new_lower
            line[i], trend[i] = (lower if side > 0 else upper), side
        return frame.assign(st_line=line, st_trend=trend)

    return per_symbol(out, fold, {"st_line": "double", "st_trend": "long"}).drop("__tr", "__atr")


def cross(a: Column, b: Column, before_a: Column, before_b: Column) -> tuple[Column, Column]:
    """(a rises over b, a falls under b) between the bar before and this one."""
    return holds((before_a <= before_b) & (a > b)), holds((before_a >= before_b) & (a < b))

