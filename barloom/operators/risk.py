"""Sizes, stops and the way from a signal to a position."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.panel import clip, div, so_far
from barloom.functions.recurrence import ewm, per_symbol
from barloom.operators import technical as tech


def fixed_fraction(bars: DataFrame, fraction: float = 1.0) -> DataFrame:
    return bars.withColumn("size", F.lit(float(min(1.0, max(0.0, fraction)))))


def _within(size: Column, low: float, high: float) -> Column:
    return F.when(size.isNull(), low).otherwise(clip(size, low, high))


def volatility_target(bars: DataFrame, target: float = 0.2, period: int = 20, most: float = 1.0, least: float = 0.05) -> DataFrame:
    """The target over the symbol's yearly volatility."""
    out = tech.realised_vol(bars, period)
    return out.withColumn("size", _within(div(F.lit(target), F.col("realised_vol")), least, most)).select(*bars.columns, "size")


def atr_risk(bars: DataFrame, risk: float = 0.02, atr_mult: float = 2.0, period: int = 14, most: float = 1.0, least: float = 0.05) -> DataFrame:
    """The risk over a stop's distance, as a share of the close."""
    out = tech.atr(bars, period)
    distance = div(atr_mult * F.col("atr"), F.col("close"))
    return out.withColumn("size", _within(div(F.lit(risk), distance), least, most)).select(*bars.columns, "size")


def score_scaled(bars: DataFrame, score: str = "score", base: float = 1.0, least: float = 0.0) -> DataFrame:
    return bars.withColumn("size", clip(clip(F.abs(F.col(score)), 0.0, 1.0) * base, least, base))


def apply_stops(bars: DataFrame, position: str = "position", *, atr_mult: float = 2.5, atr_period: int = 14, trailing: bool = True, max_hold: int = 0, take_profit: float = 0.0) -> DataFrame:
    """``stopped`` and ``exit_reason``: the wanted position under an ATR stop, a target and a time limit.

    A trailing stop is raised by the bar's high before its low is tested; of
    several exits stop_loss comes first, then take_profit, time_stop and
    signal_exit.  After any but the last, the position stays 0 until the wanted
    one has been 0.
    """
    out = ewm(tech.true_range(bars, "__tr"), {"__atr": ("__tr", 1 / atr_period)})

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        high, low, close = (frame[c].to_numpy(float) for c in ("high", "low", "close"))
        reach = np.nan_to_num(frame["__atr"].to_numpy(float))
        want = frame[position].fillna(0.0).to_numpy(float)
        held, why = np.zeros(len(frame)), [""] * len(frame)
        inside = locked = False
        stop = target = peak = 0.0
        age = 0
        for i, w in enumerate(want):
            if inside:
                age += 1
                peak = max(peak, high[i])
                if trailing:
                    stop = max(stop, peak - atr_mult * reach[i])
                exits = (("stop_loss", low[i] <= stop), ("take_profit", take_profit > 0 and high[i] >= target), ("time_stop", 0 < max_hold <= age), ("signal_exit", w <= 0))
                why[i] = next((name for name, hit in exits if hit), "")
                if why[i]:
                    inside, locked = False, why[i] != "signal_exit"
                else:
                    held[i] = w
            elif w <= 0:
                locked = False
            elif not locked:
                inside, age, peak = True, 0, high[i]
                stop, target = close[i] - atr_mult * reach[i], close[i] + take_profit * reach[i]
                held[i] = w
        return frame.assign(stopped=held, exit_reason=why)

    return per_symbol(out, fold, {"stopped": "double", "exit_reason": "string"}).select(*bars.columns, "stopped", "exit_reason")


def drawdown_throttle(frame: DataFrame, equity: str = "close", position: str = "position", warn: float = 0.1, halt: float = 0.2, scale: float = 0.5) -> DataFrame:
    """``throttled``: the position times ``scale`` from a drawdown of ``warn`` on, 0 from ``halt`` on."""
    drawdown = F.coalesce(div(F.col(equity), F.max(equity).over(so_far())) - 1, F.lit(0.0))
    factor = F.when(drawdown <= -halt, 0.0).when(drawdown <= -warn, scale).otherwise(1.0)
    return frame.withColumn("throttled", clip(F.col(position) * factor, 0.0, 1.0))


def build_positions(frame: DataFrame, sizing: str = "fixed", sizing_options: dict[str, Any] | None = None, stops: bool = True, stop_options: dict[str, Any] | None = None) -> DataFrame:
    """``position`` of a frame with ``signal`` or ``score``: direction times size, under stops."""
    from barloom.operators.signals import held

    kept = [c for c in frame.columns if c not in ("signal", "score")]
    score = held(F.col("signal")) if "signal" in frame.columns else F.coalesce("score", F.lit(0.0))
    out = frame.withColumn("__score", score)
    makers = {"fixed": fixed_fraction, "vol_target": volatility_target, "atr_risk": atr_risk, "score": lambda b, **o: score_scaled(b, "__score", **o)}
    out = makers[sizing](out, **(sizing_options or {}))
    out = out.withColumn("position", clip(F.when(F.col("__score") > 0, F.col("size")).otherwise(0.0), 0.0, 1.0))
    if stops:
        out = apply_stops(out, "position", **(stop_options or {})).withColumn("position", F.col("stopped"))
    return out.select(*kept, "position")


def managed(strategy, **options):
    """A strategy with sizes and stops: adds ``position``."""
    return lambda bars: build_positions(strategy(bars), **options)
