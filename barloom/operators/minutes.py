"""Features of minute bars, and scores of several frequencies brought to the day."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.panel import div, lag, over_full, rolling_corr
from barloom.functions.recurrence import ewm, span
from barloom.operators import technical as tech
from barloom.operators.ml import weighted_ensemble

EPS = 1e-10


def minute_features(bars: DataFrame) -> DataFrame:
    """The 35 features of bars of one or five minutes; rows that lack one are left out.

    Windows are short (30 bars at most), averages adjusted exponential ones or
    simple means; a symbol's sessions follow each other without a gap.
    """
    c, o, h, low, v = (F.col(x) for x in ("close", "open", "high", "low", "volume"))
    mean = lambda x, n: over_full(n, F.avg(x), x)
    out = tech.true_range(bars, "__tr").withColumns({f"ret{p}": div(c, lag("close", p)) - 1 for p in (1, 2, 3, 5, 10, 30)} | {f"ma{p}": mean("close", p) for p in (3, 5, 10, 30)})
    change = c - lag("close")
    top, bottom = over_full(9, F.max("high"), "high"), over_full(9, F.min("low"), "low")
    rows = {"__sd": over_full(10, F.stddev_samp("close"), "close"), "__gain": F.coalesce(F.greatest(change, F.lit(0.0)), F.lit(0.0)), "__loss": F.coalesce(F.greatest(-change, F.lit(0.0)), F.lit(0.0)), "__rsv": 100 * (c - bottom) / (top - bottom + EPS)}
    out = ewm(out.withColumns(rows), {"__e12": ("close", span(12)), "__e26": ("close", span(26)), "k": ("__rsv", span(3))}, adjust=True).withColumn("dif", F.col("__e12") - F.col("__e26"))
    out = ewm(out, {"dea": ("dif", span(9)), "d": ("k", span(3))}, adjust=True)
    spread, ma, sd = h - low + EPS, F.col("ma10"), F.col("__sd")
    made = {f"close_ma{p}": div(c, F.col(f"ma{p}")) for p in (5, 10, 30)}
    made |= {"ma_cross": F.col("ma5") - F.col("ma10"), "hist": 2 * (F.col("dif") - F.col("dea"))}
    made |= {"bb_upper": (ma + 2 * sd) / c - 1, "bb_lower": (ma - 2 * sd) / c - 1, "bb_width": (4 * sd / c) / (ma / c + 1), "atr": mean("__tr", 10) / c}
    made |= {f"volatility{p}": over_full(p, F.stddev_samp("ret1"), "ret1") * math.sqrt(p) for p in (5, 10, 30)}
    made |= {"vma5": mean("volume", 5), "vma30": mean("volume", 30), "v_ratio": div(v, mean("volume", 5)), "v_price_corr": rolling_corr("volume", "close", 10)}
    made |= {"rsi14": 100 - 100 / (1 + mean("__gain", 14) / (mean("__loss", 14) + EPS))}
    made |= {"hl_ratio": (h - low) / c, "co_ratio": (c - o) / spread, "up_shadow": (h - c) / (c - low + EPS), "body": F.abs(c - o) / spread}
    out = out.withColumns(made)
    return out.select("symbol", "date", *(n for n in out.columns if n not in bars.columns and not n.startswith("__"))).dropna()


def day_scores(daily: DataFrame, *minute: DataFrame) -> DataFrame:
    """``daily`` (symbol, date, score) with ``score1``, ``score2``, ...: the last score of each minute table (symbol, ts, score) within the day."""
    out = daily
    for k, scores in enumerate(minute, 1):
        last = scores.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.max_by("score", "ts").alias(f"score{k}"))
        out = out.join(last, ["symbol", "date"], "left")
    return out


def ensemble_of_day(aligned: DataFrame, weights: dict[str, float], top: int = 10) -> DataFrame:
    """The best of the last date of :func:`day_scores` by the weighted mean of the scores."""
    last = aligned.agg(F.max("date").alias("date"))  # one row
    return weighted_ensemble(aligned.join(F.broadcast(last), "date", "left_semi"), weights, top)
