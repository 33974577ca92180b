"""Features for models, boosted trees on a panel, and what is done with scores."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.panel import clip, div, lag, last_n, over_full, rolling_corr
from barloom.functions.recurrence import ewm, span
from barloom.operators import technical as tech
from barloom.operators.crosssection import purged_split, robust_fit, robust_transform


def session_features(bars: DataFrame) -> DataFrame:
    """The 43 daily features of the sequence models; rows that lack one are left out.

    Averages here are adjusted exponential ones (weights sum to one from the
    first bar), and strength and range use simple means.
    """
    eps = 1e-10
    c, o, h, low, v = (F.col(x) for x in ("close", "open", "high", "low", "volume"))
    mean = lambda x, n: over_full(n, F.avg(x), x)
    out = tech.true_range(bars, "__tr").withColumns({f"ret{p}": div(c, lag("close", p)) - 1 for p in (1, 2, 3, 5, 10, 20)})
    out = out.withColumns({f"ma{p}": mean("close", p) for p in (3, 5, 10, 20, 60)})
    out = out.withColumns({f"close_ma{p}": div(c, F.col(f"ma{p}")) for p in (5, 10, 20, 60)} | {"ma_cross": F.col("ma5") - F.col("ma20")})
    change = c - lag("close")
    top, bottom = over_full(9, F.max("high"), "high"), over_full(9, F.min("low"), "low")
    out = out.withColumns(
        {
            "__sd": over_full(20, F.stddev_samp("close"), "close"),
            "__gain": F.coalesce(F.greatest(change, F.lit(0.0)), F.lit(0.0)),
            "__loss": F.coalesce(F.greatest(-change, F.lit(0.0)), F.lit(0.0)),
            "__rsv": 100 * (c - bottom) / (top - bottom + eps),
            "__up": F.coalesce((F.col("ret1") > 0).cast("int"), F.lit(0)),
            "__down": F.coalesce((F.col("ret1") < 0).cast("int"), F.lit(0)),
        }
    )
    out = ewm(out, {"__e12": ("close", span(12)), "__e26": ("close", span(26)), "k": ("__rsv", span(3))}, adjust=True).withColumn("dif", F.col("__e12") - F.col("__e26"))
    out = ewm(out, {"dea": ("dif", span(9)), "d": ("k", span(3))}, adjust=True)
    spread = h - low + eps
    made = {
        "hist": 2 * (F.col("dif") - F.col("dea")),
        "bb_upper": (F.col("ma20") + 2 * F.col("__sd")) / c - 1,
        "bb_lower": (F.col("ma20") - 2 * F.col("__sd")) / c - 1,
        "bb_width": (4 * F.col("__sd") / c) / (F.col("ma20") / c + 1),
        "atr": mean("__tr", 14) / c,
        **{f"volatility{p}": over_full(p, F.stddev_samp("ret1"), "ret1") * math.sqrt(p) for p in (5, 10, 20)},
        "vma5": mean("volume", 5),
        "vma20": mean("volume", 20),
        "v_ratio": div(v, mean("volume", 5)),
        "v_price_corr": rolling_corr("volume", "close", 10),
        "rsi14": 100 - 100 / (1 + mean("__gain", 14) / (mean("__loss", 14) + eps)),
        "j": 3 * F.col("k") - 2 * F.col("d"),
        "bias5": F.col("close_ma5") - 1,
        "bias10": F.col("close_ma10") - 1,
        "hl_ratio": (h - low) / c,
        "co_ratio": (c - o) / spread,
        "up_shadow": (h - c) / (c - low + eps),
        "low_shadow": (o - low) / spread,
        "body": F.abs(c - o) / spread,
        "up_count": F.when(F.count(F.lit(1)).over(last_n(5)) == 5, F.sum("__up").over(last_n(5))),
        "down_count": F.when(F.count(F.lit(1)).over(last_n(5)) == 5, F.sum("__down").over(last_n(5))),
    }
    out = out.withColumns(made)
    names = [n for n in out.columns if n not in bars.columns and not n.startswith("__")]
    return out.select("symbol", "date", *names).dropna()


def orthogonalise(frame: DataFrame, features: list[str], market: str | None = None) -> DataFrame:
    """Each feature less its slope on the market times the market's distance from its mean; a feature with a gap becomes 0.

    The market is the mean of the features where no column is named.
    """
    known = [F.when(~F.isnan(f), F.col(f)) for f in features]
    parts = F.filter(F.array(*known), lambda x: x.isNotNull())
    factor = F.col(market) if market else F.try_divide(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.size(parts).cast("double"))
    out = frame.withColumn("__m", factor)
    gap = lambda f: F.max((F.col(f).isNull() | F.isnan(f) | (F.abs(F.col(f)) == float("inf"))).cast("int"))
    stats = out.agg(F.avg("__m").alias("__mean"), (F.var_pop("__m") + 1e-12).alias("__var"), *(F.covar_pop(f, "__m").alias(f"__c_{f}") for f in features), *(gap(f).alias(f"__g_{f}") for f in features))
    joined = out.crossJoin(F.broadcast(stats))  # one row
    fixed = {f: F.when(F.col(f"__g_{f}") == 1, 0.0).otherwise(F.col(f) - F.col(f"__c_{f}") / F.col("__var") * (F.col("__m") - F.col("__mean"))) for f in features}
    return joined.withColumns(fixed).select(*frame.columns)


TRENDS = ("strong_down", "weak_down", "neutral", "weak_up", "strong_up")


def score_to_trend(scores: DataFrame, score: str = "score") -> DataFrame:
    """``trend`` by the quintile of the score among all, and ``trend_prob``: how far into it, within [0, 1]."""
    cuts = scores.agg(F.percentile(score, F.array(*map(F.lit, (0.2, 0.4, 0.5, 0.6, 0.8)))).alias("__q"), F.min(score).alias("__min"), F.max(score).alias("__max"))
    out = scores.crossJoin(F.broadcast(cuts))  # one row
    s, eps = F.col(score), 1e-9
    q20, q40, q50, q60, q80 = (F.col("__q")[k] for k in range(5))
    label = F.when(s >= q80, TRENDS[4]).when(s >= q60, TRENDS[3]).when(s >= q40, TRENDS[2]).when(s >= q20, TRENDS[1]).otherwise(TRENDS[0])
    deep = (
        F.when(s >= q80, F.when(F.col("__max") > q80, (s - q80) / (F.col("__max") - q80 + eps)).otherwise(0.5))
        .when(s >= q60, (s - q60) / (q80 - q60 + eps))
        .when(s >= q40, 1 - F.abs(s - q50) / (q60 - q40 + eps))
        .when(s >= q20, (q40 - s) / (q40 - q20 + eps))
        .otherwise(F.when(q20 > F.col("__min"), (q20 - s) / (q20 - F.col("__min") + eps)).otherwise(0.5))
    )
    return out.withColumns({"trend": label, "trend_prob": clip(deep, 0.0, 1.0)}).drop("__q", "__min", "__max")


def seed_ensemble(scores: DataFrame, by: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """(by, score): the mean of the models' scores, each standardised over the batch; a model without spread adds 0.  scores: model, by, pred."""
    model = Window.partitionBy("model")
    z = F.coalesce(div(F.col("pred") - F.avg("pred").over(model), F.stddev_pop("pred").over(model)), F.lit(0.0))
    return scores.withColumn("__z", z).groupBy(*by).agg(F.avg("__z").alias("score"))


def weighted_ensemble(scores: DataFrame, weights: dict[str, float], top: int = 10) -> DataFrame:
    """(symbol, score): the weighted mean of the columns named; a missing score is 0 and keeps its weight."""
    total = sum(weights.values())
    parts = [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()]
    some = F.coalesce(*(F.col(c) for c in weights)).isNotNull()
    return scores.filter(some).select("symbol", (sum(parts[1:], parts[0]) / total).alias("score")).orderBy(F.col("score").desc(), "symbol").limit(top)


def latest_scores(predictions: DataFrame) -> DataFrame:
    """(model, symbol, date, pred): each symbol's last prediction of a model."""
    return predictions.groupBy("model", "symbol").agg(F.max("date").alias("date"), F.max_by("pred", "date").alias("pred"))


def scaled_parameters(rows: int, base: dict[str, Any] | None = None, full: int = 400_000) -> dict[str, Any]:
    """Boosting parameters for so many rows: shallower trees and larger leaves than for ``full``."""
    base = {"maxIter": 40, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 200} | (base or {})
    share = min(1.0, rows / full)
    depth = max(2, min(base["maxDepth"], int(math.log2(max(4.0, 2 ** base["maxDepth"] * max(share, 0.05))))))
    return base | {"maxDepth": depth, "minInstancesPerNode": max(5, int(base["minInstancesPerNode"] * max(share, 0.05)))}


def train_gbt(panel: DataFrame, features: list[str], label: str = "label", embargo: int = 5, seed: int = 7, **parameters) -> DataFrame:
    """symbol, date, split, label, pred: boosted trees fitted on the training dates, scores of all three parts.

    The features are scaled by the training part's medians; purged dates have no
    part and no row.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = purged_split(panel.dropna(subset=[label]), embargo=embargo).filter("split is not null")
    rows = robust_transform(rows, robust_fit(rows.filter("split = 'train'"), *features), *features)
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(rows).select("symbol", "date", "split", label, "features")
    train = rows.filter("split = 'train'").cache()
    model = GBTRegressor(labelCol=label, seed=seed, **(scaled_parameters(train.count()) | parameters)).fit(train)
    train.unpersist()
    return model.transform(rows).select("symbol", "date", "split", F.col(label).alias("label"), F.col("prediction").alias("pred"))
