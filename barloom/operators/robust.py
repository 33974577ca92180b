"""Does a strategy hold up?  Sweeps, splits in time and random entries, each a job over (case, symbol)."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.costs import Fees
from barloom.functions.panel import in_order
from barloom.operators import backtest as bt
from barloom.operators.signals import BUY, HOLD, SELL, Strategy

LEAST_BARS = 30


def long_enough(bars: DataFrame) -> DataFrame:
    return bars.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).filter(F.col("__n") >= LEAST_BARS).drop("__n")


def run_metrics(frame: DataFrame, costs: Fees | None = None) -> DataFrame:
    """:func:`barloom.operators.backtest.metrics` of each symbol of bars with a signal."""
    run = bt.vectorised(frame, costs)
    return bt.metrics(run, bt.trades_of(run))


def multi_symbol(bars: DataFrame, strategy: Strategy, costs: Fees | None = None, metric: str = "sharpe") -> DataFrame:
    """One row: how the metric is spread over the symbols."""
    each = run_metrics(strategy(long_enough(bars)), costs)
    return each.agg(
        F.count(F.lit(1)).alias("n_symbols"),
        F.percentile(metric, F.lit(0.5)).alias("median"),
        F.avg(metric).alias("mean"),
        F.stddev_samp(metric).alias("std"),
        F.min(metric).alias("min"),
        F.max(metric).alias("max"),
        F.avg((F.col(metric) > 0).cast("double")).alias("positive_share"),
        F.avg((F.col("total_return") > 0).cast("double")).alias("profitable_share"),
        F.min("max_drawdown").alias("worst_drawdown"),
        F.sum("num_trades").alias("num_trades"),
    )


def expand_grid(grid: dict[str, list[Any]]) -> list[dict[str, Any]]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def _case(name: str) -> Any:
    return F.concat_ws("\t", "symbol", F.lit(name))


def _uncased(frame: DataFrame) -> DataFrame:
    return frame.withColumns({"case": F.substring_index("symbol", "\t", -1), "symbol": F.substring_index("symbol", "\t", 1)})


def param_sweep(bars: DataFrame, factory: Callable[..., Strategy], grid: dict[str, list[Any]], costs: Fees | None = None) -> DataFrame:
    """Metrics of each (case, symbol), the case named like ``fast=5,slow=20``: one back-test over all of them."""
    kept = long_enough(bars)
    cases = []
    for params in expand_grid(grid):
        name = ",".join(f"{k}={v}" for k, v in params.items())
        cases.append(factory(**params)(kept).withColumn("symbol", _case(name)))
    union = cases[0]
    for case in cases[1:]:
        union = union.unionByName(case)
    return _uncased(run_metrics(union, costs))


def plateau(sweep: DataFrame, params: list[str], metric: str = "sharpe", share: float = 0.2) -> DataFrame:
    """(symbol, plateau): 1 less the mean spread of the best cases' parameters over that of an even one (0.29 of the range), within [0, 1].

    Parameters that are no numbers or have one value only are left out; 0 where none is left.
    """
    best = Window.partitionBy("symbol").orderBy(F.col(metric).desc(), "case")
    rows = sweep.withColumns({"__place": F.row_number().over(best), "__cases": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    value = lambda p: F.expr(f"try_cast(regexp_extract(case, '(?:^|,){p}=([^,]*)', 1) AS double)")
    rows = rows.withColumns({f"__of_{p}": value(p) for p in params})
    top = F.col("__place") <= F.greatest(F.lit(2), F.floor(F.col("__cases") * share))
    spread = [F.try_divide(F.stddev_pop(F.when(top, F.col(f"__of_{p}"))), F.max(f"__of_{p}") - F.min(f"__of_{p}")) for p in params]
    known = rows.groupBy("symbol").agg(F.array_compact(F.array(*spread).cast("array<double>")).alias("s"))
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s")
    return known.select("symbol", F.when(F.size("s") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean / 0.29))).otherwise(0.0).alias("plateau"))


def optimise(bars: DataFrame, factory: Callable[..., Strategy], grid: dict[str, list[Any]], test_ratio: float = 0.3, embargo: int = 5, metric: str = "sharpe", costs: Fees | None = None) -> DataFrame:
    """(symbol, case, in_sample, out_of_sample): the best case of the first part of each symbol's bars, and how it did on the rest."""
    part = bars.withColumns({"__k": F.row_number().over(in_order()), "__n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    cut = F.floor(F.col("__n") * (1 - test_ratio))
    first = part.filter(F.col("__k") <= cut - embargo).drop("__k", "__n")
    last = part.filter(F.col("__k") > cut - embargo).drop("__k", "__n")
    seen = param_sweep(first, factory, grid, costs).select("symbol", "case", F.col(metric).alias("in_sample"))
    best = Window.partitionBy("symbol").orderBy(F.col("in_sample").desc(), "case")
    chosen = seen.withColumn("__k", F.row_number().over(best)).filter("__k = 1").drop("__k")
    later = param_sweep(last, factory, grid, costs).select("symbol", "case", F.col(metric).alias("out_of_sample"))
    return chosen.join(later, ["symbol", "case"], "left")


def walk_forward(bars: DataFrame, strategy: Strategy, splits: int = 5, train: int = 120, test: int = 40, embargo: int = 5, costs: Fees | None = None) -> DataFrame:
    """(symbol, fold, total_return, num_bars): test parts from each symbol's end backwards, run with their training bars before them."""
    run = bt.vectorised(strategy(long_enough(bars)), costs)
    run = run.withColumns({"__k": F.row_number().over(in_order().orderBy(F.col("date").desc())), "__n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    fold = F.floor((F.col("__k") - 1) / test).cast("int")
    parts = run.withColumn("fold", fold).filter((F.col("fold") < splits) & (F.col("__n") - (F.col("fold") + 1) * test - embargo >= train))
    return parts.groupBy("symbol", "fold").agg((F.try_divide(F.max_by("equity", "date"), F.min_by("equity", "date")) - 1).alias("total_return"), F.count(F.lit(1)).alias("num_bars"))


def random_benchmark(bars: DataFrame, strategy: Strategy, trials: int = 200, metric: str = "sharpe", seed: int = 42, costs: Fees | None = None) -> DataFrame:
    """(symbol, actual, percentile, p_value) against ``trials`` runs that enter and leave at random as often as the strategy does.

    The chance of a bar is a hash of seed, trial, symbol and date, so reruns agree
    whatever the partitions.
    """
    framed = strategy(long_enough(bars))
    actual = run_metrics(framed, costs).select("symbol", F.col(metric).alias("actual"))
    rates = framed.groupBy("symbol").agg(*(F.avg((F.col("signal") == s).cast("double")).alias(n) for s, n in ((BUY, "__buy"), (SELL, "__sell"))))
    many = framed.drop("signal").join(F.broadcast(rates), "symbol").withColumn("__trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("__trial"), F.col("symbol"), F.col("date")), F.lit(1_000_000)) / 1e6
    many = many.withColumn("signal", F.when(chance < F.col("__buy"), BUY).when(chance < F.col("__buy") + F.col("__sell"), SELL).otherwise(HOLD))
    many = many.withColumn("symbol", F.concat_ws("\t", "symbol", F.col("__trial").cast("string"))).drop("__trial", "__buy", "__sell")
    rows = _uncased(run_metrics(many, costs)).join(actual, "symbol")
    beaten = F.avg((F.col(metric) < F.col("actual")).cast("double"))
    return rows.groupBy("symbol", "actual").agg(F.avg(metric).alias("random_mean"), (100 * beaten).alias("percentile"), ((F.count(F.when(F.col(metric) >= F.col("actual"), 1)) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def optimise_verdict(chosen: DataFrame, plateaus: DataFrame) -> DataFrame:
    """:func:`optimise` and :func:`plateau` with ``degradation`` (the loss out of sample over the size in sample) and ``verdict``.

    The first that holds: losing, overfitted (a loss out of sample), decayed (by
    more than half), spike (a plateau below 0.3), fading (by more than 0.3),
    holding.  Without a size in sample the degradation is 0 or 1.
    """
    i, o = F.col("in_sample"), F.col("out_of_sample")
    size = F.abs(i)
    lost = F.when(size > 1e-12, (i - o) / size).otherwise((o < i).cast("double"))
    rows = chosen.join(plateaus.select("symbol", "plateau"), "symbol", "left").withColumn("degradation", lost)
    d = F.col("degradation")
    ladder = F.when(i <= 0, "losing").when(o <= 0, "overfitted").when(d > 0.5, "decayed").when(F.col("plateau") < 0.3, "spike").when(d > 0.3, "fading").otherwise("holding")
    return rows.withColumn("verdict", F.when(i.isNotNull() & o.isNotNull(), ladder))


def walk_forward_verdict(folds: DataFrame, metric: str = "total_return") -> DataFrame:
    """(symbol, n, median, std, positive_share, verdict) of the folds of :func:`walk_forward`.

    The first that holds: few_windows (under 3), losing, few_winners, unstable
    (a deviation beyond twice the median), steady.
    """
    m = F.col(metric)
    rows = folds.filter(m.isNotNull() & ~F.isnan(m)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.percentile(m, F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias("std"), F.avg((m > 0).cast("double")).alias("positive_share"))
    ladder = F.when(F.col("n") < 3, "few_windows").when(F.col("median") <= 0, "losing").when(F.col("positive_share") < 0.5, "few_winners").when(F.col("std") > 2 * F.abs("median"), "unstable")
    return rows.withColumn("verdict", F.coalesce(ladder, F.lit("steady")))
