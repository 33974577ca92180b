"""Do predictions rank what happens next?  Daily information coefficients, their significance, and quantile portfolios."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.panel import average_rank, grouped_corr

MIN_STOCKS = 5
YEAR = 252


def _complete(panel: DataFrame, pred: str, label: str, *keep: str) -> DataFrame:
    """Rows where both are finite, as p and l."""
    rows = panel.select(*keep, F.col(pred).cast("double").alias("p"), F.col(label).cast("double").alias("l"))
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return rows.filter(good("p") & good("l"))


def daily_ic(panel: DataFrame, pred: str = "pred", label: str = "label", method: str = "spearman", min_stocks: int = MIN_STOCKS) -> DataFrame:
    """(date, ic): 0 where a side has one value only; days with fewer rows are left out."""
    rows = _complete(panel, pred, label, "date")
    if method == "spearman":
        rows = rows.withColumns({"p": average_rank("p", "date"), "l": average_rank("l", "date")})
    days = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), grouped_corr(F.col("p"), F.col("l")).alias("ic"))
    return days.filter(F.col("n") >= min_stocks).select("date", F.coalesce("ic", F.lit(0.0)).alias("ic"))


def ic_summary(daily: DataFrame, horizon: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """ic_mean, ic_std, icir, t_stat, t_stat_nw, ic_win_rate, ic_ir_annual, n_days of daily coefficients (per ``by``).

    The Newey-West t weighs autocovariances up to ``horizon`` - 1 lags (each the
    mean of its own products) by Bartlett's triangle.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = group.orderBy("date")
    lags = range(1, max(1, horizon))
    rows = daily.filter("ic is not null").withColumns({"n": F.count(F.lit(1)).over(group), "dev": F.col("ic") - F.avg("ic").over(group)})
    rows = rows.withColumns({f"c{k}": F.col("dev") * F.lag("dev", k).over(order) for k in lags}) if len(lags) else rows
    out = rows.groupBy(*by).agg(
        F.avg("ic").alias("ic_mean"),
        F.stddev_samp("ic").alias("s"),
        F.avg((F.col("ic") > 0).cast("double")).alias("ic_win_rate"),
        F.count(F.lit(1)).alias("n_days"),
        F.avg(F.col("dev") * F.col("dev")).alias("g0"),
        *(F.avg(f"c{k}").alias(f"g{k}") for k in lags),
    )
    std = F.when(F.col("s") >= 1e-12, F.col("s")).otherwise(0.0)
    out = out.withColumn("ic_std", std)
    some = F.col("ic_std") > 0
    icir = F.when(some, F.try_divide("ic_mean", "ic_std")).otherwise(0.0)
    factor: Column = F.lit(1.0)
    for k in lags:
        top = F.least(F.lit(horizon - 1), F.col("n_days") - 1)
        weight = F.when(top >= k, 1 - k / (top + 1.0)).otherwise(0.0)
        factor = factor + 2 * weight * F.coalesce(F.try_divide(f"g{k}", "g0"), F.lit(0.0))
    root = F.sqrt(F.col("n_days").cast("double"))
    plain = icir * root
    adjusted = F.try_divide(F.col("ic_mean"), F.sqrt(F.when(F.col("factor") > 0, F.col("g0") * F.col("factor")).otherwise(F.col("g0")) / F.col("n_days")))
    nw = plain if horizon <= 1 else F.when(F.col("n_days") < 3, plain).when(F.col("g0") > 1e-24, adjusted).otherwise(0.0)
    out = out.withColumn("factor", factor)
    return out.select(*by, "ic_mean", "ic_std", icir.alias("icir"), plain.alias("t_stat"), F.when(some, nw).otherwise(0.0).alias("t_stat_nw"), "ic_win_rate", (icir * math.sqrt(YEAR)).alias("ic_ir_annual"), "n_days")


def quantile_means(panel: DataFrame, pred: str = "pred", label: str = "label", groups: int = 5, min_stocks: int = MIN_STOCKS, key: str = "symbol") -> DataFrame:
    """(bucket, group_mean, n_days): the mean over days of each bucket's mean label.

    A row's bucket is its rank (first come by ``key``) times the groups over the
    day's count, cut to whole and to the last bucket.
    """
    rows = _complete(panel, pred, label, "date", key)
    day = Window.partitionBy("date")
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(day), "rank": F.row_number().over(day.orderBy("p", key))}).filter(F.col("n") >= max(min_stocks, groups))
    bucket = F.least(F.floor(F.col("rank") / F.col("n") * groups), F.lit(groups - 1)).cast("int")
    days = rows.groupBy("date", bucket.alias("bucket")).agg(F.avg("l").alias("m"))
    return days.groupBy("bucket").agg(F.avg("m").alias("group_mean"), F.count(F.lit(1)).alias("n_days"))


def evaluate(panel: DataFrame, pred: str = "pred", label: str = "label", groups: int = 5, horizon: int = 1) -> DataFrame:
    """One row: :func:`ic_summary`, the mean Pearson coefficient, long_short and whether bucket means fall at most once."""
    summary = ic_summary(daily_ic(panel, pred, label), horizon)
    pearson = daily_ic(panel, pred, label, "pearson").agg(F.avg("ic").alias("pearson_ic_mean"))
    means = quantile_means(panel, pred, label, groups).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "group_mean"))), lambda x: x["group_mean"]).alias("m"))
    falls = F.size(F.filter(F.zip_with(F.slice("m", 2, groups), F.slice("m", 1, groups), lambda a, b: a < b), lambda x: x))
    means = means.select((F.element_at("m", -1) - F.element_at("m", 1)).alias("long_short"), (falls <= 1).alias("monotonic"))
    return summary.crossJoin(pearson).crossJoin(means)  # one row each


def verdict(report: DataFrame) -> DataFrame:
    """``verdict``: the first that holds of few_days, insignificant, negative, unstable, weak, not_monotonic, usable (by the plain t)."""
    ladder = (
        F.when(F.col("n_days") < 20, "few_days")
        .when(F.abs("t_stat") < 2, "insignificant")
        .when(F.col("ic_mean") <= 0, "negative")
        .when(F.col("icir") < 0.2, "unstable")
        .when(F.col("ic_mean") < 0.02, "weak")
        .when(~F.col("monotonic"), "not_monotonic")
    )
    return report.withColumn("verdict", F.coalesce(ladder, F.lit("usable")))


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks down each column, ties averaged."""
    n = len(x)
    order = np.argsort(x, axis=0)
    ordered = np.take_along_axis(x, order, axis=0)
    place = np.broadcast_to(np.arange(n)[:, None], x.shape)
    new = np.ones(x.shape, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.maximum.accumulate(np.where(new, place, 0), axis=0)
    ends = np.ones(x.shape, bool)
    ends[:-1] = new[1:]
    last = np.minimum.accumulate(np.where(ends, place, n)[::-1], axis=0)[::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2, axis=0)
    return out


def _ranks_by_day(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ranks within days (rows of a day together, days from ``starts``) about their day's mean, ties averaged; a column at a time for all days."""
    day = np.repeat(np.arange(len(starts)), sizes)
    place, first_of_day = np.arange(len(x)), np.repeat(starts, sizes)
    out = np.empty(x.shape)
    for k in range(x.shape[1]):
        order = np.lexsort((x[:, k], day))
        ordered = x[order, k]
        new = np.append(True, (ordered[1:] != ordered[:-1]) | (day[1:] != day[:-1]))
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(x)) - 1
        out[order, k] = (first[run] + last[run]) / 2
    return out - (first_of_day + (np.repeat(sizes, sizes) - 1) / 2)[place, None]


def ic_matrix(panel: DataFrame, features: list[str], label: str = "label", min_stocks: int = MIN_STOCKS) -> DataFrame:
    """(feature, date, ic) of all features at once, over rows that have every feature and the label.

    One exchange by date of the wide rows, sorted in place; batches of many
    dates are ranked together, a column at a time, and a date that a batch cuts
    waits for the next one.
    """
    rows = panel.select("date", label, *features).repartition("date").sortWithinPartitions("date")
    schema = T.StructType([T.StructField("feature", T.StringType()), panel.schema["date"], T.StructField("ic", T.DoubleType())])

    def coefficients(table: pa.Table) -> pa.RecordBatch:
        known = np.column_stack([table[c].to_numpy().astype(float) for c in (label, *features)])
        whole = ~np.isnan(known).any(axis=1)
        dates = table["date"].combine_chunks().filter(pa.array(whole))
        if isinstance(dates, pa.ChunkedArray):
            dates = dates.combine_chunks()
        known = known[whole]
        number = dates.dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(number)))
        stays = np.repeat(sizes >= min_stocks, sizes)
        known, dates, sizes = known[stays], dates.filter(pa.array(stays)), sizes[sizes >= min_stocks]
        starts = np.cumsum(sizes) - sizes
        if not len(starts):
            return pa.RecordBatch.from_arrays([pa.array([], pa.string()), dates.slice(0, 0), pa.array([], pa.float64())], schema.names)
        ranks = _ranks_by_day(known, starts, sizes)
        y, x = ranks[:, :1], ranks[:, 1:]
        total = lambda a: np.add.reduceat(a, starts, axis=0)
        spread = np.sqrt(total(x * x) * total(y * y))
        ic = np.divide(total(x * y), spread, out=np.zeros(spread.shape), where=spread > 0)
        days = dates.take(pa.array(np.repeat(starts, len(features))))
        return pa.RecordBatch.from_arrays([pa.array(features * len(starts), pa.string()), days, pa.array(ic.ravel())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column(0)[-1]
            cut = pc.index(batch.column(0), last).as_py()
            if cut:
                yield coefficients(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
                waiting = []
            elif waiting and waiting[-1].column(0)[-1] != last:
                yield coefficients(pa.Table.from_batches(waiting))
                waiting = []
            waiting.append(batch.slice(cut))
        if waiting:
            yield coefficients(pa.Table.from_batches(waiting))

    return rows.mapInArrow(run, schema)


def factor_scan(panel: DataFrame, features: list[str], label: str = "label", horizon: int = 5, top: int = 20) -> DataFrame:
    """The features of largest mean coefficient, either sign."""
    return ic_summary(ic_matrix(panel, features, label), horizon, ("feature",)).orderBy(F.abs("ic_mean").desc(), "feature").limit(top)


def composite(panel: DataFrame, chosen: DataFrame) -> DataFrame:
    """(symbol, date, pred, label): the mean of the chosen features' date ranks, each with its sign.  chosen: feature, sign (few rows)."""
    features = [c for c in panel.columns if c not in ("symbol", "date", "label", "split")]
    long = panel.select("symbol", "date", "label", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features))).alias("e")).select("symbol", "date", "label", "e.*")
    long = long.join(F.broadcast(chosen.select("feature", "sign")), "feature").filter("x is not null")
    long = long.withColumn("r", average_rank("x", "feature", "date") / F.count(F.lit(1)).over(Window.partitionBy("feature", "date")) - 0.5)
    return long.groupBy("symbol", "date", "label").agg(F.avg(F.col("r") * F.col("sign")).alias("pred"))
