"""Per-date statistics, robust scaling and splits by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.panel import average_rank, clip, div, same_date


def rank_norm(panel: DataFrame, *columns: str) -> DataFrame:
    """Average rank within the date, centred, over the count, times the root of 12."""
    out = panel.withColumns({f"__r_{c}": average_rank(c, "date") for c in columns})
    n = {c: F.count(c).over(same_date()) for c in columns}
    return out.withColumns({c: (F.col(f"__r_{c}") - (n[c] + 1) / 2) / n[c] * F.sqrt(F.lit(12.0)) for c in columns}).drop(*(f"__r_{c}" for c in columns))


def zscore_norm(panel: DataFrame, *columns: str) -> DataFrame:
    return panel.withColumns({c: div(F.col(c) - F.avg(c).over(same_date()), F.stddev_samp(c).over(same_date())) for c in columns})


def finite(frame: DataFrame, *columns: str) -> DataFrame:
    """Infinities become the mean of the column's finite values (0 where there is none); null and NaN stay."""
    inf = {c: F.abs(F.col(c)) == float("inf") for c in columns}
    means = frame.agg(*(F.avg(F.when(~inf[c] & ~F.isnan(c), F.col(c))).alias(f"__m_{c}") for c in columns))
    joined = frame.crossJoin(F.broadcast(means))  # one row
    return joined.withColumns({c: F.when(inf[c], F.coalesce(f"__m_{c}", F.lit(0.0))).otherwise(F.col(c)) for c in columns}).drop(*(f"__m_{c}" for c in columns))


def robust_fit(train: DataFrame, *columns: str) -> DataFrame:
    """(feature, median, mad) of the training rows."""
    long = train.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("p")).select("p.*")
    medians = long.groupBy("feature").agg(F.percentile("x", F.lit(0.5)).alias("median"))
    return long.join(F.broadcast(medians), "feature").groupBy("feature", "median").agg(F.percentile(F.abs(F.col("x") - F.col("median")), F.lit(0.5)).alias("mad"))


def robust_transform(frame: DataFrame, fitted: DataFrame, *columns: str, limit: float = 3.0) -> DataFrame:
    """(x - median) / (1.4826 mad), cut at +-limit; 0 where it is unknown.  ``fitted`` has a row a feature."""
    wide = fitted.groupBy().agg(*(F.max(F.when(F.col("feature") == c, F.col(k))).alias(f"__{k}_{c}") for c in columns for k in ("median", "mad")))
    joined = frame.crossJoin(F.broadcast(wide))  # one row
    scaled = {c: div(F.col(c) - F.col(f"__median_{c}"), 1.4826 * F.col(f"__mad_{c}")) for c in columns}
    return joined.withColumns({c: F.coalesce(F.when(scaled[c].isNotNull(), clip(scaled[c], -limit, limit)), F.lit(0.0)) for c in columns}).drop(*(f"__{k}_{c}" for c in columns for k in ("median", "mad")))


def purged_split(panel: DataFrame, valid_ratio: float = 0.15, test_ratio: float = 0.15, embargo: int = 5, with_test: bool = True) -> DataFrame:
    """``panel`` with ``split``: train, valid, test by date, or null for dates purged before the next part.

    Counts of dates are rounded half to even; the tail of train is purged, and
    that of valid where a test part follows.  The dates are few (one row each).
    """
    days = panel.select("date").distinct().withColumn("__k", F.row_number().over(Window.orderBy("date"))).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()))
    test = F.bround(F.col("__n") * (test_ratio if with_test else 0.0)).cast("int")
    valid = F.greatest(F.lit(1), F.bround(F.col("__n") * valid_ratio).cast("int"))
    train_end, valid_end = F.col("__n") - test - valid, F.col("__n") - test
    k = F.col("__k")
    purged = F.when(test > 0, embargo).otherwise(0)
    split = F.when(k <= train_end - embargo, "train").when((k > train_end) & (k <= valid_end - purged), "valid").when(k > valid_end, "test")
    return panel.join(F.broadcast(days.select("date", split.alias("split"))), "date")


def walk_forward_windows(panel: DataFrame, n_splits: int = 5, valid_days: int = 60, embargo: int = 5, expanding: bool = True, min_train: int = 120) -> DataFrame:
    """(split_no, train_start, train_end, valid_start, valid_end): validation windows from the end backwards, in time order."""
    days = panel.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    spans = days.select("n").limit(1).withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    spans = spans.withColumn("v1", F.col("n") - F.col("back") * valid_days + 1).withColumn("v2", F.col("v1") + valid_days - 1).withColumn("t2", F.col("v1") - 1 - embargo)
    spans = spans.filter(F.col("t2") >= min_train)
    first = F.lit(1) if expanding else F.greatest(F.lit(1), F.col("t2") - min_train + 1)
    spans = spans.withColumn("t1", first)
    at = days.select(F.col("k").alias("__k"), F.col("date").alias("__d"))
    for name, key in (("train_start", "t1"), ("train_end", "t2"), ("valid_start", "v1"), ("valid_end", "v2")):
        spans = spans.join(at, F.col(key) == F.col("__k")).withColumn(name, F.col("__d")).drop("__k", "__d")
    return spans.withColumn("split_no", F.row_number().over(Window.orderBy("v1"))).select("split_no", "train_start", "train_end", "valid_start", "valid_end")
