"""Queries on cross-sections, splits, evaluation and event factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.panel import div, lag, lead
from barloom.operators import alpha, evaluate
from barloom.operators import crosssection as cs
from barloom.operators import events as ev
from barloom.plans.registry import WEEK, events_sql, lagged, led, query, r, rounded, shown
from barloom.plans.technical import FEATURE_SQL, _PREPARED
from barloom.sources.bars import brand_week_bars, event_bars, table


def _ranked(x: str, part: str) -> str:
    """Average rank of x within ``part``."""
    return f"(CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0::DOUBLE END)"


DAY = "(PARTITION BY date)"
_SHARES = f"{events_sql('user_id', 'day')}, v AS (SELECT symbol, date, volume AS x, close AS y FROM bars)"


@query("cs_rank", f"WITH {_SHARES} SELECT symbol, date, {r(f'({_ranked("x", "date")} - (count(x) OVER {DAY} + 1) / 2.0::DOUBLE) / count(x) OVER {DAY} * sqrt(12::DOUBLE)')} AS volume FROM v")
def cs_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cs.rank_norm(event_bars(spark, sf_dir, "user_id", "day"), "volume"), "volume")


@query("cs_zscore", f"WITH {_SHARES} SELECT symbol, date, {r(f'(y - avg(y) OVER {DAY}) / nullif(stddev_samp(y) OVER {DAY}, 0)')} AS close FROM v")
def cs_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cs.zscore_norm(event_bars(spark, sf_dir, "user_id", "day"), "close"), "close")


@query(
    "process_inf",
    f"""WITH {WEEK}, i AS (SELECT symbol, date, CASE WHEN day(date) = 1 THEN 'inf'::DOUBLE WHEN day(date) = 2 THEN '-inf'::DOUBLE ELSE close END AS x, 'inf'::DOUBLE AS y FROM bars),
m AS (SELECT avg(x) FILTER (WHERE isfinite(x)) AS mx FROM i)
SELECT symbol, date, {r("CASE WHEN isfinite(x) THEN x ELSE mx END", 4)} AS x, 0.0::DOUBLE AS y FROM i, m""",
)
def process_inf(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, inf = F.dayofmonth("date"), float("inf")
    bars = brand_week_bars(spark, sf_dir).withColumns({"x": F.when(day == 1, inf).when(day == 2, -inf).otherwise(F.col("close")), "y": F.lit(inf)})
    return shown(cs.finite(bars, "x", "y"), "x", "y", digits=4)


_FIT = f"""{WEEK}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)),
t AS (SELECT b.* FROM bars b JOIN d USING (date) WHERE k <= n * 0.7),
long AS (SELECT 'close' AS feature, close AS x FROM t UNION ALL SELECT 'volume', volume FROM t),
med AS (SELECT feature, quantile_cont(x, 0.5) AS median FROM long GROUP BY feature),
fit AS (SELECT feature, median, quantile_cont(abs(x - median), 0.5) AS mad FROM long JOIN med USING (feature) GROUP BY feature, median)"""


def _first_part(bars: DataFrame) -> DataFrame:
    """The first 70 per cent of the dates."""
    days = bars.select("date").distinct().withColumns({"k": F.row_number().over(Window.orderBy("date")), "n": F.count(F.lit(1)).over(Window.partitionBy())})
    return bars.join(F.broadcast(days.filter("k <= n * 0.7").select("date")), "date")


@query("robust_fit", f"WITH {_FIT} SELECT feature, {r('median')} AS median, {r('mad')} AS mad FROM fit")
def robust_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.robust_fit(_first_part(brand_week_bars(spark, sf_dir)), "close", "volume").select("feature", rounded("median").alias("median"), rounded("mad").alias("mad"))


_Z = "greatest(-3, least(3, (b.{c} - {c}f.median) / nullif(1.4826::DOUBLE * {c}f.mad, 0)))"


@query(
    "robust_transform",
    f"WITH {_FIT} SELECT symbol, date, {r('coalesce(' + _Z.format(c='close') + ', 0)')} AS close, {r('coalesce(' + _Z.format(c='volume') + ', 0)')} AS volume FROM bars b JOIN fit closef ON closef.feature = 'close' JOIN fit volumef ON volumef.feature = 'volume'",
)
def robust_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = brand_week_bars(spark, sf_dir)
    return shown(cs.robust_transform(bars, cs.robust_fit(_first_part(bars), "close", "volume"), "close", "volume"), "close", "volume")


SPLIT = """days AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)),
cuts AS (SELECT *, CAST(round_even(n * 0.15, 0) AS INT) AS part FROM days),
split AS (SELECT date, CASE WHEN k <= n - 2 * part - 5 THEN 'train' WHEN k > n - 2 * part AND k <= n - part - 5 THEN 'valid' WHEN k > n - part THEN 'test' END AS split FROM cuts)"""


@query("purged_split", f"WITH {WEEK}, {SPLIT} SELECT coalesce(split, 'purged') AS split, count(*) AS n_rows, count(DISTINCT date) AS n_days, min(date) AS first_date, max(date) AS last_date FROM bars JOIN split USING (date) GROUP BY 1")
def purged_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cs.purged_split(brand_week_bars(spark, sf_dir)).withColumn("split", F.coalesce("split", F.lit("purged")))
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("date").alias("n_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(
    "wf_windows",
    f"""WITH {WEEK}, days AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)),
s AS (SELECT unnest(range(1, 5)) AS back, max(n) AS n FROM days), v AS (SELECT *, n - back * 40 + 1 AS v1, n - back * 40 + 40 AS v2, n - back * 40 - 5 AS t2 FROM s)
SELECT CAST(row_number() OVER (ORDER BY v1) AS INT) AS split_no, a.date AS train_start, b.date AS train_end, c.date AS valid_start, d.date AS valid_end
FROM v JOIN days a ON a.k = 1 JOIN days b ON b.k = t2 JOIN days c ON c.k = v1 JOIN days d ON d.k = v2 WHERE t2 >= 120""",
)
def wf_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cs.walk_forward_windows(brand_week_bars(spark, sf_dir), 4, 40)


PANEL = f"panel AS (SELECT symbol, date, close / {lagged('close', 5)} - 1 AS pred, {led('close', 5)} / close - 1 AS label FROM bars)"
_OK = "SELECT symbol, date, pred AS p, label AS l FROM panel WHERE pred IS NOT NULL AND label IS NOT NULL"


def corr_sql(a: str, b: str) -> str:
    return f"coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0)"


DAILY = f"""ok AS ({_OK}), rk AS (SELECT *, {_ranked("p", "date")} AS rp, {_ranked("l", "date")} AS rl FROM ok),
daily AS (SELECT date, {corr_sql("rp", "rl")} AS ic, {corr_sql("p", "l")} AS pic FROM rk GROUP BY date HAVING count(*) >= 5)"""


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = brand_week_bars(spark, sf_dir)
    pred = bars.select("symbol", "date", (div(F.col("close"), lag("close", 5)) - 1).alias("pred"), "close")
    return pred.withColumn("label", div(lead("close", 5), F.col("close")) - 1).drop("close")


@query("daily_ic", f"WITH {WEEK}, {PANEL}, {DAILY} SELECT date, {r('ic')} AS ic FROM daily")
def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(evaluate.daily_ic(_panel(spark, sf_dir)), "ic", keys=("date",))


@query("pearson_ic", f"WITH {WEEK}, {PANEL}, {DAILY} SELECT date, {r('pic')} AS ic FROM daily")
def pearson_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(evaluate.daily_ic(_panel(spark, sf_dir), method="pearson"), "ic", keys=("date",))


def summary_sql(source: str, by: str = "", horizon: int = 5) -> str:
    """A query of ic_summary over ``source`` (by, date, ic)."""
    part = f"PARTITION BY {by}" if by else ""
    key = f"{by}, " if by else ""
    lags = range(1, horizon)
    products = ", ".join(f"dev * lag(dev, {k}) OVER ({part} ORDER BY date) AS c{k}" for k in lags)
    factor = " + ".join(["1"] + [f"2 * (1 - {k} / {horizon}::DOUBLE) * avg(c{k}) / avg(dev * dev)" for k in lags])
    return f"""(WITH dv AS (SELECT *, ic - avg(ic) OVER ({part}) AS dev FROM {source}), pr AS (SELECT *, {products} FROM dv),
ag AS (SELECT {key}avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg((ic > 0)::INT) AS ic_win_rate, count(*) AS n_days, avg(dev * dev) AS g0, {factor} AS factor FROM pr {f"GROUP BY {by}" if by else ""})
SELECT {key}ic_mean, ic_std, ic_mean / ic_std AS icir, ic_mean / ic_std * sqrt(n_days) AS t_stat,
  ic_mean / sqrt(g0 * CASE WHEN factor > 0 THEN factor ELSE 1 END / n_days) AS t_stat_nw, ic_win_rate, ic_mean / ic_std * sqrt(252::DOUBLE) AS ic_ir_annual, n_days FROM ag)"""


_SUMMARY = ("ic_mean", "ic_std", "icir", "t_stat", "t_stat_nw", "ic_win_rate", "ic_ir_annual")


@query("ic_summary", f"WITH {WEEK}, {PANEL}, {DAILY} SELECT n_days, {', '.join(f'{r(c)} AS {c}' for c in _SUMMARY)} FROM {summary_sql('daily')}")
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(evaluate.ic_summary(evaluate.daily_ic(_panel(spark, sf_dir)), 5), *_SUMMARY, keys=("n_days",))


@query("newey_west", f"WITH {WEEK}, {PANEL}, {DAILY} SELECT {r('t_stat')} AS t_stat, {r('t_stat_nw')} AS t_stat_nw FROM {summary_sql('daily', '', 10)}")
def newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(evaluate.ic_summary(evaluate.daily_ic(_panel(spark, sf_dir)), 10), "t_stat", "t_stat_nw", keys=())


QUANTILES = """qr AS (SELECT date, l, least(floor(row_number() OVER (PARTITION BY date ORDER BY p, symbol) / (count(*) OVER (PARTITION BY date))::DOUBLE * 5), 4)::INT AS bucket, count(*) OVER (PARTITION BY date) AS n FROM ok),
qd AS (SELECT date, bucket, avg(l) AS m FROM qr WHERE n >= 5 GROUP BY 1, 2), q AS (SELECT bucket, avg(m) AS group_mean, count(*) AS n_days FROM qd GROUP BY 1)"""


@query("quantile_returns", f"WITH {WEEK}, {PANEL}, ok AS ({_OK}), {QUANTILES} SELECT bucket, {r('group_mean')} AS group_mean, n_days FROM q")
def quantile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.quantile_means(_panel(spark, sf_dir)).select("bucket", rounded("group_mean").alias("group_mean"), "n_days")


@query(
    "evaluate_factor",
    f"""WITH {WEEK}, {PANEL}, {DAILY}, {QUANTILES}, s AS (SELECT * FROM {summary_sql("daily")}), pm AS (SELECT avg(pic) AS pearson_ic_mean FROM daily),
g AS (SELECT max(group_mean) FILTER (WHERE bucket = 4) - max(group_mean) FILTER (WHERE bucket = 0) AS long_short FROM q),
f AS (SELECT count(*) FILTER (WHERE d < 0) <= 1 AS monotonic FROM (SELECT group_mean - lag(group_mean) OVER (ORDER BY bucket) AS d FROM q))
SELECT {r("ic_mean")} AS ic_mean, {r("pearson_ic_mean")} AS pearson_ic_mean, {r("long_short")} AS long_short, monotonic,
  CASE WHEN n_days < 20 THEN 'few_days' WHEN abs(t_stat) < 2 THEN 'insignificant' WHEN ic_mean <= 0 THEN 'negative' WHEN icir < 0.2 THEN 'unstable' WHEN ic_mean < 0.02 THEN 'weak' WHEN NOT monotonic THEN 'not_monotonic' ELSE 'usable' END AS verdict
FROM s, pm, g, f""",
)
def evaluate_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.verdict(evaluate.evaluate(_panel(spark, sf_dir), horizon=5))
    return out.select(*(rounded(c).alias(c) for c in ("ic_mean", "pearson_ic_mean", "long_short")), "monotonic", "verdict")


ALL = alpha.feature_names()
#: The features of the queries whose SQL is fixed; the ``_all`` queries take every feature.
SCANNED = ["KMID", "KLEN", "KSFT", "ROC5", "ROC20", "MA10", "STD10", "BETA20", "RSQR10", "RSV20", "CORR10", "CNTP10", "SUMP20", "VMA10", "VSTD20", "WVMA10", "VSUMD20", "RANK10"]
def matrix_sql(names: list[str]) -> str:
    return f"""{_PREPARED}, feat AS (SELECT symbol, date, {", ".join(f"{FEATURE_SQL[n]} AS {n}" for n in names)}, {led("close", 5)} / close - 1 AS label FROM q),
full_rows AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM feat WHERE {" AND ".join(f"{n} IS NOT NULL" for n in [*names, "label"])}),
lr AS (SELECT *, {_ranked("label", "date")} AS rl FROM full_rows WHERE n >= 5),
lg AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, date, rl, {n} AS x FROM lr" for n in names)}),
rx AS (SELECT *, {_ranked("x", "feature, date")} AS rx FROM lg), icm AS (SELECT feature, date, {corr_sql("rx", "rl")} AS ic FROM rx GROUP BY 1, 2)"""


_MATRIX = matrix_sql(SCANNED)


def _features(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    return alpha.panel(brand_week_bars(spark, sf_dir), names=names, horizon=5)


@query("ic_matrix", f"WITH {WEEK}, {_MATRIX} SELECT feature, date, {r('ic')} AS ic FROM icm")
def ic_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(evaluate.ic_matrix(_features(spark, sf_dir, SCANNED), SCANNED), "ic", keys=("feature", "date"))


@query(
    "factor_scan",
    f"WITH {WEEK}, {_MATRIX}, s AS (SELECT * FROM {summary_sql('icm', 'feature')}) SELECT feature, n_days, {', '.join(f'{r(c)} AS {c}' for c in ('ic_mean', 'icir', 't_stat', 't_stat_nw', 'ic_win_rate'))} FROM s ORDER BY abs(ic_mean) DESC, feature LIMIT 8",
)
def factor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(evaluate.factor_scan(_features(spark, sf_dir, SCANNED), SCANNED, top=8), "ic_mean", "icir", "t_stat", "t_stat_nw", "ic_win_rate", keys=("feature", "n_days"))


@query("ic_matrix_all", f"WITH {WEEK}, {matrix_sql(ALL)} SELECT feature, date, {r('ic')} AS ic FROM icm")
def ic_matrix_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ic_matrix of all features."""
    return shown(evaluate.ic_matrix(_features(spark, sf_dir, ALL), ALL), "ic", keys=("feature", "date"))


#: The split of the dates that have a label, and the features of its test part.
_TEST = f"{SPLIT.replace('FROM bars', 'FROM dated')}, tested AS (SELECT * FROM feat WHERE date IN (SELECT date FROM split WHERE split = 'test')), full_rows"
_ALL_TEST = matrix_sql(ALL).replace("full_rows", "dated AS (SELECT date FROM feat WHERE label IS NOT NULL), " + _TEST, 1).replace("FROM feat WHERE KMID", "FROM tested WHERE KMID")


@query(
    "factor_scan_all",
    f"WITH {WEEK}, {_ALL_TEST}, s AS (SELECT * FROM {summary_sql('icm', 'feature')}) SELECT feature, n_days, {', '.join(f'{r(c)} AS {c}' for c in ('ic_mean', 'icir', 't_stat', 't_stat_nw', 'ic_win_rate'))} FROM s ORDER BY abs(ic_mean) DESC, feature LIMIT 15",
)
def factor_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 features of largest mean coefficient among all, on the test part."""
    dates = brand_week_bars(spark, sf_dir).withColumn("later", lead("close", 5)).filter("later is not null").select("date")  # those that have a label
    split = cs.purged_split(dates.distinct(), embargo=5).filter("split = 'test'").select("date", "split")
    test = _features(spark, sf_dir, ALL).join(split, "date")
    return shown(evaluate.factor_scan(test, ALL, top=15), "ic_mean", "icir", "t_stat", "t_stat_nw", "ic_win_rate", keys=("feature", "n_days"))


@query("baseline_composite")
def baseline_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors chosen on the validation part, signed, averaged as ranks and judged on the test part."""
    panel = cs.purged_split(_features(spark, sf_dir, ALL).dropna(subset=["label"]), embargo=5)
    means = evaluate.ic_matrix(panel.filter("split = 'valid'"), ALL).groupBy("feature").agg(F.avg("ic").alias("m"))
    chosen = means.orderBy(F.abs("m").desc(), "feature").limit(5).select("feature", F.when(F.col("m") >= 0, 1.0).otherwise(-1.0).alias("sign"))
    test = evaluate.composite(panel.filter("split = 'test'"), chosen)
    return evaluate.verdict(evaluate.evaluate(test, horizon=5)).select("ic_mean", "icir", "t_stat_nw", "long_short", "n_days", "verdict")


# --- events --------------------------------------------------------------------------------------

TOLD = "told AS (SELECT 'Brand#' || (1 + o_custkey % 25) AS symbol, CAST(o_orderdate AS DATE) AS publish_date, o_totalprice AS value FROM orders)"


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.concat(F.lit("Brand#"), 1 + F.col("o_custkey") % 25).alias("symbol"), F.to_date("o_orderdate").alias("publish_date"), F.col("o_totalprice").alias("value"))


_LAST = "lastv AS (SELECT symbol, publish_date, max(value) AS value FROM told GROUP BY 1, 2)"
ALIGNED = f"{TOLD}, {_LAST}, al AS (SELECT b.symbol, b.date, e.publish_date AS d, e.value AS v FROM bars b ASOF LEFT JOIN lastv e ON b.symbol = e.symbol AND b.date >= e.publish_date)"


@query("align_events", f"WITH {WEEK}, {ALIGNED} SELECT symbol, date, v AS aligned FROM al")
def align_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.align_events(brand_week_bars(spark, sf_dir), _told(spark, sf_dir)).select("symbol", "date", "aligned")


_RARE = TOLD.replace("FROM orders", "FROM orders WHERE o_totalprice > (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)")


def _rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _told(spark, sf_dir)
    limit = told.agg(F.percentile("value", F.lit(0.99)).alias("limit"))
    return told.join(F.broadcast(limit), F.col("value") > F.col("limit")).drop("limit")


_RARE_AL = ALIGNED.replace(TOLD, _RARE)


@query("align_events_ffill_limit", f"WITH {WEEK}, {_RARE_AL} SELECT symbol, date, CASE WHEN row_number() OVER (PARTITION BY symbol, d ORDER BY date) - 1 <= 6 THEN v END AS aligned FROM al")
def align_events_ffill_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.align_events(brand_week_bars(spark, sf_dir), _rare(spark, sf_dir), limit=6).select("symbol", "date", "aligned")


@query(
    "days_to_event",
    f"WITH {WEEK}, {_RARE}, nx AS (SELECT b.symbol, b.date, e.publish_date AS d FROM bars b ASOF LEFT JOIN told e ON b.symbol = e.symbol AND b.date <= e.publish_date) SELECT symbol, date, CASE WHEN d - date <= 120 THEN (d - date)::DOUBLE END AS days_to_event FROM nx",
)
def days_to_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.days_to_event(brand_week_bars(spark, sf_dir), _rare(spark, sf_dir), "publish_date").select("symbol", "date", "days_to_event")


@query(
    "event_pressure",
    f"WITH {WEEK}, {_RARE} SELECT b.symbol, b.date, {r('coalesce(sum(value / 1000 * exp(-(publish_date - date) / 30.0::DOUBLE)), 0)', 5)} AS event_pressure FROM bars b LEFT JOIN told e ON b.symbol = e.symbol AND publish_date - date BETWEEN 0 AND 60 GROUP BY 1, 2",
)
def event_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _rare(spark, sf_dir).withColumn("ratio", F.col("value") / 1000)
    return shown(ev.event_pressure(brand_week_bars(spark, sf_dir), told, "publish_date"), "event_pressure", digits=5)


@query(
    "holder_change",
    f"""WITH {WEEK}, {_RARE_AL}, ag AS (SELECT symbol, date, CASE WHEN row_number() OVER (PARTITION BY symbol, d ORDER BY date) - 1 <= 90 THEN v END AS v FROM al),
nw AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol, v ORDER BY date) = 1 THEN v END AS new FROM ag),
ol AS (SELECT *, last_value(new IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM nw),
ch AS (SELECT symbol, date, CASE WHEN new IS NOT NULL THEN -(new / nullif(old, 0) - 1) END AS c FROM ol)
SELECT symbol, date, {r("last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS holder_change FROM ch""",
)
def holder_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.holder_change(brand_week_bars(spark, sf_dir), _rare(spark, sf_dir), "value"), "holder_change")


@query("balance_momentum", f"WITH {WEEK}, {ALIGNED} SELECT symbol, date, {r(f'CASE WHEN count(v) OVER (PARTITION BY symbol) > 20 THEN (v - {lagged("v", 20)}) / nullif(abs({lagged("v", 20)}), 0) END')} AS balance_momentum FROM al")
def balance_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.balance_momentum(brand_week_bars(spark, sf_dir), _told(spark, sf_dir), "value"), "balance_momentum")

