"""Queries that look back: verdicts, closed recommendations, today's ones, flows, events under other names, and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.lineage import shared_folder
from barloom.operators import events as ev
from barloom.operators import journal as jn
from barloom.operators import robust
from barloom.operators import screen as sc
from barloom.operators import signals as sig
from barloom.plans.backtests import _GRID, _PARTED, OPTIMISED, _ema, plateau_sql
from barloom.plans.operations import _SETTLED, _settled
from barloom.plans.registry import ORACLE_SQL, WEEK, query, r, rounded, shown
from barloom.sources import store
from barloom.sources.bars import brand_week_bars, coverage, table

_FOLDS = ORACLE_SQL["robust_walk_forward"]


@query(
    "walk_forward_verdict",
    f"""WITH folds AS ({_FOLDS}), v AS (SELECT symbol, count(*) AS n, quantile_cont(total_return, 0.5) AS median, coalesce(stddev_samp(total_return), 0) AS std, avg((total_return > 0)::INT) AS share FROM folds GROUP BY symbol)
SELECT symbol, n, {r("median", 4)} AS median, {r("std", 4)} AS std, {r("share", 4)} AS positive_share,
  CASE WHEN n < 3 THEN 'few_windows' WHEN median <= 0 THEN 'losing' WHEN share < 0.5 THEN 'few_winners' WHEN std > 2 * abs(median) THEN 'unstable' ELSE 'steady' END AS verdict FROM v""",
)
def walk_forward_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = robust.walk_forward_verdict(robust.walk_forward(brand_week_bars(spark, sf_dir), sig.ema_cross))
    return found.select("symbol", "n", *(rounded(c, 4).alias(c) for c in ("median", "std", "positive_share")), "verdict")


# the sweep of both parts and of all bars at once
_PARTS = f"{_PARTED} UNION ALL SELECT symbol || chr(10) || 'all', date, close FROM weeks"
_WHOLE = "(SELECT symbol, label, sharpe FROM sw WHERE part = 'all')"
_LOST = "CASE WHEN abs(in_sample) > 1e-12 THEN (in_sample - out_of_sample) / abs(in_sample) ELSE (out_of_sample < in_sample)::INT::DOUBLE END"


@query(
    "optimize_verdict",
    f"""WITH RECURSIVE {OPTIMISED.replace(_PARTED, _PARTS)}, {plateau_sql(_WHOLE)}, v AS (SELECT *, {_LOST} AS degradation FROM opt LEFT JOIN pl USING (symbol))
SELECT symbol, label AS "case", {r("in_sample")} AS in_sample, {r("out_of_sample")} AS out_of_sample, {r("degradation")} AS degradation, {r("plateau")} AS plateau,
  CASE WHEN in_sample <= 0 THEN 'losing' WHEN out_of_sample <= 0 THEN 'overfitted' WHEN degradation > 0.5 THEN 'decayed' WHEN plateau < 0.3 THEN 'spike' WHEN degradation > 0.3 THEN 'fading' ELSE 'holding' END AS verdict FROM v""",
)
def optimize_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each symbol's best case holds outside the bars that chose it."""
    bars = brand_week_bars(spark, sf_dir)
    plateaus = robust.plateau(robust.param_sweep(bars, _ema, _GRID), ["fast", "slow"])
    return shown(robust.optimise_verdict(robust.optimise(bars, _ema, _GRID), plateaus), "in_sample", "out_of_sample", "degradation", "plateau", keys=("symbol", "case", "verdict"))


@query("recent_closed", f"WITH {WEEK}, {_SETTLED} SELECT reco_date, symbol, exit_date, {r('ret')} AS ret, {r('excess')} AS excess FROM settled WHERE status = 'closed' AND strategy = 'momentum' ORDER BY exit_date DESC, reco_date DESC, symbol LIMIT 20")
def recent_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.recent_closed(_settled(spark, sf_dir), strategy="momentum").select("reco_date", "symbol", "exit_date", rounded("return").alias("ret"), rounded("excess").alias("excess"))


_CHANGES = ORACLE_SQL["briefing_changes"]


@query(
    "build_recos",
    f"WITH {WEEK}, ch AS ({_CHANGES}) SELECT date AS reco_date, symbol, 'ema_cross' AS strategy, close AS entry_price, 5 AS horizon, (SELECT {r('arg_max(close, date)')} FROM bars WHERE symbol = 'Brand#1') AS bench_price FROM ch WHERE change = 'enter'",
)
def build_recos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's entries of the crossing averages, ready for the journal."""
    bars = brand_week_bars(spark, sf_dir)
    found = jn.recommendations(sc.signal_changes(bars, sig.ema_cross), "ema_cross", bars.filter("symbol = 'Brand#1'"))
    return found.select("reco_date", "symbol", "strategy", rounded("entry_price").alias("entry_price"), "horizon", rounded("bench_price").alias("bench_price"))


FLOW_RULES = [(1, "view", "flow", 20.0), (2, "click", "flow", 1e9), (3, "error", "flow", 0.0), (4, "error", "price_cross", 0.0), (5, "nowhere", "flow", 0.0)]
_NET = "n AS (SELECT event_type AS source, CAST(ts AS DATE) AS date, sum(CASE WHEN user_id % 2 = 0 THEN value ELSE -value END) AS net FROM events GROUP BY 1, 2)"


@query(
    "flow_rules",
    f"""WITH {_NET}, l AS (SELECT *, lag(net) OVER (PARTITION BY source ORDER BY date) AS before FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY date DESC) = 1),
rules(rule_id, source, level) AS (VALUES {", ".join(f"({i}, {s!r}, {v}::DOUBLE)" for i, s, t, v in FLOW_RULES if t == "flow")})
SELECT CAST(rule_id AS INT) AS rule_id, source, date, {r("net", 4)} AS net, {r("before", 4)} AS before, CASE WHEN net >= 0 THEN 'in' ELSE 'out' END AS direction FROM l JOIN rules USING (source) WHERE before IS NOT NULL AND abs(net) >= level""",
)
def flow_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net values by event type as flows, and the rules about them."""
    signed = F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    flows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("date")).agg(F.sum(signed).alias("net"))
    rules = spark.createDataFrame(FLOW_RULES, "rule_id int, symbol string, type string, level double")
    found = sc.flows_fired(flows, rules)
    return found.select("rule_id", "source", "date", rounded("net", 4).alias("net"), rounded("before", 4).alias("before"), "direction")


@query(
    "event_table_names",
    f"SELECT lpad((o_custkey % 900)::VARCHAR, 6, '0') AS symbol, CAST(o_orderdate AS DATE) AS publish_date, {r('o_totalprice', 2)} AS holders FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 5 > 0",
)
def event_table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under the names and texts of a market's table, some of them no dates or numbers, as events."""
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    told = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 900).alias("证券代码"), F.when(key % 7 == 0, "-").when(key % 2 == 0, F.date_format(day, "yyyyMMdd")).otherwise(day.cast("string")).alias("公告日期"), F.when(key % 5 > 0, F.col("o_totalprice").cast("string")).otherwise("--").alias("股东户数"), F.lit(1).alias("其他"))
    found = ev.picked(told, ("截止日期", "公告日期"), ("股东户数", "户数"), value="holders")
    return found.select("symbol", "publish_date", rounded("holders", 2).alias("holders"))


@query(
    "export_report",
    f"WITH {WEEK} SELECT 'bars' AS name, count(*) AS n_rows, CAST(NULL AS VARCHAR) AS reason FROM bars UNION ALL SELECT 'coverage', count(DISTINCT symbol), NULL FROM bars UNION ALL SELECT 'positions', 0, 'no rows' UNION ALL SELECT 'rules', 0, 'RuntimeError: locked' UNION ALL SELECT 'signals', count(*), NULL FROM events WHERE event_type = 'error'",
)
def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export of five sets wrote, counted in its files, and why it left two out."""
    bars = brand_week_bars(spark, sf_dir)
    context = F.to_json(F.struct(F.col("event_type").alias("title"), F.concat_ws("\n", F.col("user_id").cast("string"), F.col("value").cast("string")).alias("body")))

    def locked() -> DataFrame:
        raise RuntimeError("locked")

    loaders = {"bars": lambda: bars, "coverage": lambda: coverage(bars), "positions": lambda: bars.limit(0), "rules": locked, "signals": lambda: store.flat_signals(table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", context.alias("context")))}
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    report = store.export_all(loaders, folder)
    written = [(name, spark.read.option("header", True).csv(f"{folder}/{name}").count(), None) if reason is None else (name, rows, reason) for name, rows, reason in report]
    return spark.createDataFrame(written, "name string, n_rows long, reason string")
