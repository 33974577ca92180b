"""Queries on model features and scores, payloads, column files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.lineage import cut, shared_folder
from barloom.functions.panel import div, lag
from barloom.operators import evaluate, ml
from barloom.operators import signals as sig
from barloom.plans.evaluate import ALL, PANEL, _features, _panel
from barloom.plans.registry import WEEK, events_sql, full, lagged, query, r, rounded, shown
from barloom.plans.signals import ternary
from barloom.sources import bars as src
from barloom.sources import payloads
from barloom.streaming import live
from barloom.streaming.bar_table import BarTable, stored

_HK = ("ret1", "ret20", "ma60", "close_ma10", "bb_upper", "bb_lower", "bb_width", "atr", "volatility10", "v_ratio", "v_price_corr", "rsi14", "hl_ratio", "co_ratio", "body", "up_count")
_TR = f"greatest(high - low, abs(high - {lagged('close')}), abs(low - {lagged('close')}))"
_SD, _M20 = full(20, "stddev_samp(close)", "close"), full(20, "avg(close)", "close")


@query(
    "hk_features",
    f"""WITH {WEEK}, a AS (SELECT *, {_TR} AS tr, close / {lagged("close")} - 1 AS ret1, coalesce(greatest(close - {lagged("close")}, 0), 0) AS gain, coalesce(greatest({lagged("close")} - close, 0), 0) AS loss,
  row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM bars), b AS (SELECT *, (coalesce(ret1, 0) > 0)::INT AS up FROM a),
f AS (SELECT symbol, date, n, ret1, close / {lagged("close", 20)} - 1 AS ret20, {full(60, "avg(close)", "close")} AS ma60, close / {full(10, "avg(close)", "close")} AS close_ma10, ({_M20} + 2 * {_SD}) / close - 1 AS bb_upper, ({_M20} - 2 * {_SD}) / close - 1 AS bb_lower,
  (4 * {_SD} / close) / ({_M20} / close + 1) AS bb_width, {full(14, "avg(tr)", "tr")} / close AS atr, {full(10, "stddev_samp(ret1)", "ret1")} * sqrt(10::DOUBLE) AS volatility10, volume / {full(5, "avg(volume)", "volume")} AS v_ratio,
  (CASE WHEN count(*) OVER w >= 10 THEN covar_pop(volume, close) OVER w / nullif(stddev_pop(volume) OVER w * stddev_pop(close) OVER w, 0) END) AS v_price_corr,
  100 - 100 / (1 + {full(14, "avg(gain)", "gain")} / ({full(14, "avg(loss)", "loss")} + 1e-10::DOUBLE)) AS rsi14, (high - low) / close AS hl_ratio, (close - open) / (high - low + 1e-10::DOUBLE) AS co_ratio, abs(close - open) / (high - low + 1e-10::DOUBLE) AS body,
  {full(5, "sum(up)", "up")} AS up_count FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT symbol, date, {", ".join(f"{r(c, 5)} AS {c}" for c in _HK)} FROM f WHERE n >= 60 AND v_price_corr IS NOT NULL""",
)
def hk_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ml.session_features(src.brand_week_bars(spark, sf_dir)), *_HK, digits=5)


def _weighted(name: str, source: str, x: str, alpha: str) -> str:
    """A recursive CTE: the sums of decaying weights times x and of the weights, whose ratio is the adjusted average."""
    return f"""{name} AS (SELECT symbol, rn, {x} AS num, 1::DOUBLE AS den FROM {source} WHERE rn = 1
UNION ALL SELECT s.symbol, s.rn, {name}.num * (1 - {alpha}) + s.{x}, {name}.den * (1 - {alpha}) + 1 FROM {name} JOIN {source} s ON s.symbol = {name}.symbol AND s.rn = {name}.rn + 1)"""


_T9, _B9 = full(9, "max(high)", "high"), full(9, "min(low)", "low")
_SPAN = {n: f"2.0::DOUBLE / {n + 1}" for n in (3, 9, 12, 26)}


@query(
    "hk_features_ewm",
    f"""WITH RECURSIVE {WEEK}, hx AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, 100 * (close - {_B9}) / ({_T9} - {_B9} + 1e-10::DOUBLE) AS rsv,
  CASE WHEN stddev_pop(volume) OVER w * stddev_pop(close) OVER w > 0 THEN 1 END AS moves FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
{_weighted("h12", "hx", "close", _SPAN[12])}, {_weighted("h26", "hx", "close", _SPAN[26])}, hd AS (SELECT hx.*, h12.num / h12.den - h26.num / h26.den AS dif FROM hx JOIN h12 USING (symbol, rn) JOIN h26 USING (symbol, rn)),
{_weighted("h9", "hd", "dif", _SPAN[9])}, hr AS (SELECT symbol, date, rsv, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM hx WHERE rsv IS NOT NULL),
{_weighted("h3", "hr", "rsv", _SPAN[3])}, hk AS (SELECT hr.symbol, hr.date, hr.rn, h3.num / h3.den AS k FROM hr JOIN h3 USING (symbol, rn)), {_weighted("hk3", "hk", "k", _SPAN[3])},
hj AS (SELECT hk.symbol, hk.date, hk.k, hk3.num / hk3.den AS d FROM hk JOIN hk3 USING (symbol, rn)),
f AS (SELECT hd.symbol, hd.date, hd.dif, h9.num / h9.den AS dea, hj.k, hj.d FROM hd JOIN h9 USING (symbol, rn) JOIN hj ON hj.symbol = hd.symbol AND hj.date = hd.date WHERE hd.rn >= 60 AND moves IS NOT NULL)
SELECT symbol, date, {r("dif", 5)} AS dif, {r("dea", 5)} AS dea, {r("2 * (dif - dea)", 5)} AS hist, {r("k", 5)} AS k, {r("d", 5)} AS d, {r("3 * k - 2 * d", 5)} AS j FROM f""",
)
def hk_features_ewm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ml.session_features(src.brand_week_bars(spark, sf_dir)), "dif", "dea", "hist", "k", "d", "j", digits=5)


_RET = f"rt AS (SELECT symbol, date, close / {lagged('close')} - 1 AS a, close / {lagged('close', 5)} - 1 AS b, volume / 1000 AS c FROM bars)"


@query(
    "orthogonalize",
    f"""WITH {WEEK}, {_RET}, k AS (SELECT * FROM rt WHERE b IS NOT NULL), m AS (SELECT *, (a + b + c) / 3 AS m FROM k),
s AS (SELECT avg(m) AS mm, var_pop(m) + 1e-12::DOUBLE AS mv, covar_pop(a, m) AS ca, covar_pop(b, m) AS cb, covar_pop(c, m) AS cc FROM m)
SELECT symbol, date, {r("a - ca / mv * (m - mm)")} AS a, {r("b - cb / mv * (m - mm)")} AS b, {r("c - cc / mv * (m - mm)")} AS c FROM m, s""",
)
def orthogonalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = src.brand_week_bars(spark, sf_dir)
    made = bars.select("symbol", "date", (div(F.col("close"), lag("close")) - 1).alias("a"), (div(F.col("close"), lag("close", 5)) - 1).alias("b"), (F.col("volume") / 1000).alias("c"))
    return shown(ml.orthogonalise(made.filter("b is not null"), ["a", "b", "c"]), "a", "b", "c")


@query(
    "score_to_trend",
    f"""WITH {WEEK}, {PANEL}, s AS (SELECT symbol, date, pred AS score FROM panel WHERE pred IS NOT NULL), q AS (SELECT quantile_cont(score, [0.2, 0.4, 0.5, 0.6, 0.8]) AS q, min(score) AS mn, max(score) AS mx FROM s),
t AS (SELECT symbol, date, CASE WHEN score >= q[5] THEN 'strong_up' WHEN score >= q[4] THEN 'weak_up' WHEN score >= q[2] THEN 'neutral' WHEN score >= q[1] THEN 'weak_down' ELSE 'strong_down' END AS trend,
  CASE WHEN score >= q[5] THEN (score - q[5]) / (mx - q[5] + 1e-9::DOUBLE) WHEN score >= q[4] THEN (score - q[4]) / (q[5] - q[4] + 1e-9::DOUBLE) WHEN score >= q[2] THEN 1 - abs(score - q[3]) / (q[4] - q[2] + 1e-9::DOUBLE)
       WHEN score >= q[1] THEN (q[2] - score) / (q[2] - q[1] + 1e-9::DOUBLE) ELSE (q[1] - score) / (q[1] - mn + 1e-9::DOUBLE) END AS p FROM s, q)
SELECT symbol, date, trend, {r("greatest(0, least(1, p))")} AS trend_prob FROM t""",
)
def score_to_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _panel(spark, sf_dir).filter("pred is not null").select("symbol", "date", F.col("pred").alias("score"))
    return ml.score_to_trend(scores).select("symbol", "date", "trend", rounded("trend_prob").alias("trend_prob"))


@query(
    "seed_ensemble",
    f"""WITH {WEEK}, {PANEL}, m AS (SELECT 'a' AS model, symbol, date, pred FROM panel WHERE pred IS NOT NULL UNION ALL SELECT 'b', symbol, date, pred * pred FROM panel WHERE pred IS NOT NULL UNION ALL SELECT 'c', symbol, date, 1.0 FROM panel WHERE pred IS NOT NULL),
z AS (SELECT symbol, date, coalesce((pred - avg(pred) OVER (PARTITION BY model)) / nullif(stddev_pop(pred) OVER (PARTITION BY model), 0), 0) AS z FROM m) SELECT symbol, date, {r("avg(z)")} AS score FROM z GROUP BY 1, 2""",
)
def seed_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _panel(spark, sf_dir).filter("pred is not null")
    models = F.array(F.struct(F.lit("a").alias("model"), F.col("pred").alias("p")), F.struct(F.lit("b").alias("model"), (F.col("pred") * F.col("pred")).alias("p")), F.struct(F.lit("c").alias("model"), F.lit(1.0).alias("p")))
    scores = base.select("symbol", "date", F.inline(models)).withColumnRenamed("p", "pred")
    return shown(ml.seed_ensemble(scores), "score")


@query(
    "hk_ensemble",
    f"""WITH {WEEK}, s AS (SELECT symbol, close / 1000 AS d, CASE WHEN symbol LIKE '%2%' THEN NULL ELSE volume / 100 END AS m FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
t AS (SELECT symbol, (d * 0.5 + coalesce(m, 0) * 0.3) / (0.5::DOUBLE + 0.3::DOUBLE) AS score FROM s) SELECT symbol, {r("score")} AS score FROM t ORDER BY t.score DESC, symbol LIMIT 10""",
)
def hk_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = src.last_bars(src.brand_week_bars(spark, sf_dir), 1)
    scores = last.select("symbol", (F.col("close") / 1000).alias("d"), F.when(~F.contains("symbol", F.lit("2")), F.col("volume") / 100).alias("m"))
    return shown(ml.weighted_ensemble(scores, {"d": 0.5, "m": 0.3}), "score", keys=("symbol",))


@query("trend_wide_pivot", f"WITH {WEEK} SELECT date, {', '.join(f'''{r(f'''max(close) FILTER (WHERE symbol = 'Brand#{k}')''')} AS b{k}''' for k in (1, 2, 3))} FROM bars GROUP BY date")
def trend_wide_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"Brand#{k}" for k in (1, 2, 3)]
    wide = src.brand_week_bars(spark, sf_dir).groupBy("date").pivot("symbol", names).agg(F.max("close"))
    return wide.select("date", *(rounded(F.col(f"`{n}`")).alias(f"b{n[6:]}") for n in names))


#: The SQL names the 25 brands that the tables have; the query takes those it finds.
@query("trend_wide_all", f"WITH {WEEK} SELECT date, {', '.join(f'''{r(f'''max(close) FILTER (WHERE symbol = 'Brand#{k}')''')} AS b{k}''' for k in range(1, 26))} FROM bars GROUP BY date")
def trend_wide_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trend_wide_pivot of every symbol of the data."""
    wide = src.brand_week_bars(spark, sf_dir).groupBy("date").pivot("symbol").agg(F.max("close"))
    return wide.select("date", *(rounded(F.col(f"`{n}`")).alias(f"b{n.removeprefix('Brand#')}") for n in wide.columns[1:]))


_ZONE = ", ".join(f"coalesce(pred {op} {full(120, f'quantile_cont(pred, {q})', 'pred', least=10)}, false) AS {name}" for name, op, q in (("hi", ">=", 0.7), ("lo", "<=", 0.4)))


@query("ml_signal", f"WITH {WEEK}, {PANEL}, z AS (SELECT symbol, date, {_ZONE} FROM panel) SELECT symbol, date, {ternary(f'hi AND NOT coalesce({lagged("hi")}, false)', f'lo AND NOT coalesce({lagged("lo")}, false)')} AS signal FROM z")
def ml_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.quantile_zone(_panel(spark, sf_dir), "pred").select("symbol", "date", "signal")


@query("gbdt_train")
def gbdt_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rank coefficients of boosted trees on the test dates."""
    # written once: scaling, every fit's cache and the scores read the panel, not the lines again
    panel = cut(_features(spark, sf_dir, ALL).withColumn("label", F.percent_rank().over(_day()) - 0.5))
    scored = ml.train_gbt(panel, ALL)
    return shown(evaluate.daily_ic(scored.filter("split = 'test'")), "ic", keys=("date",))


def _day():
    from pyspark.sql import Window

    return Window.partitionBy("date").orderBy("label")


_PARSED = f"WITH {WEEK} SELECT symbol, date, {r('close', 3)} AS close, volume FROM bars"


@query("payload_csv_klines", _PARSED)
def payload_csv_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as replies with a text a line, and parsed."""
    bars = src.brand_week_bars(spark, sf_dir)
    line = F.concat_ws(",", F.col("date").cast("string"), *(F.col(c).cast("string") for c in ("open", "close", "high", "low", "volume")))
    replies = bars.groupBy("symbol").agg(F.to_json(F.struct(F.struct(F.collect_list(line).alias("klines")).alias("data"))).alias("body"))
    return payloads.csv_klines(replies).select("symbol", "date", rounded("close", 3).alias("close"), "volume")


@query("payload_array_klines", _PARSED)
def payload_array_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = src.brand_week_bars(spark, sf_dir)
    line = F.array(F.col("date").cast("string"), *(F.col(c).cast("string") for c in ("open", "close", "high", "low", "volume")))
    grouped = bars.groupBy("symbol").agg(F.collect_list(line).alias("day"))
    body = F.to_json(F.struct(F.lit(0).alias("code"), F.create_map(F.col("symbol"), F.struct(F.col("day"))).alias("data")))
    return payloads.array_klines(grouped.select("symbol", F.col("symbol").alias("code"), body.alias("body"))).select("symbol", "date", rounded("close", 3).alias("close"), "volume")


def _shared(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("stream_bars", f"WITH {events_sql()} SELECT symbol, date, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, volume FROM bars")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars out of the events as a stream, stored batch by batch."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    ticks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    ticks = ticks.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))
    table = BarTable(spark, _shared(spark, "stream-bars"))
    stored(ticks, table, _shared(spark, "stream-check")).trigger(availableNow=True).start().awaitTermination()
    return table.read().select("symbol", F.col("date").cast("timestamp_ntz").alias("date"), *(rounded(c).alias(c) for c in ("open", "high", "low", "close")), "volume")




#: rule_id, symbol, type, level, direction, cooldown_minutes: of events as quotes of their users.
STREAM_RULES = [(1, None, "price_cross", 60.0, "up", 2880), (2, None, "price_cross", 20.0, "down", 720), (3, "7", "price_cross", 5.0, "up", 60), (4, None, "price_pct", 900.0, None, 1440), (5, None, "price_cross", 150.0, "up", 0)]
_QUOTES = "q AS (SELECT CAST(user_id AS VARCHAR) AS symbol, ts, value AS close FROM events), known AS (SELECT symbol, avg(close) / 2 AS prev_close FROM q GROUP BY 1)"
_STREAM_RULES_SQL = "rules(rule_id, rs, type, level, direction, minutes) AS (VALUES " + ", ".join(f"({i}, {'NULL' if s is None else repr(s)}, {t!r}, {v}::DOUBLE, {'NULL' if d is None else repr(d)}, {m})" for i, s, t, v, d, m in STREAM_RULES) + ")"


@query(
    "stream_rules",
    f"""WITH RECURSIVE {_QUOTES}, {_STREAM_RULES_SQL},
e AS (SELECT rule_id, symbol, type, minutes, ts, row_number() OVER (PARTITION BY rule_id, symbol ORDER BY ts) AS rn FROM q JOIN known USING (symbol) JOIN rules ON rs IS NULL OR rs = symbol
  WHERE CASE type WHEN 'price_pct' THEN abs(100 * (close / prev_close - 1)) >= level ELSE CASE direction WHEN 'down' THEN close <= level ELSE close >= level END END),
k AS (SELECT rule_id, symbol, type, rn, ts, ts AS last, true AS kept FROM e WHERE rn = 1 UNION ALL
  SELECT e.rule_id, e.symbol, e.type, e.rn, e.ts, CASE WHEN e.ts - k.last >= to_minutes(minutes) THEN e.ts ELSE k.last END, e.ts - k.last >= to_minutes(minutes) FROM k JOIN e ON e.rule_id = k.rule_id AND e.symbol = k.symbol AND e.rn = k.rn + 1)
SELECT CAST(rule_id AS INT) AS rule_id, symbol, ts, type FROM k WHERE kept""",
)
def stream_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules tried on the events as a stream of quotes, with a cooldown of each rule's own by symbol."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    known = events.groupBy(F.col("user_id").cast("string").alias("symbol")).agg((F.avg("value") / 2).alias("prev_close"))
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    quotes = stream.select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    rules = spark.createDataFrame(STREAM_RULES, "rule_id int, symbol string, type string, level double, direction string, cooldown_minutes int")
    path = _shared(spark, "stream-rules")
    with live.keyed_state(spark):
        live.watched(quotes, known, rules).writeStream.option("checkpointLocation", _shared(spark, "stream-check")).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(live.FIRING).parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
