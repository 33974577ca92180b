"""What the findings of round 3 named."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators import journal as jn
from barloom.plans import evaluate as evaluate_plans
from barloom.plans import models, stores
from barloom.plans import training as training_plans
from barloom.streaming import live

D0 = dt.date(2024, 1, 1)


def test_rounding_of_the_equity_is_no_loss(spark):
    """A step of one unit in the last place counts as none, as in the SQL of the metrics."""
    flat = [100.0, 90.0, 99.0, 99.0, 95.0, 95.0, 97.0]
    noisy = [100.0, 90.0, 99.0, 99.0 * (1 - 2e-16), 95.0, 95.0 * (1 - 2e-16), 97.0]
    assert flat != noisy
    equity = spark.createDataFrame([(s, D0 + dt.timedelta(k), v) for s, values in (("flat", flat), ("noisy", noisy)) for k, v in enumerate(values)], "symbol string, date date, equity double")
    found = {r.symbol: r for r in bt.metrics(equity, spark.createDataFrame([], "symbol string, pnl_pct double")).collect()}
    assert abs(found["flat"].sortino - found["noisy"].sortino) < 1e-9


def _plain_ledger(trades):
    have = cost = gained = 0.0
    rejected = 0
    for _, action, quantity, price in sorted(trades):
        if action in ("buy", "add"):
            cost, have = (cost * have + price * quantity) / (have + quantity), have + quantity
        elif quantity > have + 1e-9:
            rejected += 1
        else:
            gained, have = gained + (price - cost) * quantity, have - quantity
            if have <= 1e-9:
                have = cost = 0.0
    return have, cost, gained, "open" if have else "closed", len(trades), rejected


def test_ledger_streams_its_trades(spark):
    """No task holds a symbol's trades: positions are carried from batch to batch, over symbols that share a task."""
    rng = random.Random(4)
    own = {s: [(k, rng.choice(["buy", "add", "trim", "sell"]), float(rng.randint(1, 9)), rng.random() * 10) for k in range(n)] for s, n in (("a", 400), ("b", 1), ("c", 0), ("d", 64), (None, 65))}
    rows = [(s, *t) for s, trades in own.items() for t in trades]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "symbol string, at int, action string, shares double, price double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        made = jn.ledger(frame)
        found = {r.symbol: tuple(r)[1:] for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert found == {s: _plain_ledger(trades) for s, trades in own.items() if trades}
    assert jn.ledger(frame.limit(0)).count() == 0
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()


def _counted(spark, monkeypatch, module):
    """``module``'s bars made so that every row that is computed again counts."""
    rows = [(f"s{s}", D0 + dt.timedelta(weeks=k), *(10.0 + (k * (s + 3)) % 17 for _ in range(4)), 100.0, 1000.0) for s in range(3) for k in range(40)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counting(symbol):
        seen.add(1)
        return symbol

    frame = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double, amount double").repartition(1)
    monkeypatch.setattr(module, "brand_week_bars", lambda *_: frame.withColumn("symbol", counting("symbol")))
    return seen, len(rows)


def test_runs_are_saved_from_bars_made_once(spark, monkeypatch):
    """A checkpoint counts and writes: twice is what one making costs."""
    seen, n = _counted(spark, monkeypatch, stores)
    assert stores.runs_compared(spark, "").count() == 6
    assert seen.value <= 2 * n


class _Kept:
    """A store of models that reads what it is given again and again."""

    def active_id(self, universe):
        return "m"

    def predict(self, model_id, panel, date=None, top=20):
        for _ in range(4):
            panel.agg(F.sum(training_plans.ALL[0])).collect()

    def backtest(self, model_id, panel, bars):
        self.predict(model_id, panel)
        return bars

    def ml_score(self, bars, universe):
        return bars.withColumn("ml_score", F.lit(1.0))


@pytest.mark.parametrize("name", ["ml_score", "backtest_local", "gbdt_train", "_labelled"])
def test_models_read_a_panel_made_once(spark, monkeypatch, name):
    """The lines behind the features are read once, however often a fit or a score reads the panel."""
    seen, n = _counted(spark, monkeypatch, evaluate_plans)
    monkeypatch.setattr(training_plans, "brand_week_bars", evaluate_plans.brand_week_bars)
    monkeypatch.setattr(training_plans, "kept_model", lambda *_: (_Kept(), "m"))

    def fit(panel, features, *_, **__):
        _Kept().predict("m", panel)
        return panel.select("symbol", "date", "label", F.lit("test").alias("split"), F.col("label").alias("pred"))

    monkeypatch.setattr(models.ml, "train_gbt", fit)
    query = {"gbdt_train": models.gbdt_train}.get(name) or getattr(training_plans, name)
    made = query(spark, "")
    if name == "_labelled":
        _Kept().predict("m", made)
    made.count()
    assert 0 < seen.value <= 2 * n


def test_cooldowns_share_states(spark, tmp_path):
    """What a batch calls does not grow with the symbols: they share buckets, and each has its own cooldown in them."""
    n = 3000
    rows = [(1, f"s{k}", dt.datetime(2024, 1, 1, 9, m), "event", 60) for k in range(n) for m in (0, 30)]
    spark.createDataFrame(rows, "rule_id int, symbol string, ts timestamp, type string, cooldown_minutes int").coalesce(1).write.parquet(str(tmp_path / "in"))
    with live.keyed_state(spark):
        stream = live.cooled(spark.readStream.schema("rule_id int, symbol string, ts timestamp, type string, cooldown_minutes int").parquet(str(tmp_path / "in")))
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    found = spark.read.schema(live.FIRING).parquet(str(tmp_path / "out")).collect()
    assert sorted(r.symbol for r in found) == sorted(f"s{k}" for k in range(n)) and {r.ts.minute for r in found} == {0}
    assert 0 < max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) < 2100
