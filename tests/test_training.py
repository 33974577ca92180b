"""Staged early stopping, retraining without leaks, and the store of models."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import evaluate, training
from barloom.operators.crosssection import rank_norm

FEATURES = ["f0", "f1", "f2"]
FAST = {"rounds": 6, "patience": 3, "first": 4, "maxDepth": 2, "minInstancesPerNode": 5, "subsamplingRate": 1.0}
DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(100)]


def _panel(spark, signal: float = 1.0, changed_from: int = 1000, seed: int = 1, symbols: int = 12):
    """Rows whose label follows f0; from day ``changed_from`` on all values are others."""
    rng, other, rows = random.Random(seed), random.Random(99), []
    for k, day in enumerate(DAYS):
        for s in range(symbols):
            x = [rng.gauss(0, 1) for _ in FEATURES]
            y = signal * x[0] + rng.gauss(0, 0.5)
            if k >= changed_from:
                x, y = [other.gauss(5, 3) for _ in FEATURES], other.gauss(-9, 1)
            rows.append((f"S{s:02d}", day, *x, y))
    return spark.createDataFrame(rows, "symbol string, date date, f0 double, f1 double, f2 double, label double")


@pytest.fixture(scope="module")
def panel(spark):
    return _panel(spark).cache()


@pytest.fixture(scope="module")
def parts(panel):
    scaler = training.Scaler.fit(panel.filter(F.col("date") < DAYS[60]), FEATURES)
    return scaler, scaler.assembled(panel.filter(F.col("date") < DAYS[60])), scaler.assembled(panel.filter(F.col("date") >= DAYS[65]))


def test_scores_after_every_round(spark, parts):
    """The staged coefficients are those of the models that are cut at each round."""
    _, train, valid = parts
    fitted = training.fit_boosted(train, valid, **FAST | {"patience": 100})
    assert len(fitted.history) == 6 and fitted.history[fitted.best - 1] == max(fitted.history) == fitted.score
    whole = training.fit_boosted(train, None, rounds=6, maxDepth=2, minInstancesPerNode=5, subsamplingRate=1.0).model
    for k in (1, 3, 6):
        scored = training.truncated(spark, whole, k).transform(valid).withColumnRenamed("prediction", "pred")
        mean = evaluate.daily_ic(scored).agg(F.avg("ic")).first()[0]
        assert mean == pytest.approx(fitted.history[k - 1], abs=1e-9)


def test_rounds_without_gain():
    assert training.best_round([0.1, 0.3, 0.2, 0.3, 0.1], 3) == (2, True)  # an equal one is no gain
    assert training.best_round([0.1, 0.3, 0.2, 0.29], 3) == (2, False)
    assert training.best_round([0.5, 0.1, 0.1, 0.9], 2) == (1, True)
    assert training.best_round([0.0] * 60, 50) == (1, True)


def test_noise_stops_early(spark):
    noise = _panel(spark, signal=0.0, seed=3)
    scaler = training.Scaler.fit(noise, FEATURES)
    fitted = training.fit_boosted(scaler.assembled(noise.filter(F.col("date") < DAYS[60])), scaler.assembled(noise.filter(F.col("date") >= DAYS[65])), **FAST | {"rounds": 200, "patience": 5, "first": 8})
    assert fitted.best < 200 and len(fitted.history) < 200


def test_no_validation_rows_warn(parts):
    _, train, valid = parts
    with pytest.warns(UserWarning, match="without a stop"):
        fitted = training.fit_boosted(train, valid.limit(0), rounds=3, maxDepth=1)
    assert fitted.best == 3 and fitted.score == 0.0 and fitted.model.getNumTrees == 3


def test_sizes():
    small, full = training.sized_parameters(4000), training.sized_parameters(10**6)
    assert (small["maxDepth"], small["minInstancesPerNode"], full["maxDepth"], full["minInstancesPerNode"]) == (5, 50, 7, 50)
    assert (training.sized_parameters(100)["maxDepth"], training.sized_parameters(100)["minInstancesPerNode"]) == (2, 5)


def test_collapse_is_noted(parts):
    _, train, valid = parts
    fitted = training.fit_boosted(train, valid, **FAST | {"minInstancesPerNode": 10**6})
    assert training.diagnosis(fitted, 12) == ["collapsed", "few_symbols", "few_rows"] and set(fitted.history) == {0.0}


def test_folds():
    folds = training.retrain_folds(DAYS, 3, test_days=10, valid_days=12, embargo=4, min_train_days=30)
    assert [f.test for f in folds] == [(DAYS[70], DAYS[80]), (DAYS[80], DAYS[90]), (DAYS[90], None)]
    for f in folds:
        at = DAYS.index
        assert at(f.valid[0]) - at(f.train_end) == 4 and at(f.valid[1]) - at(f.valid[0]) == 12 and at(f.test[0]) - at(f.valid[1]) == 4
    with pytest.raises(ValueError, match="too few"):
        training.retrain_folds(DAYS[:79], 3, test_days=10, valid_days=12, embargo=4, min_train_days=30)


def test_retraining_sees_nothing_of_its_test(spark, panel):
    """A fold's scores hold whatever the labels of its test and everything later are."""
    folds = training.retrain_folds(DAYS, 2, test_days=15, valid_days=15, embargo=5, min_train_days=30)
    made = training.retrain(panel, FEATURES, folds, **FAST)
    assert [r.fold for r in made.fits] == [1, 2] and made.fits[0].train_end < made.fits[1].train_end
    for fit, fold in zip(made.fits, folds, strict=True):
        assert fit.train_end < fold.train_end < fit.test_from == fold.test[0]
    dates = [{r.date for r in made.scores.filter(F.col("fold") == k).select("date").distinct().collect()} for k in (1, 2)]
    assert not dates[0] & dates[1] and len(dates[0] | dates[1]) == 30
    # the same features in the test part, but other labels there and everything else changed after it
    later = _panel(spark, changed_from=DAYS.index(folds[0].test[1]))
    blind = later.withColumn("label", F.when(F.col("date") >= folds[0].test[0], -F.col("label")).otherwise(F.col("label")))
    scores = lambda made: {(r.symbol, r.date): round(r.pred, 9) for r in made.scores.filter("fold = 1").collect()}
    assert scores(training.retrain(blind, FEATURES, folds[:1], **FAST)) == scores(made)
    mean = evaluate.daily_ic(made.scores).agg(F.avg("ic")).first()[0]
    assert mean > 0.5


def test_ensemble_of_seeds(panel):
    folds = training.retrain_folds(DAYS, 1, test_days=10, valid_days=10, embargo=5, min_train_days=30)
    made = training.retrain(panel, FEATURES, folds, n_seeds=2, **FAST | {"rounds": 2, "first": 2, "subsamplingRate": 0.7})
    assert len(made.fits[0].rounds) == 2 and made.scores.count() == 120
    assert abs(made.scores.agg(F.avg("pred")).first()[0]) < 1e-9


@pytest.fixture(scope="module")
def kept(spark, panel, tmp_path_factory):
    store = training.ModelStore(spark, str(tmp_path_factory.mktemp("models")))
    model_id, fitted, metrics = training.train_local(store, panel, FEATURES, "u", **FAST)
    return store, model_id, metrics


def test_training_keeps_what_it_used(kept):
    store, model_id, metrics = kept
    about = store.about(model_id)
    assert about.features == FEATURES and about.train_end < about.valid_start < about.valid_end < about.test_start
    assert metrics["ic"] == metrics["test_ic"] > 0.5 and metrics["n_train"] > metrics["n_valid"] and "few_symbols" in about.notes
    assert store.test_start(model_id) == about.test_start


def test_models_and_the_active_one(spark, kept, tmp_path):
    store = training.ModelStore(spark, str(tmp_path))
    assert store.models().count() == 0 and store.active_id("u") is None
    a, b, c = (store.register(n, u, None, None) for n, u in (("a", "u"), ("b", "u"), ("c", "v")))
    store.activate(a)
    store.activate(c)
    assert (store.active_id("u"), store.active_id("v"), store.active_id("w")) == (a, c, None)
    store.activate(b)
    assert {r.name: r.active for r in store.models().collect()} == {"a": False, "b": True, "c": True}
    with pytest.raises(KeyError):
        store.activate("m_none")
    with pytest.raises(KeyError):
        store.load("m_none")
    with pytest.raises(FileNotFoundError):
        store.load(a)
    whole = kept[0].load(kept[1])
    with pytest.raises(ValueError, match="without a scaler"):
        store.load(store.register("bare", "u", whole.model, None))
    with pytest.raises(ValueError, match="test part begins"):
        store.test_start(a)
    old = store.register("old", "u", None, None, embargo=7, bounds={"valid": (DAYS[0], DAYS[10])})
    assert store.test_start(old) == DAYS[17]


def test_predictions_use_the_kept_scaler(kept, panel, monkeypatch):
    store, model_id, _ = kept
    assert store.ml_score(panel, "u").filter("ml_score is not null").count() == 0
    monkeypatch.setattr(training.Scaler, "fit", lambda *_: pytest.fail("a scaler was fitted to score"))
    best = store.predict(model_id, panel, top=5).collect()
    assert [r.score for r in best] == sorted((r.score for r in best), reverse=True) and len({r.symbol for r in best}) == 5
    again = store.predict(model_id, panel.withColumn("other", F.lit(1)).select("other", "f2", "date", "f0", "symbol", "f1"), top=5, keep=False).collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in best]
    assert store.kept_scores(model_id).count() == 5 and {r.date for r in store.kept_scores().collect()} == {DAYS[-1]}
    assert [r.symbol for r in store.top(DAYS[-1], model_id, n=2).collect()] == [r.symbol for r in best[:2]]
    store.activate(model_id)
    assert {r.symbol for r in store.ml_score(panel, "u").filter("ml_score is not null").select("symbol").distinct().collect()} == {r.symbol for r in best}
    early = store.predict(model_id, panel, DAYS[-10], top=3, keep=False)
    assert early.count() == 3
    with pytest.raises(ValueError, match=str(DAYS[-1])):
        store.predict(model_id, panel, dt.date(1999, 1, 4))
    with pytest.raises(ValueError, match="missing"):
        store.predict(model_id, panel.drop("f1"), keep=False)


def test_backtest_begins_after_what_was_seen(spark, kept, panel, monkeypatch):
    store, model_id, _ = kept
    seen = {}
    monkeypatch.setattr(training, "backtest_scores", lambda bars, scores, config: seen.update(first=scores.agg(F.min("date")).first()[0], bars=bars.agg(F.min("date")).first()[0]) or scores)
    bars = panel.select("symbol", "date", F.lit(10.0).alias("close"))
    store.backtest(model_id, panel, bars, top=3)
    assert seen == {"first": store.test_start(model_id), "bars": store.test_start(model_id)}
    store.backtest(model_id, panel, bars, start=DAYS[95], top=3)
    assert seen["first"] == DAYS[95]
    with pytest.raises(ValueError, match="no rows from"):
        store.backtest(model_id, panel, bars, start=dt.date(2030, 1, 1))
    with pytest.raises(ValueError, match="test part begins"):
        store.backtest(store.register("old", "u", None, None), panel, bars)


def test_labels(panel):
    ranked = training.labelled(panel.withColumn("label", F.when(F.col("symbol") != "S00", F.col("label"))))
    want = rank_norm(panel.filter("symbol <> 'S00'"), "label")
    key = lambda f: {(r.symbol, r.date): round(r.label, 9) for r in f.collect()}
    assert key(ranked) == key(want)
    assert training.labelled(panel, "none").count() == panel.count()
