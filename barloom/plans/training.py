"""Queries that fit models: retraining over time, and models kept, loaded and put to work."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.lineage import cut, shared_folder
from barloom.operators import alpha, evaluate, training
from barloom.plans.evaluate import ALL, _features
from barloom.plans.registry import query, rounded
from barloom.sources.bars import brand_week_bars

#: The bars are weeks, of which there are about 350: shorter parts than those for days.
FOLDS = {"n_folds": 3, "test_days": 30, "valid_days": 40, "embargo": 5, "min_train_days": 150}


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of all bars, written once: what follows reads the panel, which grows with symbols and dates, and not the lines again."""
    return cut(_features(spark, sf_dir, ALL))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.labelled(_kept(spark, sf_dir))


@query("wf_retrain")
def wf_retrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each fold of expanding windows over all 158 features, and fold 0 for all out-of-sample scores together."""
    panel = _labelled(spark, sf_dir)
    dates = [r.date for r in panel.select("date").distinct().collect()]  # the calendar
    made = training.retrain(panel, ALL, training.retrain_folds(dates, **FOLDS))
    scores = made.scores.withColumn("fold", F.explode(F.array("fold", F.lit(0))))
    each = by_fold(scores)
    fits = spark.createDataFrame([(r.fold, r.train_end, r.test_from, r.test_to, r.n_train, r.n_test, r.rounds[0]) for r in made.fits], "fold int, train_end date, test_from date, test_to date, n_train long, n_test long, rounds int")
    out = each.join(F.broadcast(fits), "fold", "left")  # a row a fold
    return out.select("fold", "train_end", "test_from", "test_to", "n_train", "n_test", "rounds", "n_days", *(rounded(c).alias(c) for c in ("ic_mean", "icir", "t_stat_nw", "ic_win_rate")))


def by_fold(scores: DataFrame) -> DataFrame:
    """The summary of daily rank coefficients of each fold; tests of different folds share no date."""
    daily = evaluate.daily_ic(scores.filter("fold = 0")).join(scores.filter("fold > 0").select("date", F.col("fold").alias("own")).distinct(), "date")
    long = daily.withColumn("fold", F.explode(F.array("own", F.lit(0)))).drop("own")
    return evaluate.ic_summary(long, 5, ("fold",))


@lru_cache(8)
def _store(application: str, folder: str, sf_dir: str) -> tuple[training.ModelStore, str]:
    """A model of the table's data, fitted once a session and kept."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    store = training.ModelStore(spark, f"{folder}/models-{application}-{abs(hash(sf_dir))}")
    model_id, _, _ = training.train_local(store, _labelled(spark, sf_dir), ALL, "brands")
    store.activate(model_id)
    return store, model_id


def kept_model(spark: SparkSession, sf_dir: str) -> tuple[training.ModelStore, str]:
    return _store(spark.sparkContext.applicationId, shared_folder(spark), sf_dir)


@query("train_local")
def train_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the registry holds of the model: its parts and figures."""
    store, model_id = kept_model(spark, sf_dir)
    rows = store.models("brands").filter(F.col("model_id") == model_id)
    figures = ("n_train", "n_valid", "n_test", "n_symbols", "best_round", "valid_ic", "test_ic")
    return rows.select("universe", "horizon", F.size("features").alias("n_features"), "train_start", "train_end", "valid_start", "valid_end", "test_start", "test_end", "active", "notes", *(rounded(F.col("metrics")[c]).alias(c) for c in figures))


@query("predict_local")
def predict_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the last date by the kept model, as the store gives them back for the active model."""
    store, _ = kept_model(spark, sf_dir)
    panel = _kept(spark, sf_dir)
    last = panel.agg(F.max("date")).first()[0]
    store.predict(store.active_id("brands"), panel, last)
    return store.top(last, universe="brands").select("symbol", "date", rounded("score").alias("score"))


@query("ml_score")
def ml_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bar of each symbol with the active model's score."""
    store, model_id = kept_model(spark, sf_dir)
    bars = cut(brand_week_bars(spark, sf_dir))
    last = bars.groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    store.predict(model_id, cut(alpha.panel(bars, names=ALL, horizon=5)), top=None)
    return store.ml_score(last, "brands").select("symbol", "date", rounded("close", 4).alias("close"), rounded("ml_score").alias("ml_score"))


@query("backtest_local")
def backtest_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the kept model earns from its test part on."""
    store, model_id = kept_model(spark, sf_dir)
    bars = cut(brand_week_bars(spark, sf_dir))
    return store.backtest(model_id, cut(alpha.panel(bars, names=ALL, horizon=5)), bars)
