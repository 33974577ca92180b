"""Boosted trees that stop by rank coefficient, retraining over time, and a store of fitted models.

A fit is judged on a validation part by the mean daily rank coefficient after
every round: one pass over its rows gives each row's leaf in every tree, the
running sums of the leaves' values are the scores after every round, and a
date's symbols are ranked for all rounds together.  The model is cut at the best
round.  More rounds are fitted until ``patience`` of them bring no gain.

Folds and seeds are fitted side by side: each is a sequence of Spark jobs, and
the driver keeps several of them going.
"""

from __future__ import annotations

import math
import uuid
import warnings
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date as Date
from datetime import datetime, timedelta
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.lineage import cut, shared_folder
from barloom.operators.crosssection import rank_norm, robust_fit, robust_transform, zscore_norm
from barloom.operators.evaluate import MIN_STOCKS, average_ranks
from barloom.operators.ml import seed_ensemble
from barloom.operators.portfolio import PortfolioConfig, backtest_scores, linear_weights

ROUNDS, PATIENCE = 1000, 50
#: Rounds of the first fit; a fit that has not stopped is repeated with twice as many.
FIRST = 64
#: Training rows of a task at least.
ROWS_A_TASK = 10_000
#: Fewer symbols or training rows than these are noted by :func:`diagnosis`.
LEAST_SYMBOLS, LEAST_ROWS = 50, 20_000

# --- the panel ---


def labelled(panel: DataFrame, norm: str = "rank") -> DataFrame:
    """``panel`` (symbol, date, features, label) without rows that have no label; the label is ranked or standardised by date, or kept."""
    rows = panel.dropna(subset=["label"])
    return {"rank": rank_norm, "zscore": zscore_norm, "none": lambda p, _: p}[norm](rows, "label")


@dataclass(frozen=True)
class Scaler:
    """Medians and deviations of the training rows, and the features' order."""

    features: tuple[str, ...]
    fitted: DataFrame  # feature, median, mad

    @staticmethod
    def fit(train: DataFrame, features: Sequence[str]) -> Scaler:
        return Scaler(tuple(features), cut(robust_fit(train, *features)))  # a row a feature

    def assembled(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the vector ``features``; features of other names are ignored, a missing one is an error."""
        missing = [f for f in self.features if f not in rows.columns]
        if missing:
            raise ValueError(f"features are missing: {missing[:5]} ({len(missing)} in all)")
        scaled = robust_transform(rows, self.fitted, *self.features)
        return VectorAssembler(inputCols=list(self.features), outputCol="__features").transform(scaled).drop(*self.features).withColumnRenamed("__features", "features")


# --- one fit ---


def sized_parameters(rows: int) -> dict[str, Any]:
    """Tree sizes for so many training rows: a leaf for each hundred and at least five or a fiftieth of them in it, up to those for 400,000."""
    leaves = max(7, min(210, rows // 100))
    return {"stepSize": 0.0421, "subsamplingRate": 0.8789, "featureSubsetStrategy": "0.8879", "maxDepth": int(math.log2(leaves)), "minInstancesPerNode": max(5, min(50, rows // 50))}


def leaf_values(spark: SparkSession, model: GBTRegressionModel) -> np.ndarray:
    """The weighted value of every tree's leaves in the order of their indices (trees by leaves, padded with zeros); read from the saved model."""
    path = f"{shared_folder(spark)}/boosted-{uuid.uuid4().hex}"
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data").filter("nodeData.leftChild < 0").select("treeID", "nodeData.id", "nodeData.prediction")
    rows = sorted(map(tuple, nodes.collect()))  # as many as the parameters allow
    values: list[list[float]] = [[] for _ in model.treeWeights]
    for tree, _, value in rows:
        values[tree].append(value * model.treeWeights[tree])
    out = np.zeros((len(values), max(map(len, values))))
    for tree, own in enumerate(values):
        out[tree, : len(own)] = own
    return out


def staged_ic(model: GBTRegressionModel, rows: DataFrame, label: str = "label", min_stocks: int = MIN_STOCKS) -> list[float]:
    """The mean daily rank coefficient after each round over ``rows`` (date, features, label); days with fewer symbols do not count."""
    values = leaf_values(rows.sparkSession, model)
    rounds = len(values)

    def run(day: pa.Table) -> pa.Table:
        known = np.asarray(day["label"].to_numpy(), float)
        leaves = day["leaves"].combine_chunks().flatten().to_numpy().reshape(-1, rounds).astype(np.int64)
        good = np.isfinite(known)
        if good.sum() < min_stocks:
            return pa.table({"ics": pa.array([], pa.list_(pa.float64()))})
        scores = np.cumsum(values[np.arange(rounds), leaves[good]], axis=1)
        ranks = average_ranks(np.column_stack([known[good], scores]))
        ranks -= ranks.mean(axis=0)
        y, x = ranks[:, :1], ranks[:, 1:]
        spread = np.sqrt((x * x).sum(axis=0) * (y * y).sum())
        ics = np.divide((x * y).sum(axis=0), spread, out=np.zeros(rounds), where=spread > 0)
        return pa.table({"ics": pa.array([ics], pa.list_(pa.float64()))})

    scored = model.copy().setLeafCol("__leaf").transform(rows).select("date", F.col(label).alias("label"), vector_to_array("__leaf").alias("leaves"))
    days = scored.groupBy("date").applyInArrow(run, T.StructType([T.StructField("ics", T.ArrayType(T.DoubleType()))]))
    means = days.select(F.posexplode("ics").alias("round", "ic")).groupBy("round").agg(F.avg("ic").alias("ic")).orderBy("round").collect()  # a row a round
    return [r.ic for r in means] or [0.0] * rounds


def best_round(history: Sequence[float], patience: int) -> tuple[int, bool]:
    """The round of the largest coefficient before ``patience`` rounds went by without a larger one (counted from 1), and whether they did."""
    best = 0
    for k, value in enumerate(history):
        if value > history[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def truncated(spark: SparkSession, model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model of the first rounds only."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    trees: list[DecisionTreeRegressionModel] = model.trees[:rounds]
    kept, weights = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees)), gateway.new_array(jvm.double, len(trees))
    for k, tree in enumerate(trees):
        kept[k], weights[k] = tree._java_obj, model.treeWeights[k]
    return GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"gbtr_{uuid.uuid4().hex[:12]}", kept, weights))


@dataclass(frozen=True)
class Boosted:
    """A model cut at its best round; ``history`` holds the coefficients of all rounds that were fitted."""

    model: GBTRegressionModel
    best: int
    score: float
    history: tuple[float, ...]
    n_train: int
    collapsed: bool

    def scores(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows).withColumnRenamed("prediction", "pred")


def fit_boosted(train: DataFrame, valid: DataFrame | None, seed: int = 42, rounds: int = ROUNDS, patience: int = PATIENCE, first: int = FIRST, **parameters: Any) -> Boosted:
    """Boosted trees on assembled rows (date, features, label), stopped by the rank coefficient on ``valid``.

    Fits of one seed begin with the same trees, so a longer one carries on where
    a shorter one ended.  Without validation rows all rounds are fitted, with a
    warning.  Given parameters hold as they are.
    """
    train = train.cache()
    try:
        rows = train.count()
        # every level of every tree is a job over all partitions
        packed = train.coalesce(max(1, rows // ROWS_A_TASK)).cache()
        valid = None if valid is None or not valid.limit(1).count() else valid.cache()
        if valid is None:
            warnings.warn(f"no validation rows: {rounds} rounds without a stop", stacklevel=2)
        options = {"labelCol": "label", "seed": seed} | sized_parameters(rows) | parameters
        best, history, spent = rounds, [], rounds if valid is None else min(first, rounds)
        while True:
            model = GBTRegressor(maxIter=spent, **options).fit(packed)
            if valid is None:
                break
            history = staged_ic(model, valid)
            best, stopped = best_round(history, patience)
            if stopped or spent >= rounds:
                break
            spent = min(rounds, 2 * spent)
        model = truncated(train.sparkSession, model, best)
        # without a single split all predictions are alike, and every coefficient is 0
        collapsed = all(t.numNodes == 1 for t in model.trees)
        return Boosted(model, best, history[best - 1] if history else 0.0, tuple(history), rows, collapsed)
    finally:
        packed.unpersist()
        train.unpersist()
        if valid is not None:
            valid.unpersist()


def diagnosis(fitted: Boosted, n_symbols: int) -> list[str]:
    """What makes a fit's figures doubtful: collapsed, few_symbols, few_rows."""
    found = {"collapsed": fitted.collapsed, "few_symbols": n_symbols < LEAST_SYMBOLS, "few_rows": fitted.n_train < LEAST_ROWS}
    return [name for name, holds in found.items() if holds]


# --- retraining over time ---


@dataclass(frozen=True)
class Fold:
    """Dates of a fold: training before ``train_end``, validation and test from the first to before the second."""

    number: int
    train_end: Any
    valid: tuple[Any, Any]
    test: tuple[Any, Any]

    def part(self, rows: DataFrame, name: str) -> DataFrame:
        if name == "train":
            return rows.filter(F.col("date") < self.train_end)
        low, high = {"valid": self.valid, "test": self.test}[name]
        return rows.filter((F.col("date") >= low) & (F.lit(True) if high is None else F.col("date") < high))


def retrain_folds(dates: Sequence[Any], n_folds: int = 6, test_days: int = 40, valid_days: int = 60, embargo: int = 5, min_train_days: int = 250) -> list[Fold]:
    """Folds whose tests are the last dates in turn; ``embargo`` dates lie before each validation and each test part.

    Training starts at the first date and ends later in every fold.  Too few
    dates for all folds are an error.
    """
    dates = sorted(dates)
    need = min_train_days + valid_days + 2 * embargo + n_folds * test_days
    if len(dates) < need:
        raise ValueError(f"{len(dates)} dates are too few: {n_folds} folds need {need}")
    folds = []
    for number in range(1, n_folds + 1):
        test = len(dates) - (n_folds - number + 1) * test_days
        valid_end = test - embargo
        valid = valid_end - valid_days
        after = test + test_days
        folds.append(Fold(number, dates[valid - embargo], (dates[valid], dates[valid_end]), (dates[test], dates[after] if after < len(dates) else None)))
    return folds


@dataclass(frozen=True)
class Retrained:
    """``scores``: fold, symbol, date, label, pred of all tests.  ``fits``: a row a fold."""

    scores: DataFrame
    fits: list[Row]


def retrain(panel: DataFrame, features: Sequence[str], folds: Sequence[Fold], seed: int = 42, n_seeds: int = 1, side_by_side: int = 4, **options: Any) -> Retrained:
    """A scaler and a model for every fold, of its own training dates only, scored on its test dates.

    Several seeds are one ensemble of a fold: their scores are standardised
    over the fold's test part and averaged.
    """
    rows = cut(panel.select("symbol", "date", "label", *features))

    def one(fold: Fold) -> tuple[DataFrame, Row]:
        scaler = Scaler.fit(fold.part(rows, "train"), features)
        train, valid, test = (scaler.assembled(fold.part(rows, part)) for part in ("train", "valid", "test"))
        fits = [fit_boosted(train, valid, seed=seed + fold.number + k, **options) for k in range(n_seeds)]
        if n_seeds == 1:
            scored = fits[0].scores(test).select("symbol", "date", "label", "pred")
        else:
            each = [f.scores(test).select(F.lit(str(k)).alias("model"), "symbol", "date", "pred") for k, f in enumerate(fits)]
            joined = each[0]
            for more in each[1:]:
                joined = joined.unionByName(more)
            scored = test.select("symbol", "date", "label").join(seed_ensemble(joined).withColumnRenamed("score", "pred"), ["symbol", "date"])
        scored = cut(scored.select(F.lit(fold.number).alias("fold"), "symbol", "date", "label", "pred"))
        ends = scored.agg(F.min("date").alias("low"), F.max("date").alias("high"), F.count(F.lit(1)).alias("n")).first()
        last = fold.part(rows, "train").agg(F.max("date")).first()[0]
        return scored, Row(fold=fold.number, train_end=last, test_from=ends.low, test_to=ends.high, n_train=fits[0].n_train, n_test=ends.n, rounds=[f.best for f in fits], valid_ic=[f.score for f in fits])

    with ThreadPoolExecutor(side_by_side) as pool:
        done = list(pool.map(one, folds))
    scores = done[0][0]
    for more, _ in done[1:]:
        scores = scores.unionByName(more)
    return Retrained(scores, [fit for _, fit in done])


# --- a store of models ---


@dataclass(frozen=True)
class Stored:
    """A model as it was fitted: its scaler, its feature order, and the dates of its parts."""

    model_id: str
    model: GBTRegressionModel
    scaler: Scaler
    horizon: int
    about: Row


class ModelStore:
    """Models in the folder ``path``, which driver and executors share.

    A model's booster and scaler are written under a new id; its row in the
    registry comes last and makes it there.  Rows are only added: the active
    model of a universe is the one that was activated last.
    """

    ABOUT = "model_id string, name string, universe string, algo string, horizon int, embargo int, features array<string>, train_start date, train_end date, valid_start date, valid_end date, test_start date, test_end date, metrics map<string, double>, trained_at timestamp, notes string"
    ACTIVE = "universe string, model_id string, at timestamp, turn long"
    SCORES = "model_id string, symbol string, date date, score double, written_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _there(self, path: str) -> bool:
        path = self._hadoop.Path(path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(path) if self._there(path) else self.spark.createDataFrame([], schema)

    def _add(self, table: str, schema: str, row: dict[str, Any]) -> None:
        order = [f.name for f in T._parse_datatype_string(schema).fields]
        self.spark.createDataFrame([tuple(row.get(c) for c in order)], schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}")

    def register(self, name: str, universe: str, model: GBTRegressionModel | None, scaler: Scaler | None, *, horizon: int = 5, embargo: int = 5, bounds: dict[str, tuple[Date | None, Date | None]] | None = None, metrics: dict[str, float] | None = None, algo: str = "gbt", notes: str | None = None, features: Sequence[str] = ()) -> str:
        """Keep a model under a new id; it is not active yet."""
        model_id = f"m_{datetime.now():%Y%m%d}_{uuid.uuid4().hex[:8]}"
        folder = f"{self.path}/models/{model_id}"
        if model is not None:
            model.save(f"{folder}/booster")
        if scaler is not None:
            places = self.spark.createDataFrame(list(enumerate(scaler.features)), "place int, feature string")
            places.join(scaler.fitted, "feature", "left").coalesce(1).write.parquet(f"{folder}/scaler")
        parts = {f"{part}_{end}": value for part, both in (bounds or {}).items() for end, value in zip(("start", "end"), both, strict=True)}
        names = list(scaler.features) if scaler is not None else list(features)
        about = {"model_id": model_id, "name": name, "universe": universe, "algo": algo, "horizon": horizon, "embargo": embargo, "features": names, "trained_at": datetime.now(), "notes": notes}
        self._add("registry", self.ABOUT, about | parts | {"metrics": {k: float(v) for k, v in (metrics or {}).items()}})
        return model_id

    def models(self, universe: str | None = None) -> DataFrame:
        """The registry with ``active``, newest first."""
        active = self._table("active", self.ACTIVE).groupBy("universe").agg(F.max_by("model_id", F.struct("at", "turn")).alias("__active"))
        rows = self._table("registry", self.ABOUT).join(active, "universe", "left")
        rows = rows.withColumn("active", F.coalesce(F.col("model_id") == F.col("__active"), F.lit(False))).drop("__active")
        return (rows if universe is None else rows.filter(F.col("universe") == universe)).orderBy(F.col("trained_at").desc(), "model_id")

    def about(self, model_id: str) -> Row:
        rows = self._table("registry", self.ABOUT).filter(F.col("model_id") == model_id).limit(1).collect()
        if not rows:
            raise KeyError(f"there is no model {model_id!r}")
        return rows[0]

    def activate(self, model_id: str) -> None:
        """Make it the active model of its universe, and the others there not."""
        universe = self.about(model_id).universe
        turn = self._table("active", self.ACTIVE).count()  # a row for each activation
        self._add("active", self.ACTIVE, {"universe": universe, "model_id": model_id, "at": datetime.now(), "turn": turn})

    def active_id(self, universe: str) -> str | None:
        row = self.models(universe).filter("active").select("model_id").first()
        return None if row is None else row.model_id

    def load(self, model_id: str) -> Stored:
        about, folder = self.about(model_id), f"{self.path}/models/{model_id}"
        if not self._there(f"{folder}/booster"):
            raise FileNotFoundError(f"the files of model {model_id!r} are gone: {folder}")
        if not self._there(f"{folder}/scaler"):
            raise ValueError(f"model {model_id!r} was kept without a scaler and cannot score features")
        fitted = self.spark.read.parquet(f"{folder}/scaler")
        features = tuple(r.feature for r in fitted.orderBy("place").select("feature").collect())  # a row a feature
        return Stored(model_id, GBTRegressionModel.load(f"{folder}/booster"), Scaler(features, fitted.select("feature", "median", "mad")), about.horizon, about)

    def scores(self, model_id: str, panel: DataFrame) -> DataFrame:
        """symbol, date, pred of every row of ``panel``, by the scaler that was kept with the model."""
        stored = self.load(model_id)
        return stored.model.transform(stored.scaler.assembled(panel)).select("symbol", "date", F.col("prediction").alias("pred"))

    def predict(self, model_id: str, panel: DataFrame, date: Date | None = None, top: int | None = 20, keep: bool = True) -> DataFrame:
        """symbol, score of the best of one date, the last of the panel unless one is named; kept in the store unless told otherwise."""
        if date is None:
            date = panel.agg(F.max("date")).first()[0]
        day = panel.filter(F.col("date") == F.lit(date))
        if date is None or not day.limit(1).count():
            near = [str(r.date) for r in panel.select("date").distinct().orderBy(F.col("date").desc()).limit(3).collect()]
            raise ValueError(f"no rows of {date}; the latest dates are {near}")
        best = self.scores(model_id, day).select("symbol", F.col("pred").alias("score")).orderBy(F.col("score").desc(), "symbol")
        best = best if top is None else best.limit(top)
        if keep:
            best = cut(best)
            best.select(F.lit(model_id).alias("model_id"), "symbol", F.lit(date).cast("date").alias("date"), "score", F.current_timestamp().alias("written_at")).write.mode("append").parquet(f"{self.path}/scores")
        return best

    def kept_scores(self, model_id: str | None = None) -> DataFrame:
        """What was predicted and kept, the last one of a model, symbol and date."""
        rows = self._table("scores", self.SCORES)
        rows = rows if model_id is None else rows.filter(F.col("model_id") == model_id)
        return rows.groupBy("model_id", "symbol", "date").agg(F.max_by("score", "written_at").alias("score"))

    def top(self, date: Date, model_id: str | None = None, universe: str | None = None, n: int = 20) -> DataFrame:
        """The best kept scores of a date, of the universe's active model unless one is named."""
        model_id = model_id or (self.active_id(universe) if universe is not None else None)
        rows = self.kept_scores(model_id).filter(F.col("date") == F.lit(date))
        return rows.orderBy(F.col("score").desc(), "symbol").limit(n)

    def ml_score(self, bars: DataFrame, universe: str) -> DataFrame:
        """``bars`` with ``ml_score``: the symbol's last kept score of the active model, null where there is none."""
        model_id = self.active_id(universe)
        if model_id is None:
            return bars.withColumn("ml_score", F.lit(None).cast("double"))
        last = self.kept_scores(model_id).groupBy("symbol").agg(F.max_by("score", "date").alias("ml_score"))
        return bars.join(last, "symbol", "left")

    def test_start(self, model_id: str) -> Date:
        """The first date that the model has not seen: of its test part, or else so many days after validation as were kept apart."""
        about = self.about(model_id)
        if about.test_start is not None:
            return about.test_start
        if about.valid_end is not None:
            return about.valid_end + timedelta(days=about.embargo)
        raise ValueError(f"model {model_id!r} does not tell where its test part begins: name a start after what it was trained on")

    def backtest(self, model_id: str, panel: DataFrame, bars: DataFrame, start: Date | None = None, top: int = 10, config: PortfolioConfig | None = None) -> DataFrame:
        """:func:`backtest_scores` of the model's scores from its test part on, or from ``start``."""
        begin = start or self.test_start(model_id)
        rows = panel.filter(F.col("date") >= F.lit(begin))
        if not rows.limit(1).count():
            raise ValueError(f"no rows from {begin} on")
        config = config or PortfolioConfig(max_positions=top, rebalance="weekly", allocation="score")
        return backtest_scores(bars.filter(F.col("date") >= F.lit(begin)), linear_weights(self.scores(model_id, rows), top), config)


def train_local(store: ModelStore, panel: DataFrame, features: Sequence[str], universe: str, *, name: str | None = None, horizon: int = 5, embargo: int | None = None, valid_ratio: float = 0.15, test_ratio: float = 0.15, seed: int = 42, **options: Any) -> tuple[str, Boosted, dict[str, float]]:
    """Fit on the training dates, stop by the validation dates, judge on the test dates, and keep the model with its scaler.

    Returns its id, the fit and what was kept of it as figures.
    """
    from barloom.operators.crosssection import purged_split
    from barloom.operators.evaluate import daily_ic

    embargo = horizon if embargo is None else embargo
    rows = cut(purged_split(panel.select("symbol", "date", "label", *features), valid_ratio, test_ratio, embargo, with_test=test_ratio > 0).filter("split is not null"))
    part = lambda n: rows.filter(F.col("split") == n)
    scaler = Scaler.fit(part("train"), features)
    fitted = fit_boosted(scaler.assembled(part("train")), scaler.assembled(part("valid")), seed=seed, **options)
    sizes = {r.split: r for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("low"), F.max("date").alias("high")).collect()}
    metrics = {"valid_ic": fitted.score, "best_round": fitted.best, "rounds": len(fitted.history), "n_symbols": rows.select("symbol").distinct().count()} | {f"n_{k}": r.n for k, r in sizes.items()}
    if "test" in sizes:
        metrics["test_ic"] = daily_ic(fitted.scores(scaler.assembled(part("test")))).agg(F.avg("ic")).first()[0] or 0.0
    metrics["ic"] = metrics.get("test_ic", fitted.score)
    day = lambda x: x.date() if isinstance(x, datetime) else x
    bounds = {k: (day(r.low), day(r.high)) for k, r in sizes.items()}
    notes = ", ".join(diagnosis(fitted, int(metrics["n_symbols"]))) or None
    model_id = store.register(name or f"gbt_h{horizon}", universe, fitted.model, scaler, horizon=horizon, embargo=embargo, bounds=bounds, metrics=metrics, notes=notes)
    return model_id, fitted, metrics
