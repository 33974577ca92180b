"""Queries that take every feature, symbol, trial and round."""

from __future__ import annotations

import pytest

from barloom.operators import alpha, evaluate, ml
from barloom.plans import all as plans
from barloom.plans import evaluate as evaluation
from barloom.plans.registry import WEEK, r
from tests.oracle import spark_rows, sql_rows, tables

SF = "/root/testdata/sf0.01"
NAMES = alpha.feature_names()


@pytest.fixture
def seen(monkeypatch):
    """The features and options that reach the operators."""
    found = {}

    def record(module, name):
        plain = getattr(module, name)

        def run(*args, **options):
            found[name] = (args, options)
            return plain(*args, **options)

        monkeypatch.setattr(module, name, run)

    record(evaluate, "ic_matrix")
    record(evaluate, "factor_scan")
    return found


def test_ic_matrix_of_all_features(spark):
    assert len(NAMES) == 158
    sql = f"WITH {WEEK}, {evaluation.matrix_sql(NAMES)} SELECT feature, date, {r('ic')} AS ic FROM icm"
    names, found = spark_rows(plans.QUERIES["ic_matrix_all"](spark, SF))
    wanted_names, wanted = sql_rows(tables(SF), sql)
    assert names == wanted_names and len({x[names.index("feature")] for x in found}) == 158
    assert found == wanted


def test_composite_chooses_among_all_features(spark, seen):
    plans.QUERIES["baseline_composite"](spark, SF)
    assert seen["ic_matrix"][0][1] == NAMES


def test_scan_of_all_features_on_the_test_part(spark, seen):
    found = plans.QUERIES["factor_scan_all"](spark, SF).collect()
    panel, names = seen["factor_scan"][0]
    assert names == NAMES and len(found) == 15
    assert {x.split for x in panel.select("split").distinct().collect()} == {"test"}
    means = [abs(x.ic_mean) for x in found]
    assert means == sorted(means, reverse=True)


def test_wide_table_has_every_symbol(spark):
    frame = plans.QUERIES["trend_wide_all"](spark, SF)
    brands = [x[0] for x in tables(SF).execute(f"WITH {WEEK} SELECT DISTINCT symbol FROM bars").fetchall()]
    assert len(brands) == 25 and set(frame.columns) == {"date", *(f"b{b[6:]}" for b in brands)}
    narrow = plans.QUERIES["trend_wide_pivot"](spark, SF)
    assert spark_rows(frame.select(narrow.columns)) == spark_rows(narrow)


def test_trees_see_all_features(spark, monkeypatch):
    class Enough(Exception):
        pass

    def stop(panel, features, **parameters):
        assert features == NAMES and set(NAMES) <= set(panel.columns)
        raise Enough

    monkeypatch.setattr(ml, "train_gbt", stop)
    with pytest.raises(Enough):
        plans.QUERIES["gbdt_train"](spark, SF)


def test_random_benchmark_has_200_trials(spark):
    rows = plans.QUERIES["random_benchmark"](spark, "/root/testdata/sf0.001").collect()
    assert all(abs(x.p_value * 201 - round(x.p_value * 201)) < 1e-3 for x in rows)
    assert any(x.percentile % 5 for x in rows)


def test_trees_have_the_operators_own_parameters(spark, monkeypatch):
    class Enough(Exception):
        pass

    def stop(panel, features, **parameters):
        assert not {"maxIter", "maxDepth"} & set(parameters)
        raise Enough

    monkeypatch.setattr(ml, "train_gbt", stop)
    with pytest.raises(Enough):
        plans.QUERIES["gbdt_train"](spark, SF)
    assert ml.scaled_parameters(400_000)["maxIter"] == 40 and ml.scaled_parameters(400_000)["maxDepth"] == 5
