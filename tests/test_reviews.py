"""Verdicts at their limits, flattened exports, flows, and events under other names."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from barloom.operators import events as ev
from barloom.operators import journal as jn
from barloom.operators import robust
from barloom.operators import screen as sc
from barloom.sources import store


def test_verdict_of_an_optimum(spark):
    cases = {"losing": (0.0, 5.0, 1.0), "overfitted": (1.0, 0.0, 1.0), "decayed": (1.0, 0.4, 1.0), "spike": (1.0, 0.6, 0.29), "fading": (1.0, 0.6, 0.3), "holding": (1.0, 0.75, 0.3), None: (None, 1.0, 1.0)}
    chosen = spark.createDataFrame([(str(k), "c", i, o) for k, (i, o, _) in cases.items()], "symbol string, case string, in_sample double, out_of_sample double")
    plateaus = spark.createDataFrame([(str(k), p) for k, (_, _, p) in cases.items()], "symbol string, plateau double")
    rows = {r.symbol: r for r in robust.optimise_verdict(chosen, plateaus).collect()}
    assert {k: r.verdict for k, r in rows.items()} == {str(k): k for k in cases}
    assert rows["decayed"].degradation == pytest.approx(0.6) and rows["losing"].degradation == 0.0


def test_verdict_of_walking_forward(spark):
    cases = {"few_windows": [1.0, 2.0], "losing": [-1.0, 0.0, 3.0], "unstable": [1.0, 1.0, 9.0], "steady": [1.0, 2.0, 1.5], "few_winners": [-1.0, -1.0, 1.0]}
    rows = [(k, n, v) for k, own in cases.items() for n, v in enumerate(own)] + [("steady", 9, float("nan")), ("steady", 10, None)]
    got = {r.symbol: r.verdict for r in robust.walk_forward_verdict(spark.createDataFrame(rows, "symbol string, fold int, total_return double")).collect()}
    assert got == {k: k for k in cases} | {"few_winners": "losing"}  # a median above 0 has half of the windows above 0


def test_runs_and_signals_flattened(spark):
    runs = spark.createDataFrame([("a", {"sharpe": 1.0, "ret": 2.0}), ("b", {"ret": 3.0}), ("c", None)], "run string, metrics map<string, double>")
    assert [tuple(r) for r in store.flat_runs(runs).orderBy("run").collect()] == [("a", 2.0, 1.0), ("b", 3.0, None), ("c", None, None)]
    context = [json.dumps({"title": "t", "body": "x\ny", "more": {"a": 1}}), "{}", "no json", None]
    flat = store.flat_signals(spark.createDataFrame(list(enumerate(context)), "id int, context string")).orderBy("id")
    assert flat.columns == ["id", "title", "body"] and [tuple(r)[1:] for r in flat.collect()] == [("t", "x / y"), ("", ""), ("", ""), ("", "")]


def test_an_export_tells_what_it_left_out(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (2,)], "x int")

    def fails():
        raise KeyError("gone")

    loaders = {"good": lambda: rows, "empty": lambda: rows.limit(0), "bad": fails}
    assert store.export_all(loaders, str(tmp_path / "a"), form="json") == [("good", 2, None), ("empty", 0, "no rows"), ("bad", 0, "KeyError: 'gone'")]
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["good"] and spark.read.json(str(tmp_path / "a/good")).count() == 2
    assert [r[0] for r in store.export_all(loaders, str(tmp_path / "b"), ["good"])] == ["good"]
    for names, form in ((["other"], "csv"), (None, "xlsx")):
        with pytest.raises(ValueError, match="unknown"):
            store.export_all(loaders, str(tmp_path / "c"), names, form)
    assert not (tmp_path / "c").exists()


def test_flows(spark):
    day = lambda k: dt.date(2024, 1, k)
    flows = spark.createDataFrame([("n", day(1), 5.0), ("n", day(2), -9.0), ("n", day(3), None), ("one", day(1), 50.0)], "source string, date date, net double")
    rules = spark.createDataFrame([(1, "n", "flow", 9.0), (2, "n", "flow", 9.1), (3, "one", "flow", 1.0), (4, "n", "event", 0.0)], "rule_id int, symbol string, type string, level double")
    assert [tuple(r) for r in sc.flows_fired(flows, rules).collect()] == [(1, "n", day(2), -9.0, 5.0, "out")]


def test_tables_under_other_names(spark):
    told = spark.createDataFrame([("1", "2024-01-02", "5", "x"), ("600000", "20240103", "6.5", "x"), ("2", "soon", "7", "x"), ("3", "2024-01-02", "-", "x"), (None, "2024-01-02", "1", "x")], "`代码` string, `解禁日期` string, `数量` string, `其他` string")
    rows = ev.picked(told, ("日期", "解禁日期"), ("占比", "数量")).orderBy("symbol").collect()
    assert [tuple(r) for r in rows] == [("000001", dt.date(2024, 1, 2), 5.0), ("600000", dt.date(2024, 1, 3), 6.5)]
    assert ev.picked(told, ("日期",), ("数量",)).count() == 0 and ev.picked(told.drop("代码"), ("解禁日期",), ("数量",)).columns == ["symbol", "publish_date", "value"]


def test_journal_of_today(spark):
    day = dt.date(2024, 1, 5)
    changes = spark.createDataFrame([("a", day, 5.0, "enter"), ("b", day, 6.0, "holding")], "symbol string, date date, close double, change string")
    index = spark.createDataFrame([(day, 9.0), (dt.date(2024, 1, 4), 8.0)], "date date, close double")
    assert [tuple(r) for r in jn.recommendations(changes, "s", index).collect()] == [(day, "a", "s", 5.0, 5, 9.0)]
    assert jn.recommendations(changes, "s").first().bench_price is None
    closed = spark.createDataFrame([(day, s, "s", dt.date(2024, 2, k), t) for s, k, t in (("a", 1, "closed"), ("b", 3, "closed"), ("c", 2, "open"), ("d", 3, "closed"))], "reco_date date, symbol string, strategy string, exit_date date, status string")
    assert [r.symbol for r in jn.recent_closed(closed, 2).collect()] == ["b", "d"] and jn.recent_closed(closed, strategy="t").count() == 0
