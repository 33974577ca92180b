"""Back-tests and exports that go through files, and the limits of freshness."""

from __future__ import annotations

import datetime as dt

import pytest

from barloom.sources import store


def test_runs_are_there_or_not(spark, tmp_path):
    kept = store.RunStore(spark, str(tmp_path / "runs"))
    metrics = lambda x, at: spark.createDataFrame([("A", x, dt.datetime(2024, 1, at))], "symbol string, sharpe double, created_at timestamp")
    equity, trades = spark.createDataFrame([("A", 1.0)], "symbol string, equity double"), spark.createDataFrame([], "symbol string, pnl_pct double")
    kept.save("one", metrics(1.5, 1), equity, trades)
    kept.save("two", metrics(0.5, 2), equity, trades)
    with pytest.raises(ValueError):
        kept.save("one", metrics(9.0, 3), equity, trades)
    assert [r.run for r in kept.runs().collect()] == ["two", "one"] and kept.runs("B").count() == 0 and kept.runs(limit=1).first().run == "two"
    assert kept.load("one")["equity"].first().equity == 1.0 and kept.load("one")["trades"].count() == 0
    assert {(r.run, r.place) for r in store.compared(kept.runs(), "sharpe").collect()} == {("one", 1), ("two", 2)}
    assert kept.remove("one") and not kept.remove("one") and [r.run for r in kept.runs().collect()] == ["two"]
    with pytest.raises(KeyError):
        kept.load("one")


def test_freshness(spark):
    now, day = dt.datetime(2024, 3, 8, 12, tzinfo=dt.timezone.utc), dt.date(2024, 3, 8)
    rows = {
        "fresh": (now - dt.timedelta(hours=5), dt.date(2024, 1, 1), dt.date(2024, 3, 4)),
        "old": (now - dt.timedelta(hours=7), dt.date(2024, 1, 1), day),
        "ahead": (now + dt.timedelta(minutes=2), dt.date(2024, 1, 1), day),
        "short": (now, dt.date(2024, 1, 1), dt.date(2024, 3, 3)),
        "late": (now, dt.date(2024, 2, 2), day),
        "never": (None, dt.date(2024, 1, 1), day),
    }
    frame = spark.createDataFrame([(k, *v) for k, v in rows.items()], "symbol string, fetched_at timestamp, first_date date, last_date date")
    got = {r.symbol: r.ok for r in frame.select("symbol", store.is_fresh(dt.date(2024, 2, 1), day, now).alias("ok")).collect()}
    assert got == {k: k == "fresh" for k in rows}


def test_tags_updates_and_exports(spark, tmp_path):
    listed = spark.createDataFrame([("A.US", None, "US", "tech, big", 1), ("B.US", "b", "US", None, 2)], "symbol string, name string, market string, tags string, added_at int")
    assert [r.symbol for r in store.tagged(listed, " big ").collect()] == ["A.US"] and store.tagged(listed, "").count() == 2 and store.tagged(listed, "bi").count() == 0
    new = spark.createDataFrame([("A.US", "x", "y", 3), ("600519.SH", None, "y", 4), ("600519.SH", None, "y", 4)], "symbol string, name string, tags string, added_at int")
    more = store.watch(listed, new)
    assert {(r.symbol, r.market, r.tags) for r in more.collect()} == {("A.US", "US", "tech, big"), ("B.US", "US", None), ("600519.SH", "A", "y")}
    named = store.updated(more, spark.createDataFrame([("A.US", "a"), ("C", "c")], "symbol string, name string"), "symbol")
    assert {(r.symbol, r.name) for r in named.collect()} == {("A.US", "a"), ("B.US", "b"), ("600519.SH", None)}
    assert {r.symbol for r in store.removed(named, spark.createDataFrame([("B.US",), (None,)], "symbol string"), "symbol").collect()} == {"A.US", "600519.SH"}
    for form in ("csv", "json"):
        store.export({"list": named}, str(tmp_path / form), form)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv" / "list")).count() == spark.read.json(str(tmp_path / "json" / "list")).count() == 3
