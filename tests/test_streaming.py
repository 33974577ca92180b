"""Rules on a stream, restarts, and the table of bars that a stream adds to."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barloom.operators.screen import after_cooldown
from barloom.streaming import live
from barloom.streaming.bar_table import BarTable, stored

T0 = dt.datetime(2024, 1, 1)
FIRED = "rule_id int, symbol string, ts timestamp, type string, cooldown_minutes int"
TICK = "symbol string, ts timestamp, seq long, price double"


def _run(spark, source, out, check):
    with live.keyed_state(spark):
        stream = live.cooled(spark.readStream.schema(FIRED).option("maxFilesPerTrigger", 1).parquet(source))
        query = stream.writeStream.option("checkpointLocation", check).trigger(availableNow=True).start(out)
        query.awaitTermination()
    return sorted((r.rule_id, r.symbol, r.ts) for r in spark.read.schema(live.FIRING).parquet(out).collect())


def test_cooldown_over_batches_and_restarts(spark, tmp_path):
    """Batches in order of time, the query ended and started again between them: what passes is what the batch operator keeps."""
    rng, at, rows = random.Random(2), T0, []
    for _ in range(300):
        at += dt.timedelta(minutes=rng.choice((1, 5, 20, 90)))
        rows.append((rng.choice((1, 2)), rng.choice("ab"), at, "x", 60))
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for k in range(0, 300, 100):
        spark.createDataFrame(rows[k : k + 100], FIRED).coalesce(1).write.mode("append").parquet(source)
        got = _run(spark, source, out, check)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    want = after_cooldown(spark.createDataFrame(rows, FIRED), 60, ("rule_id", "symbol"))
    assert got == sorted((r.rule_id, r.symbol, r.ts) for r in want.collect()) and len(got) < 200
    assert _run(spark, source, out, check) == got  # nothing new: nothing fires twice


def test_cooldown_of_none_silences_nothing(spark, tmp_path):
    rows = [(1, "a", T0 + dt.timedelta(seconds=k), "x", c) for k, c in enumerate((0, None, 0))] + [(2, "a", T0, "x", 5), (2, "a", T0, "x", 5)]
    spark.createDataFrame(rows, FIRED).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = _run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert [r[0] for r in got] == [1, 1, 1, 2]


def test_rules_on_quotes(spark, tmp_path):
    """General rules and a symbol's own, levels from positions, and symbols that nothing is known of."""
    quotes = [("a", T0, 10.0), ("a", T0 + dt.timedelta(minutes=1), 12.0), ("b", T0, 7.0), ("c", T0, 1.0)]
    spark.createDataFrame(quotes, "symbol string, ts timestamp, price double").coalesce(1).write.parquet(str(tmp_path / "in"))
    rules = spark.createDataFrame([(1, None, "price_cross", 9.0, "up", 0), (2, "b", "price_cross", 8.0, "down", 0), (3, None, "price_pct", 15.0, None, 0), (4, None, "stop_loss", None, None, 0)], "rule_id int, symbol string, type string, level double, direction string, cooldown_minutes int")
    known = spark.createDataFrame([("a", 10.0)], "symbol string, prev_close double")
    positions = spark.createDataFrame([("c", 1.5, None), ("a", 1.0, None)], "symbol string, stop_loss double, take_profit double")
    stream = spark.readStream.schema("symbol string, ts timestamp, price double").parquet(str(tmp_path / "in"))
    with live.keyed_state(spark):
        live.watched(stream, known, rules, positions).writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = sorted((r.rule_id, r.symbol, r.ts.minute) for r in spark.read.schema(live.FIRING).parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "a", 0), (1, "a", 1), (2, "b", 0), (3, "a", 1), (4, "c", 0)]


def _ticks(n: int, seed: int, symbols: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    return [(f"S{rng.randrange(symbols)}", T0 + dt.timedelta(minutes=rng.randrange(60 * 24)), seed * 10**6 + k, round(rng.uniform(1, 9), 3)) for k in range(n)]


def _plain(ticks: list[tuple]) -> dict:
    held: dict[tuple, list] = {}
    for symbol, ts, seq, price in ticks:
        held.setdefault((symbol, ts.replace(minute=0)), []).append((ts, seq, price))
    return {k: (min(v)[2], max(x[2] for x in v), min(x[2] for x in v), max(v)[2], float(len(v))) for k, v in held.items()}


def _rows(frame) -> dict:
    return {(r.symbol, r.date): (r.open, r.high, r.low, r.close, r.volume) for r in frame.collect()}


def _size(folder) -> int:
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_late_ticks_revise_their_bar(spark, tmp_path):
    table = BarTable(spark, str(tmp_path), buckets=4)
    on_time = [("a", T0 + dt.timedelta(minutes=m), m, float(m)) for m in (10, 20, 30)] + [("a", T0 + dt.timedelta(days=9), 99, 1.0), (None, T0, 1, 1.0), ("a", None, 1, 1.0), ("a", T0, 1, None)]
    assert table.last_batch() == -1 and table.read().count() == 0
    assert table.add(spark.createDataFrame(on_time, TICK), 0)
    late = [("a", T0 + dt.timedelta(minutes=5), 5, 50.0), ("a", T0 + dt.timedelta(minutes=40), 40, 2.0)]
    assert table.add(spark.createDataFrame(late, TICK), 1)
    assert _rows(table.read())["a", T0] == (50.0, 50.0, 2.0, 2.0, 5.0)
    assert _rows(table.read(version=0))["a", T0] == (10.0, 30.0, 10.0, 30.0, 3.0)
    assert not table.add(spark.createDataFrame(on_time, TICK), 1) and not table.add(spark.createDataFrame(on_time, TICK), 0)
    assert _rows(table.read())["a", T0][-1] == 5.0


def test_a_batch_writes_its_own_bars(spark, tmp_path):
    """What a batch writes follows the batch, levels merge, and what is replaced goes."""
    table, ticks = BarTable(spark, str(tmp_path), buckets=4, fan=3), []
    own = _ticks(4000, 0)
    table.add(spark.createDataFrame(own, TICK), 0)
    ticks += own
    first = _size(tmp_path / "pieces")
    few = _ticks(5, 1)
    table.add(spark.createDataFrame(few, TICK), 1)
    ticks += few
    assert _size(tmp_path / "pieces") - first < first / 4
    for batch in range(2, 10):
        more = _ticks(50, batch)
        ticks += more
        table.add(spark.createDataFrame(more, TICK), batch)
        assert _rows(table.read()) == _plain(ticks)
    listed = table.listed()
    assert len(listed) < 5 and max(level for _, level, _ in listed) == 2 and table.last_batch() == 9
    assert len(table.versions()) == table.keep
    live_now = {f for v in table.versions() for f, _, _ in table.listed(v)}
    assert {p.name for p in (tmp_path / "pieces").iterdir() if p.is_dir()} == live_now
    symbol = ticks[0][0]
    assert _rows(table.read(symbol)) == {k: v for k, v in _plain(ticks).items() if k[0] == symbol}


@pytest.mark.parametrize("compacting", [False, True])
def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch, compacting):
    table = BarTable(spark, str(tmp_path), buckets=2, fan=2)
    one, two = _ticks(30, 1), _ticks(30, 2)
    table.add(spark.createDataFrame(one, TICK), 0)
    commit, calls = BarTable._commit, []

    def fails(self, rows):
        calls.append(rows)
        if len(calls) > compacting:
            raise OSError("lost")
        commit(self, rows)

    monkeypatch.setattr(BarTable, "_commit", fails)
    with pytest.raises(OSError, match="lost"):
        table.add(spark.createDataFrame(two, TICK), 1)
    monkeypatch.setattr(BarTable, "_commit", commit)
    again = BarTable(spark, str(tmp_path), buckets=2, fan=2)
    assert _rows(again.read()) == _plain(one + two if compacting else one)
    assert again.add(spark.createDataFrame(two, TICK), 1) is not compacting
    again.compact()
    assert _rows(again.read()) == _plain(one + two) and [level for _, level, _ in again.listed()] == [1]


def test_stream_into_the_table(spark, tmp_path):
    """Two runs of the query over one checkpoint, the second with ticks of long ago."""
    table = BarTable(spark, str(tmp_path / "bars"))
    ticks = _ticks(200, 3)
    for part in (ticks[:120], ticks[120:]):
        spark.createDataFrame(part, TICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stored(spark.readStream.schema(TICK).parquet(str(tmp_path / "in")), table, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert _rows(table.read()) == _plain(ticks) and table.last_batch() == 1


def test_ticks_later_than_the_watermark_are_dropped(spark, tmp_path):
    """The bars of a watermarked stream take what is late, but not what is too late."""
    parts = [[("a", T0, 1, 5.0), ("a", T0 + dt.timedelta(hours=4), 2, 6.0)], [("a", T0 + dt.timedelta(minutes=1), 3, 99.0), ("a", T0 + dt.timedelta(hours=3), 4, 7.0)], [("a", T0 + dt.timedelta(hours=30), 5, 8.0)]]
    got = {}
    for part in parts:
        spark.createDataFrame(part, TICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        bars = live.tick_bars(spark.readStream.schema(TICK).parquet(str(tmp_path / "in")), lateness="2 hours")
        bars.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    for r in spark.read.parquet(str(tmp_path / "out")).select("date", F.col("high")).collect():
        got[r.date.hour] = r.high
    assert got == {0: 5.0, 3: 7.0, 4: 6.0}
