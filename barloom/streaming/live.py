"""Bars and rules on streams.

Ticks become bars by event time under a watermark.  Rules are tried on every
quote of a stream by joins with tables; what fires is then silent for its
cooldown, which is state kept by rule and symbol.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.screen import fired

FIRING = "rule_id int, symbol string, ts timestamp, type string"
#: Groups of rules and symbols that share a state; another number cannot take up an older checkpoint.
BUCKETS = 2048


def tick_bars(ticks: DataFrame, unit: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """symbol, date and prices of ticks (symbol, ts, seq, price); a tick later than ``lateness`` is dropped."""
    order = F.struct("ts", "seq")
    bars = ticks.withWatermark("ts", lateness).groupBy(F.window("ts", unit), "symbol")
    made = bars.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return made.select("symbol", F.col("window.start").alias("date"), "open", "high", "low", "close", "volume")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here keep their state in RocksDB, which timers and values by key need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def quote_facts(quotes: DataFrame, known: DataFrame) -> DataFrame:
    """What rules look at, of a stream of quotes (symbol, ts, price): with the table ``known`` (symbol, prev_close, and limits or levels where there are any)."""
    rows = quotes.join(known, "symbol", "left").withColumns({c: F.col("price") for c in ("close", "high", "low")})
    rows = rows.withColumn("change_pct", 100 * (F.try_divide("close", "prev_close") - 1)).withColumn("date", F.to_date("ts"))
    for name, kind in (("volume_ratio", "double"), ("limit_up", "boolean"), ("limit_down", "boolean"), ("rsi", "double"), ("prev_rsi", "double")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def cooldown(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of a rule's firings on a symbol those that come its cooldown after the last one that passed, for the rules and symbols of a bucket.

    The state has, by rule and symbol, the time of that one and the end of its
    cooldown.  An entry goes once the watermark is past the end, when no firing
    can come that it would still silence, so what is kept is bounded by what
    fired lately.
    """
    watermark = state.getCurrentWatermarkMs()
    silent = {(rule, symbol): (last, until) for rule, symbol, last, until in json.loads(state.get[0])} if state.exists else {}
    silent = {k: v for k, v in silent.items() if v[1] >= watermark}
    kept = []
    if not state.hasTimedOut:
        columns = ("rule_id", "symbol", "micros", "type", "minutes")
        rows = [row for f in frames for row in zip(*(f[c].tolist() for c in columns), strict=True)]
        for name, own in groupby(sorted(rows, key=lambda row: (row[0], row[1] or "", row[2], row[3])), key=lambda row: row[:2]):
            last, until = silent.get(name, (None, 0))
            before, longest = last, 0
            for _, _, micros, kind, minutes in own:
                longest = max(longest, minutes)
                if last is None or minutes <= 0 or micros - last >= minutes * 60_000_000:
                    kept.append((*name, micros, kind))
                    last = micros
            if last != before:
                until = last // 1000 + longest * 60_000
            silent[name] = (last, until)
    if silent:
        state.update((json.dumps([(*k, *v) for k, v in silent.items()]),))
        state.setTimeoutTimestamp(max(min(until for _, until in silent.values()), watermark) + 1)
    elif state.exists:
        state.remove()
    if kept:
        rules, symbols, times, kinds = zip(*kept, strict=True)
        yield pd.DataFrame({"rule_id": rules, "symbol": symbols, "ts": pd.to_datetime(times, unit="us", utc=True), "type": kinds})


def cooled(firings: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """A stream of firings (rule_id, symbol, ts, type, cooldown_minutes) but those within a rule's cooldown of the last one that passed.

    Firings of one batch are taken in order of time.  A firing later than
    ``lateness`` behind the newest time seen in earlier batches is dropped; one
    that is late but not as late is silent if it lies before the last that
    passed.  Rules and symbols are dealt into ``BUCKETS``, since a call for each
    of them costs far more than its rows.  Start the query in :func:`keyed_state`.
    """
    rows = firings.select(F.col("rule_id").cast("int").alias("rule_id"), "symbol", "ts", F.unix_micros("ts").alias("micros"), "type", F.coalesce("cooldown_minutes", F.lit(0)).cast("int").alias("minutes"))
    dealt = rows.withWatermark("ts", lateness).withColumn("bucket", F.pmod(F.xxhash64("rule_id", "symbol"), F.lit(BUCKETS))).groupBy("bucket")
    return dealt.applyInPandasWithState(cooldown, FIRING, "silent string", "append", GroupStateTimeout.EventTimeTimeout)


def watched(quotes: DataFrame, known: DataFrame, rules: DataFrame, positions: DataFrame | None = None, calendar: DataFrame | None = None, lateness: str = "0 seconds") -> DataFrame:
    """The firings of rules on a stream of quotes, with their cooldowns: rule_id, symbol, ts, type.

    The rules, positions and calendar are tables, read anew for every batch.
    """
    held = fired(quote_facts(quotes, known), rules, positions, calendar, keep=("ts", "cooldown_minutes"))
    return cooled(held, lateness)
