"""The book and the journal: positions out of trades, recommendations and how they ended."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.panel import in_order

POSITION = "symbol string, shares double, cost_price double, realized_pnl double, status string, n_trades long, rejected long"


def ledger(trades: DataFrame) -> DataFrame:
    """Positions after all trades (symbol, at, action buy/add/trim/sell, shares, price): average cost, realised gains.

    Buys move the cost to the weighted mean; sales realise the difference, close
    the position at nothing left, and are rejected where they exceed it.  A
    symbol's trades are sorted by Spark and stream by in batches, so a task
    holds one position, not its trades.
    """
    names = [x.split()[0] for x in POSITION.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        have = cost = gained = 0.0
        n = rejected = 0
        for batch in batches:
            done = []
            for symbol, bought, quantity, price in zip(*(batch[c].to_pylist() for c in ("symbol", "bought", "shares", "price")), strict=True):
                if now != (symbol,):
                    if now:
                        done.append((*now, have, cost, gained, "open" if have else "closed", n, rejected))
                    now, have, cost, gained, n, rejected = (symbol,), 0.0, 0.0, 0.0, 0, 0
                n += 1
                if bought:
                    cost = (cost * have + price * quantity) / (have + quantity)
                    have += quantity
                elif quantity > have + 1e-9:
                    rejected += 1
                else:
                    gained += (price - cost) * quantity
                    have -= quantity
                    if have <= 1e-9:
                        have = cost = 0.0
            if done:
                yield _positions(done, names)
        if now:
            yield _positions([(*now, have, cost, gained, "open" if have else "closed", n, rejected)], names)

    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    rows = trades.select("symbol", "at", F.coalesce(F.col("action").isin("buy", "add"), F.lit(False)).alias("bought"), number("shares"), number("price"))
    ordered = rows.repartition("symbol").sortWithinPartitions("symbol", F.col("at").asc_nulls_last())
    return ordered.select("symbol", "bought", "shares", "price").mapInArrow(run, POSITION)


def _positions(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def book(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Open positions at their quotes (at cost where there is none): value, gain, weight."""
    out = positions.filter("status = 'open'").join(quotes.select("symbol", "close", "prev_close"), "symbol", "left")
    price = F.coalesce("close", "cost_price")
    out = out.withColumns({"value": F.col("shares") * price, "pnl": F.col("shares") * (price - F.col("cost_price")), "today": F.coalesce(F.col("shares") * (F.col("close") - F.col("prev_close")), F.lit(0.0))})
    return out.withColumn("weight", F.try_divide(F.col("value"), F.sum("value").over(Window.partitionBy()))).select("symbol", "shares", "cost_price", "value", "pnl", "today", "weight")  # a book is small


def book_summary(positions: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row: totals, the heaviest position, gains already realised."""
    held = book(positions, quotes)
    totals = held.agg(F.count(F.lit(1)).alias("n_open"), F.sum("value").alias("value"), F.sum("pnl").alias("pnl"), F.sum("today").alias("today"), F.max_by("symbol", F.struct("weight", "symbol")).alias("heaviest"), F.max("weight").alias("max_weight"))
    return totals.crossJoin(positions.agg(F.sum("realized_pnl").alias("realized_pnl"), F.sum("rejected").alias("rejected")))  # one row each


def record(journal: DataFrame, recos: DataFrame) -> DataFrame:
    """The journal with the new recommendations: prices above 0, one for each (reco_date, symbol, strategy), the first to come."""
    key = ["reco_date", "symbol", "strategy"]
    first = Window.partitionBy(*key).orderBy("entry_price")
    new = recos.filter("entry_price > 0").withColumn("__k", F.row_number().over(first)).filter("__k = 1").drop("__k")
    return journal.unionByName(new.join(journal.select(*key), key, "left_anti"))


def settle(recos: DataFrame, bars: DataFrame, index_bars: DataFrame) -> DataFrame:
    """Recommendations (reco_date, symbol, strategy, entry_price, horizon) with their exit: the close of the ``horizon``-th bar after the date.

    status is open where there are not enough bars; excess is over the index
    between the same bars' dates.  Bars are numbered once.  The last bar up to a
    date is found by a window over bars and recommendations together, the exit by
    an equality join on symbol and number; repeated recommendations stay apart.
    """
    numbered = bars.select("symbol", "date", "close", F.row_number().over(in_order()).alias("n"))
    key = ["reco_date", "symbol", "strategy", "entry_price", "horizon"]
    asked = recos.select("symbol", F.col("reco_date").alias("date"), F.lit(None).cast("int").alias("n"), F.struct(*key).alias("__reco"))
    both = numbered.select("symbol", "date", "n").withColumn("__reco", F.lit(None).cast(asked.schema["__reco"].dataType)).unionByName(asked)
    upto = Window.partitionBy("symbol").orderBy("date", F.col("__reco").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("__at", F.coalesce(F.last("n", ignorenulls=True).over(upto), F.lit(0))).filter("__reco is not null").select("__reco.*", "__at")
    placed = placed.withColumn("n", F.col("__at") + F.col("horizon")).drop("__at")
    out = placed.join(numbered.select("symbol", "n", F.col("date").alias("exit_date"), F.col("close").alias("exit_price")), ["symbol", "n"], "left")
    dates = out.select(F.explode(F.array("reco_date", "exit_date")).alias("__d")).filter("__d is not null").distinct()
    index = index_bars.select(F.col("date").alias("__d"), F.col("close").alias("__c"), F.lit(0).alias("__ask")).unionByName(dates.withColumns({"__c": F.lit(None).cast("double"), "__ask": F.lit(1)}))
    known = index.withColumn("__c", F.last("__c", ignorenulls=True).over(Window.orderBy("__d", "__ask"))).filter("__ask = 1")  # the dates of a calendar
    for name, date in (("bench_entry", "reco_date"), ("bench_exit", "exit_date")):
        out = out.join(known.select(F.col("__d").alias(date), F.col("__c").alias(name)), date, "left")
    gain = F.try_divide("exit_price", "entry_price") - 1
    return out.select(*key, "exit_date", "exit_price", F.when(F.col("exit_price").isNull(), "open").otherwise("closed").alias("status"), gain.alias("return"), (gain - (F.try_divide("bench_exit", "bench_entry") - 1)).alias("excess"))


def scoreboard(settled: DataFrame) -> DataFrame:
    """A row a strategy: how its closed recommendations did, and how many it would take to be significant."""
    done = F.col("status") == "closed"
    r_, e = F.when(done, F.col("return")), F.when(done, F.col("excess"))
    out = settled.groupBy("strategy").agg(
        F.count(F.when(done, 1)).alias("n_closed"),
        F.count(F.when(~done, 1)).alias("n_open"),
        F.avg(r_).alias("mean_return"),
        F.percentile(r_, F.lit(0.5)).alias("median_return"),
        F.avg((r_ > 0).cast("double")).alias("win_rate"),
        F.avg(e).alias("mean_excess"),
        F.percentile(e, F.lit(0.5)).alias("median_excess"),
        F.avg((e > 0).cast("double")).alias("beat_rate"),
        F.stddev_samp(e).alias("__sd"),
    )
    t = F.try_divide(F.col("mean_excess"), F.try_divide(F.col("__sd"), F.sqrt(F.col("n_closed").cast("double"))))
    needed = F.ceil(F.pow(F.try_divide(2 * F.col("__sd"), F.col("mean_excess")), 2))
    return out.withColumns({"t_stat": t, "n_needed": needed}).drop("__sd")


def recent_closed(settled: DataFrame, limit: int = 20, strategy: str | None = None) -> DataFrame:
    """The recommendations that closed last, of one strategy if it is named; the newest exit first, then the later recommendation and the symbol."""
    rows = settled.filter("status = 'closed'")
    rows = rows if strategy is None else rows.filter(F.col("strategy") == strategy)
    return rows.orderBy(F.col("exit_date").desc(), F.col("reco_date").desc(), "symbol").limit(limit)


def recommendations(changes: DataFrame, strategy: str, index_bars: DataFrame | None = None, horizon: int = 5) -> DataFrame:
    """What enters today, for the journal: reco_date, symbol, strategy, entry_price, horizon, bench_price.

    changes: symbol, date, close, change; the date is that of the symbol's last
    bar, not of the calendar.  bench_price is the index's last close, null
    without one.
    """
    rows = changes.filter("change = 'enter'").select(F.col("date").alias("reco_date"), "symbol", F.lit(strategy).alias("strategy"), F.col("close").alias("entry_price"), F.lit(horizon).alias("horizon"))
    if index_bars is None:
        return rows.withColumn("bench_price", F.lit(None).cast("double"))
    last = index_bars.agg(F.max_by("close", "date").alias("bench_price"))  # one row
    return rows.crossJoin(F.broadcast(last))
