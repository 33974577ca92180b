"""Back-tests of one symbol at a time, and what their equity and trades amount to."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.costs import Fees, from_bps
from barloom.functions.panel import clip, div, in_order, lag, lead, so_far
from barloom.functions.recurrence import per_symbol
from barloom.operators.signals import BUY, HOLD, SELL, held

YEAR = 252
LIMIT = 0.099  # a move of this share of the close before is a limit day
FLAT = 1e-12  # a smaller step of the equity is rounding, no gain or loss
BPS = (2.5, 5.0)  # commission and slippage where no cost model is given


def positions(frame: DataFrame, delay: int = 0) -> DataFrame:
    """``pos`` of a frame with ``signal`` (or ``score``, ``position``), without buys on limit-up and sells on limit-down days, ``delay`` bars late."""
    before = F.coalesce(lag("close"), F.col("close"))
    up, down = F.col("close") >= before * (1 + LIMIT), F.col("close") <= before * (1 - LIMIT)
    if "signal" in frame.columns:
        out = frame.withColumn("__sig", F.when((F.col("signal") == BUY) & up | (F.col("signal") == SELL) & down, HOLD).otherwise(F.coalesce("signal", F.lit(HOLD))))
        out = out.withColumn("pos", held(F.col("__sig")))
    else:
        want = clip(F.coalesce(F.col("score" if "score" in frame.columns else "position"), F.lit(0.0)), 0.0, 1.0)
        out = frame.withColumns({"__want": want, "__up": up, "__down": down}).withColumn("__was", F.coalesce(lag("__want"), F.lit(0.0)))
        vetoed = F.col("__up") & (F.col("__want") > F.col("__was")) | F.col("__down") & (F.col("__want") < F.col("__was"))
        out = out.withColumn("pos", F.when(vetoed, F.col("__was")).otherwise(F.col("__want")))
    if delay:
        out = out.withColumn("__pos", F.col("pos")).withColumn("pos", F.coalesce(lag("__pos", delay), F.lit(0.0)))
    return out.select(*frame.columns, "pos")


def vectorised(frame: DataFrame, costs: Fees | None = None, cash: float = 1_000_000.0, delay: int = 0) -> DataFrame:
    """symbol, date, close, pos, equity of a frame with a signal."""
    costs = costs or from_bps(*BPS)
    out = positions(frame, delay).select("symbol", "date", "close", "pos")
    out = out.withColumns({"__was": F.coalesce(lag("pos"), F.lit(0.0)), "__r": F.coalesce(div(F.col("close"), lag("close")) - 1, F.lit(0.0))})
    if costs.least > 0:

        def fold(rows: pd.DataFrame) -> pd.DataFrame:
            equity, now = [], cash
            for pos, was, r in zip(rows["pos"], rows["__was"], rows["__r"], strict=True):
                value = now * abs(pos - was)
                paid = costs.paid(value, pos < was) + value * costs.slip
                now = max(now * (1 + was * r) - paid, 0.0)
                equity.append(now)
            return rows.assign(equity=equity)

        return per_symbol(out, fold, {"equity": "double"}).drop("__was", "__r")
    more, less = F.greatest(F.col("pos") - F.col("__was"), F.lit(0.0)), F.greatest(F.col("__was") - F.col("pos"), F.lit(0.0))
    paid = (more + less) * (costs.share + costs.slip) + less * costs.sell_duty + more * costs.buy_duty
    out = out.withColumn("__g", 1 + F.col("__was") * F.col("__r") - paid)
    return out.withColumn("equity", cash * F.product("__g").over(so_far())).drop("__was", "__r", "__g")


def trades_of(run: DataFrame, commission: float = BPS[0] / 1e4, slippage: float = BPS[1] / 1e4) -> DataFrame:
    """Closed trades of symbol, date, close, pos: from 0 to more, until 0 again."""
    was = F.coalesce(lag("pos"), F.lit(0.0))
    out = run.withColumns({"__n": F.row_number().over(in_order()), "__start": ((F.col("pos") > 0) & (was <= 0)).cast("int"), "__end": ((F.col("pos") <= 0) & (was > 0)).cast("int")})
    out = out.withColumn("trade", F.sum("__start").over(so_far())).filter("__start = 1 or __end = 1")
    pairs = out.groupBy("symbol", "trade").agg(
        F.min(F.when(F.col("__start") == 1, F.col("date"))).alias("entry_date"),
        F.min(F.when(F.col("__end") == 1, F.col("date"))).alias("exit_date"),
        F.min(F.when(F.col("__start") == 1, F.col("close"))).alias("__in"),
        F.min(F.when(F.col("__end") == 1, F.col("close"))).alias("__out"),
        (F.min(F.when(F.col("__end") == 1, F.col("__n"))) - F.min(F.when(F.col("__start") == 1, F.col("__n")))).alias("hold_bars"),
    )
    closed = pairs.filter("exit_date is not null").withColumns({"entry_price": F.col("__in") * (1 + slippage), "exit_price": F.col("__out") * (1 - slippage)})
    return closed.withColumn("pnl_pct", (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price") - 2 * commission).select("symbol", "entry_date", "exit_date", "entry_price", "exit_price", "hold_bars", "pnl_pct")


def annualised(total: Column, bars: Column) -> Column:
    """A year's return; -1 after a total loss, the total itself for less than a month."""
    return F.when(total <= -1, -1.0).when(bars < YEAR / 12, total).otherwise(F.pow(1 + F.greatest(total, F.lit(-1.0)), YEAR / bars) - 1)


def drawdowns(equity: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by, max_drawdown, max_dd_days): the deepest fall under the peak so far and the longest run of bars under it."""
    order = Window.partitionBy(*by).orderBy("date")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    out = equity.withColumn("__peak", F.max("equity").over(so_far))
    out = out.withColumns({"__dd": div(F.col("equity"), F.col("__peak")) - 1, "__under": (F.col("equity") < F.col("__peak")).cast("int")})
    out = out.withColumn("__island", F.sum(1 - F.col("__under")).over(so_far))
    out = out.withColumn("__run", F.sum("__under").over(Window.partitionBy(*by, "__island")))
    return out.groupBy(*by).agg(F.coalesce(F.min("__dd"), F.lit(0.0)).alias("max_drawdown"), F.coalesce(F.max("__run"), F.lit(0)).alias("max_dd_days"))


def metrics(equity: DataFrame, trades: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Fourteen figures of each run: equity (by, date, equity) and closed trades (by, pnl_pct)."""
    equity = equity.select(*by, "date", "equity").filter("equity is not null")
    order = Window.partitionBy(*by).orderBy("date")
    step = div(F.col("equity"), F.lag("equity").over(order)) - 1
    steps = equity.withColumn("__r", F.when(F.abs(step) < FLAT, 0.0).otherwise(step))
    out = steps.groupBy(*by).agg(
        F.min_by("equity", "date").alias("__first"),
        F.max_by("equity", "date").alias("__last"),
        F.count(F.lit(1)).alias("num_bars"),
        F.avg("__r").alias("__mean"),
        F.stddev_samp("__r").alias("__sd"),
        F.stddev_samp(F.when(F.col("__r") < 0, F.col("__r"))).alias("__dsd"),
    )
    won, lost = F.when(F.col("pnl_pct") > 0, F.col("pnl_pct")), F.when(F.col("pnl_pct") <= 0, F.col("pnl_pct"))
    closed = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_trades"),
        F.avg(F.when(F.col("pnl_pct") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg(won).alias("avg_win"),
        F.avg(lost).alias("avg_loss"),
        F.sum(won).alias("__won"),
        F.sum(lost).alias("__lost"),
    )
    out = out.join(drawdowns(equity, by), list(by)).join(closed, list(by), "left")
    root = math.sqrt(YEAR)
    total = F.col("__last") / F.col("__first") - 1
    ratio = lambda sd: F.coalesce(F.when(F.col(sd) > 0, div(F.col("__mean"), F.col(sd)) * root), F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = out.withColumn("total_return", total).withColumn("annual_return", annualised(F.col("total_return"), F.col("num_bars")))
    factor = F.when(-F.col("__lost") > 0, div(zero("__won"), -F.col("__lost"))).when(F.col("__won").isNotNull(), float("inf")).otherwise(0.0)
    return out.select(
        *by,
        "total_return",
        "annual_return",
        ratio("__sd").alias("sharpe"),
        ratio("__dsd").alias("sortino"),
        F.when(F.col("max_drawdown") < 0, div(F.col("annual_return"), -F.col("max_drawdown"))).otherwise(0.0).alias("calmar"),
        "max_drawdown",
        "max_dd_days",
        (zero("__sd") * root).alias("volatility"),
        zero("win_rate").alias("win_rate"),
        factor.alias("profit_factor"),
        zero("avg_win").alias("avg_win"),
        zero("avg_loss").alias("avg_loss"),
        F.coalesce("num_trades", F.lit(0)).alias("num_trades"),
        "num_bars",
    )


def event_driven(frame: DataFrame, costs: Fees | None = None, cash: float = 1_000_000.0, delay: int = 0) -> DataFrame:
    """symbol, date, close, equity, shares and the trade a bar closed (closed_pnl, closed_pct, held_bars; else null).

    Orders are filled at the bar's close with slippage, in whole lots and within
    cash; limit days stop them.  A signal buys all it can and sells all it has;
    a score or position is a share of the equity to hold, and only selling the
    last share closes a trade.
    """
    costs = costs or from_bps(*BPS)
    signals = "signal" in frame.columns
    wanted = "signal" if signals else ("score" if "score" in frame.columns else "position")
    lot = costs.lot
    slip, fee = costs.slip, costs.share
    added = {"equity": "double", "shares": "double", "closed_pnl": "double", "closed_pct": "double", "held_bars": "long"}

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        money, shares, paid, since = cash, 0.0, 0.0, 0
        out: list[tuple] = []
        closes, wants = rows["close"].to_numpy(float), rows[wanted].to_list()
        for i, close in enumerate(closes):
            before = closes[i - 1] if i else close
            up, down = close >= before * (1 + LIMIT), close <= before * (1 - LIMIT)
            want = wants[i - delay] if i >= delay else None
            closed = (None, None, None)
            buy = sell = 0.0
            if signals:
                if want == BUY and not shares and not up:
                    price = close * (1 + slip)
                    buy = costs.affordable(costs.lots(money / (price * (1 + fee))), price, money)
                    buy = buy if buy >= lot else 0.0
                elif want == SELL and shares and not down:
                    sell = shares
            elif want is not None:
                share = 0.0 if pd.isna(want) else min(1.0, max(0.0, float(want)))
                price = close * (1 + slip)
                change = costs.lots((money + shares * close) * share / (price * (1 + fee))) - shares
                if change > 0 and not up and change * price + costs.paid(change * price) <= money:
                    buy = change
                elif change < 0 and not down:
                    sell = min(-change, shares)
            if buy:
                price = close * (1 + slip)
                if not shares:
                    paid, since = price, i
                else:
                    paid = (paid * shares + price * buy) / (shares + buy)
                money -= buy * price + costs.paid(buy * price)
                shares += buy
            if sell:
                gross = sell * close * (1 - slip)
                got = gross - costs.paid(gross, True)
                money, shares = money + got, shares - sell
                if not shares:
                    basis = sell * paid
                    cost = basis + costs.paid(basis)
                    closed = (got - cost, (got - cost) / (cost if signals else basis), i - since)
            out.append((money + shares * close, shares, *closed))
        made = pd.DataFrame(out, columns=list(added))
        made["held_bars"] = made["held_bars"].astype("Int64")
        return pd.concat([rows, made], axis=1)

    return per_symbol(frame.select("symbol", "date", "close", wanted), fold, added).drop(wanted)


def closed_trades(run: DataFrame) -> DataFrame:
    return run.filter("closed_pct is not null").select("symbol", F.col("date").alias("exit_date"), F.col("closed_pnl").alias("pnl"), F.col("closed_pct").alias("pnl_pct"), "held_bars")


# --- the next day --------------------------------------------------------------------------------


def next_day_baseline(bars: DataFrame) -> DataFrame:
    """One row a symbol: how far the next bar's high, low, open and close are from a buy at the close."""
    c = F.col("close")
    out = bars.select("symbol", *((div(lead(k), c) - 1).alias(n) for k, n in (("high", "mfe"), ("low", "mae"), ("close", "ret"), ("open", "gap")))).dropna(subset=["mfe", "mae", "ret"])
    mid = lambda x, q=0.5: F.percentile(x, F.lit(q))
    return out.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("mfe").alias("mfe_mean"),
        mid("mfe").alias("mfe_median"),
        mid("mfe", 0.25).alias("mfe_p25"),
        mid("mfe", 0.75).alias("mfe_p75"),
        F.avg("mae").alias("mae_mean"),
        mid("mae").alias("mae_median"),
        F.avg("ret").alias("close_ret_mean"),
        mid("ret").alias("close_ret_median"),
        F.avg("gap").alias("overnight_mean"),
        F.avg((F.col("ret") > 0).cast("double")).alias("pct_up_close"),
        F.try_divide(mid("mfe"), F.abs(mid("mae"))).alias("mfe_over_mae"),
    )


def next_day_dataset(bars: DataFrame) -> DataFrame:
    """Twenty-one features known at the close and three labels of the next bar."""
    from barloom.functions.panel import over_full
    from barloom.operators import technical as tech

    c, h, low, o, v = (F.col(x) for x in ("close", "high", "low", "open", "volume"))
    out = tech.zscore(tech.rsi(tech.atr(bars, 14), 14, "rsi14"), 20).withColumnRenamed("natr", "natr14").withColumnRenamed("zscore", "z20").drop("atr")
    out = tech.atr(out, 5).withColumnRenamed("atr", "__a5").drop("natr")
    out = tech.atr(out, 20).withColumnRenamed("atr", "__a20").drop("natr")
    out = out.withColumn("range_pct", div(h - low, c))
    out = out.withColumns({"range_ma5": over_full(5, F.avg("range_pct"), "range_pct"), "range_ma20": over_full(20, F.avg("range_pct"), "range_pct")})
    spread = h - low
    average = over_full(20, F.avg("volume"), "volume")
    made = {
        "natr14": F.col("natr14"),
        "atr_ratio": div(F.col("__a5"), F.col("__a20")),
        "range_pct": F.col("range_pct"),
        "range_ma5": F.col("range_ma5"),
        "range_ma20": F.col("range_ma20"),
        "range_expand": div(F.col("range_ma5"), F.col("range_ma20")),
        "close_pos": div(c - low, spread),
        "upper_shadow": div(h - F.greatest(c, o), spread),
        "lower_shadow": div(F.least(c, o) - low, spread),
        "body": div(c - o, c),
        **{f"ret{p}": div(c, lag("close", p)) - 1 for p in (1, 3, 5, 10)},
        "rsi14": F.col("rsi14"),
        "z20": F.col("z20"),
        "dist_ma20": div(c, over_full(20, F.avg("close"), "close")) - 1,
        "vol_ratio": div(v, average),
        "vol_ratio5": div(over_full(5, F.avg("volume"), "volume"), average),
        "overnight": div(o, lag("close")) - 1,
        "intraday": div(c, o) - 1,
        "y_mfe": div(lead("high"), c) - 1,
        "y_mae": div(lead("low"), c) - 1,
        "y_close": div(lead("close"), c) - 1,
    }
    return out.select("symbol", "date", *(x.alias(n) for n, x in made.items()))


def limit_orders(bars: DataFrame, target: Column, costs: Fees, entry: Column | None = None, stop: float | None = None, band: float = 0.1) -> DataFrame:
    """A buy at each close where ``entry`` holds (not after a limit-up day) and a limit sell at ``target`` more on the next bar.

    A higher open fills at the open, a high that reaches the limit at the limit,
    else the close ends it.  A stop that is touched counts first and fills at
    the stop or a lower open.
    """
    out = bars.withColumns({"o1": lead("open"), "h1": lead("high"), "l1": lead("low"), "c1": lead("close"), "__target": target, "__entry": F.lit(True) if entry is None else F.coalesce(entry, F.lit(False)), "__up": F.coalesce(div(F.col("close"), lag("close")) - 1 >= band * 0.99, F.lit(False))})
    out = out.filter("__entry and not __up and c1 is not null and o1 is not null and h1 is not null and __target is not null")
    limit = F.col("close") * (1 + F.col("__target"))
    reason = F.when(F.col("o1") >= limit, "gap_open").when(F.col("h1") >= limit, "limit").otherwise("close")
    price = F.when(F.col("o1") >= limit, F.col("o1")).when(F.col("h1") >= limit, limit).otherwise(F.col("c1"))
    if stop:
        floor = F.col("close") * (1 - stop)
        touched = F.col("l1") <= floor
        reason, price = F.when(touched, "stop").otherwise(reason), F.when(touched, F.least(floor, F.col("o1"))).otherwise(price)
    fee = costs.both_ways(10_000.0)
    out = out.withColumns({"limit_price": limit, "exit_price": price, "reason": reason})
    out = out.withColumn("gross", div(F.col("exit_price"), F.col("close")) - 1).withColumn("net", F.col("gross") - fee)
    return out.select("symbol", "date", F.col("close").alias("entry_price"), "limit_price", "exit_price", "gross", "net", "reason", F.col("reason").isin("gap_open", "limit").alias("filled"), (div(F.col("h1"), F.col("close")) - 1).alias("mfe"))


def limit_stats(orders: DataFrame, *by: str) -> DataFrame:
    """What the orders of each group came to."""
    caught = F.greatest(F.col("gross"), F.lit(0.0)) / F.greatest(F.col("mfe"), F.lit(1e-9))
    return orders.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.avg(F.col("filled").cast("double")).alias("fill_rate"),
        F.avg("gross").alias("mean_gross"),
        F.avg("net").alias("mean_net"),
        F.percentile("net", F.lit(0.5)).alias("median_net"),
        F.avg((F.col("net") > 0).cast("double")).alias("win_rate"),
        F.avg(caught).alias("capture_rate"),
    )


def scan_targets(bars: DataFrame, targets: list[float], costs: Fees, **options) -> DataFrame:
    """:func:`limit_stats` of each (symbol, target): one pass over the bars times the targets."""
    many = bars.withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    keyed = many.withColumn("__s", F.col("symbol")).withColumn("symbol", F.concat_ws("\t", "symbol", F.col("target").cast("string")))
    orders = limit_orders(keyed, F.col("target"), costs, **options)
    named = orders.withColumns({"target": F.substring_index("symbol", "\t", -1).cast("double"), "symbol": F.substring_index("symbol", "\t", 1)})
    return limit_stats(named, "symbol", "target")


def equal_weight_hold(bars: DataFrame) -> DataFrame:
    """The mean over symbols of last close over first, less 1."""
    own = bars.groupBy("symbol").agg((F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")) - 1).alias("r"))
    return own.agg(F.avg("r").alias("equal_weight_return"), F.count(F.lit(1)).alias("n_symbols"))
