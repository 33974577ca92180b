"""Screening the last bar of each symbol, monitor rules on it, and the daily briefing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.panel import div, holds, in_order, lag, last_n, over_full, rows
from barloom.functions.recurrence import ewm, span
from barloom.functions.symbols import market_of
from barloom.operators import technical as tech
from barloom.operators.signals import Strategy, held
from barloom.sources.bars import last_bars

LEAST_BARS = 25
RECURSIVE = {"rsi_oversold", "rsi_overbought", "golden_cross", "death_cross", "macd_golden", "macd_death"}


def _recent(event: Column, within: int) -> Column:
    return F.max(event.cast("int")).over(last_n(within)) == 1


def conditions(bars: DataFrame, names: list[str], cross_within: int = 3) -> DataFrame:
    """``bars`` with a boolean column for each of ``names``; only what they need is computed."""
    out, wanted = bars, set(names)
    made: dict[str, Column] = {}
    if wanted & {"rsi_oversold", "rsi_overbought"}:
        out = tech.rsi(out, 14, "__rsi")
        made |= {"rsi_oversold": F.col("__rsi") < 30, "rsi_overbought": F.col("__rsi") > 70}
    for up, down, a, b in (("golden_cross", "death_cross", "__e5", "__e20"), ("macd_golden", "macd_death", "macd_dif", "macd_dea")):
        if wanted & {up, down}:
            out = ewm(out, {"__e5": ("close", span(5)), "__e20": ("close", span(20))}) if a == "__e5" else tech.macd(out)
            out = out.withColumn("__d", F.col(a) - F.col(b))
            out = out.withColumns({f"__{up}": holds((lag("__d") <= 0) & (F.col("__d") > 0)), f"__{down}": holds((lag("__d") >= 0) & (F.col("__d") < 0))}).drop("__d")
            made |= {up: _recent(F.col(f"__{up}"), cross_within), down: _recent(F.col(f"__{down}"), cross_within)}
    close = F.col("close")
    ma20, ma60 = over_full(20, F.avg("close"), "close"), over_full(60, F.avg("close"), "close")
    made |= {
        "above_ma": close > ma20,
        "below_ma": close < ma20,
        "volume_spike": div(F.col("volume"), over_full(20, F.avg("volume"), "volume", frame=rows(-20, -1))) >= 2,
        "near_high": close >= F.max("high").over(last_n(60)) * 0.97,
        "near_low": close <= F.min("low").over(last_n(60)) * 1.03,
        "breakout": close > over_full(20, F.max("close"), "close", frame=rows(-20, -1)),
        "pullback": (close > ma60) & (F.abs(div(close, ma20) - 1) <= 0.02),
    }
    if "squeeze" in wanted:
        out = tech.bollinger(out)
        made["squeeze"] = F.col("bb_width") <= over_full(60, F.percentile("bb_width", F.lit(0.2)), "bb_width", least=30)
    unknown = wanted - set(made)
    if unknown:
        raise ValueError(f"unknown conditions: {', '.join(sorted(unknown))}")
    return out.select(*bars.columns, *(holds(made[n]).alias(n) for n in names))


def screen(bars: DataFrame, names: list[str], mode: str = "all") -> DataFrame:
    """symbol, date, close, change_pct, score and matched of the last bars that meet all (any) of the conditions, best first.

    One shuffle by symbol for conditions that only look at windows.
    """
    if mode not in ("all", "any"):
        raise ValueError(f"unknown mode: {mode!r}")
    out = conditions(bars, names).withColumns({"__n": F.count(F.lit(1)).over(Window.partitionBy("symbol")), "__back": F.row_number().over(in_order().orderBy(F.col("date").desc())), "change_pct": 100 * (div(F.col("close"), lag("close")) - 1)})
    out = out.filter((F.col("__back") == 1) & (F.col("__n") >= LEAST_BARS))
    out = out.withColumn("matched", F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in names)))).withColumn("score", F.size("matched"))
    least = len(names) if mode == "all" else 1
    return out.filter(F.col("score") >= least).select("symbol", "date", "close", "change_pct", "score", F.array_join("matched", ",").alias("matched")).orderBy(F.col("score").desc(), F.col("change_pct").desc(), "symbol")


def limit_moves(bars: DataFrame, band: float = 0.1) -> DataFrame:
    """limit_up, limit_down: the close within 0.011 of the rounded limit (half to even), or the high or low beyond it."""
    before = lag("close")
    top, bottom = F.bround(before * (1 + band), 2), F.bround(before * (1 - band), 2)
    up = (F.abs(F.col("close") - top) <= 0.011) | (F.col("high") >= top)
    down = (F.abs(F.col("close") - bottom) <= 0.011) | (F.col("low") <= bottom)
    return bars.withColumns({"limit_up": holds(up), "limit_down": holds(down)})


RULES = "rule_id int, symbol string, type string, level double, direction string, cooldown_minutes int"


def monitor_facts(bars: DataFrame) -> DataFrame:
    """The latest bar of each symbol with everything the rules look at."""
    out = limit_moves(bars).withColumns(
        {"prev_close": lag("close"), "volume_ratio": div(F.col("volume"), over_full(20, F.avg("volume"), "volume", frame=rows(-20, -1)))}
    )
    tail = last_bars(bars, 24)  # the indicator starts on these bars only
    rsi = tech.rsi(tail, 14, "rsi").withColumn("prev_rsi", lag("rsi")).select("symbol", "date", "rsi", "prev_rsi")
    latest = last_bars(out, 1).withColumn("change_pct", 100 * (div(F.col("close"), F.col("prev_close")) - 1))
    return latest.join(rsi, ["symbol", "date"], "left")


def fired(facts: DataFrame, rules: DataFrame, positions: DataFrame | None = None, calendar: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """rule_id, symbol, date, type, and the columns to ``keep``: which rules hold.  A rule without a symbol is about all of them.

    A symbol's own rules come by an equality join, the general ones as one list
    that every row has; a row is made for each of both.  positions: symbol,
    stop_loss, take_profit; calendar: symbol, event_date.
    """
    rule = F.struct("rule_id", "type", "level", "direction", "cooldown_minutes")
    general = rules.filter("symbol is null").agg(F.collect_list(rule).alias("__general"))  # one row: what a user wrote
    own = rules.filter("symbol is not null").groupBy("symbol").agg(F.collect_list(rule).alias("__own"))
    both = facts.join(own, "symbol", "left").crossJoin(F.broadcast(general))
    rows_ = both.withColumn("__rule", F.explode(F.concat("__general", F.coalesce("__own", F.array().cast("array<struct<rule_id: int, type: string, level: double, direction: string, cooldown_minutes: int>>"))))).select(*facts.columns, "__rule.*")
    if positions is not None:
        rows_ = rows_.join(positions.select("symbol", "stop_loss", "take_profit"), "symbol", "left")
    else:
        rows_ = rows_.withColumns({"stop_loss": F.lit(None).cast("double"), "take_profit": F.lit(None).cast("double")})
    if calendar is not None:
        dated = calendar.groupBy("symbol").agg(F.collect_set("event_date").alias("__events"))
        rows_ = rows_.join(dated, "symbol", "left")
    else:
        rows_ = rows_.withColumn("__events", F.array().cast("array<date>"))
    kind, level, close = F.col("type"), F.col("level"), F.col("close")
    soon = F.exists("__events", lambda d: F.datediff(d, F.col("date")).between(0, 1))
    tests = {
        "price_cross": F.when(F.col("direction") == "down", close <= level).otherwise(close >= level),
        "price_pct": F.abs("change_pct") >= level,
        "volume_spike": F.col("volume_ratio") >= level,
        "limit_up": F.col("limit_up") & F.coalesce(market_of(F.col("symbol")) == "A", F.lit(True)),
        "limit_down": F.col("limit_down") & F.coalesce(market_of(F.col("symbol")) == "A", F.lit(True)),
        "stop_loss": F.col("low") <= F.col("stop_loss"),
        "take_profit": F.col("high") >= F.col("take_profit"),
        "indicator": F.when(F.col("direction") == "down", (F.col("prev_rsi") >= level) & (F.col("rsi") < level)).otherwise((F.col("prev_rsi") <= level) & (F.col("rsi") > level)),
        "event": soon,
    }
    test = F.lit(False)
    for name, condition in tests.items():
        test = F.when(kind == name, holds(condition)).otherwise(test)
    return rows_.filter(test).select("rule_id", "symbol", "date", "type", *keep)


def after_cooldown(firings: DataFrame, minutes: int = 60, by: tuple[str, ...] = ("rule_id",), time: str = "ts") -> DataFrame:
    """Of firings in order those at least ``minutes`` after the last one that was kept: a fold of each rule's times."""
    seconds = F.unix_micros(F.col(time).cast("timestamp")) if dict(firings.dtypes)[time] == "timestamp" else F.unix_micros(F.to_timestamp(F.col(time).cast("string")))
    keyed = firings.withColumn("__t", seconds)
    gathered = keyed.groupBy(*by).agg(F.array_sort(F.collect_set("__t")).alias("times"))
    gap = minutes * 60_000_000
    step = lambda acc, t: F.when((F.size(acc) == 0) | (t - F.get(acc, F.size(acc) - 1) >= gap), F.concat(acc, F.array(t))).otherwise(acc)
    kept = gathered.select(*by, F.explode(F.aggregate("times", F.array().cast("array<bigint>"), step)).alias("__t"))
    return keyed.join(kept, [*by, "__t"]).drop("__t")


def signal_changes(bars: DataFrame, strategy: Strategy, least: int = 30) -> DataFrame:
    """symbol, date, close, change: whether the last bar enters, exits, holds or stays flat."""
    made = strategy(bars)
    state = held(F.col("signal")) if "signal" in made.columns else (F.coalesce(F.col("score" if "score" in made.columns else "position"), F.lit(0.0)) > 0).cast("double")
    out = made.withColumn("__now", state).withColumns({"__was": F.coalesce(lag("__now"), F.lit(0.0)), "__n": F.count(F.lit(1)).over(Window.partitionBy("symbol")), "__back": F.row_number().over(in_order().orderBy(F.col("date").desc()))})
    out = out.filter((F.col("__back") == 1) & (F.col("__n") >= least))
    change = F.when((F.col("__now") > 0) & (F.col("__was") <= 0), "enter").when((F.col("__now") <= 0) & (F.col("__was") > 0), "exit").when(F.col("__now") > 0, "holding").otherwise("flat")
    return out.select("symbol", "date", "close", change.alias("change"))


def stop_states(positions: DataFrame, quotes: DataFrame, near: float = 0.02) -> DataFrame:
    """symbol, state: breached, near (within ``near`` above), no_stop or ok of open positions with a quote."""
    out = positions.join(quotes.select("symbol", "close"), "symbol")
    stop, close = F.col("stop_loss"), F.col("close")
    return out.select("symbol", "close", "stop_loss", F.when(stop.isNull() | (stop <= 0), "no_stop").when(close <= stop, "breached").when(close <= stop * (1 + near), "near").otherwise("ok").alias("state"))


def market_status(index_bars: DataFrame, period: int = 200) -> DataFrame:
    """The index's last close, average, distance from it in per cent, and whether it is above."""
    out = index_bars.withColumn("ma", over_full(period, F.avg("close"), "close", least=max(20, period // 4)))
    return last_bars(out, 1).select("symbol", "date", "close", "ma", (100 * (div(F.col("close"), F.col("ma")) - 1)).alias("distance_pct"), holds(F.col("close") > F.col("ma")).alias("above"))


def flows_fired(flows: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, source, date, net, before, direction: rules of type ``flow`` whose source's last net flow is of at least their level.

    flows: source, date, net; a rule names its source as its symbol.  A source
    with fewer than two dates fires nothing.
    """
    order = Window.partitionBy("source").orderBy("date")
    rows = flows.filter("net is not null").withColumns({"before": F.lag("net").over(order), "__back": F.row_number().over(order.orderBy(F.col("date").desc()))})
    last = rows.filter("__back = 1 and before is not null")
    asked = rules.filter("type = 'flow'").select("rule_id", F.col("symbol").alias("source"), "level")
    held = last.join(asked, "source").filter(F.abs("net") >= F.col("level"))
    return held.select("rule_id", "source", "date", "net", "before", F.when(F.col("net") >= 0, "in").otherwise("out").alias("direction"))
