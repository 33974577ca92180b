"""Replies of quote services as they were received: one a row, of every service in one pass.

A reply is (source, market, symbol, body): bytes, in GBK where the service
writes that.  Lines of quotes are laid out by service and market; lists and
histories in JSON are parsed as variants, so that services of different shapes
share one plan.  A reply that gives nothing keeps its row with the reason in
``fault``; rows with values have a null there.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.symbols import normalise_symbol
from barloom.sources.payloads import iso_date

# --- fixed values of the services' formats: places, paths, names of fields ---

GBK = ("sina", "tencent", "netease")
SEPARATOR = {"sina": ",", "tencent": "~"}
#: Places of the fields in a line of quotes, the least number of fields, and what a unit of volume holds.
LINES: dict[tuple[str, str], dict[str, int]] = {
    ("sina", "A"): {"name": 0, "open": 1, "prev_close": 2, "close": 3, "high": 4, "low": 5, "volume": 8, "date": 30, "least": 6, "unit": 1},
    ("sina", "HK"): {"name": 1, "other_name": 0, "open": 2, "prev_close": 3, "high": 4, "low": 5, "close": 6, "volume": 12, "date": 17, "least": 6, "unit": 1},
    ("sina", "US"): {"name": 0, "close": 1, "date": 3, "change": 4, "open": 5, "high": 6, "low": 7, "volume": 10, "least": 6, "unit": 1, "hours": 12},
    ("tencent", "A"): {"name": 1, "close": 3, "prev_close": 4, "open": 5, "volume": 6, "date": 30, "high": 33, "low": 34, "least": 40, "unit": 100},
    ("tencent", "HK"): {"name": 1, "close": 3, "prev_close": 4, "open": 5, "volume": 6, "date": 30, "high": 33, "low": 34, "least": 40, "unit": 1},
    ("tencent", "US"): {"name": 1, "close": 3, "prev_close": 4, "open": 5, "volume": 6, "date": 30, "high": 33, "low": 34, "least": 40, "unit": 1},
}
#: Where a market's list is in a reply, and the paths of its fields.
SPOTS: dict[str, dict[str, str]] = {
    "eastmoney": {"list": "$.data.diff", "code": "$.f12", "name": "$.f14", "close": "$.f2", "change_pct": "$.f3", "volume": "$.f5", "amount": "$.f6", "high": "$.f15", "low": "$.f16", "open": "$.f17", "prev_close": "$.f18"},
    "binance": {"list": "$", "code": "$.symbol", "close": "$.lastPrice", "change_pct": "$.priceChangePercent", "volume": "$.volume", "amount": "$.quoteVolume", "high": "$.highPrice", "low": "$.lowPrice", "open": "$.openPrice", "prev_close": "$.prevClosePrice"},
    "okx": {"map": "$", "close": "$.last", "change_pct": "$.percentage", "volume": "$.baseVolume", "high": "$.high", "low": "$.low", "open": "$.open", "prev_close": "$.previousClose"},
}
#: Names of coins by their ticker where a service asks by name.
COINS = {"btc": "bitcoin", "eth": "ethereum", "bnb": "binancecoin", "sol": "solana", "xrp": "ripple", "doge": "dogecoin", "ada": "cardano"}
#: Heads of the columns of a history in CSV.
HEADS = {"日期": "date", "开盘价": "open", "最高价": "high", "最低价": "low", "收盘价": "close", "成交量": "volume"}
PRICES = ("open", "high", "low", "close", "volume")


def texts(replies: DataFrame) -> DataFrame:
    """``replies`` with ``body`` as text; bytes that are none in their encoding become U+FFFD."""

    @F.pandas_udf("string")
    def decoded(source: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else bytes(b).decode("gbk" if s in GBK else "utf-8", "replace") for s, b in zip(source, body, strict=True)], dtype=object)

    return replies if dict(replies.dtypes)["body"] == "string" else replies.withColumn("body", decoded("source", "body"))


def _of(cases: dict, make: Callable[[object], Column | None], on: Callable[[object], Column], kind: str) -> Column:
    """The value of the case that holds; null of ``kind`` where none does."""
    out = F.lit(None).cast(kind)
    for case in cases:
        value = make(case)
        if value is not None:
            out = F.when(on(case), value).otherwise(out)
    return out


# --- lines of quotes ---


def quotes(replies: DataFrame) -> DataFrame:
    """source, market, symbol, name, date, open, high, low, close, volume, prev_close, change_pct, fault.

    Lines ``name="a,b,...";`` and the prices of coins.  A missing price of the
    day is the last one, a missing day null; the day of a service that writes
    another zone's time is put right.
    """
    here = lambda case: (F.col("source") == case[0]) & (F.col("market") == case[1])
    rows = texts(replies)
    inner = F.regexp_extract("body", '="([^"]*)"', 1)
    rows = rows.withColumn("__p", F.when(F.contains("body", F.lit('="')), F.split(inner, F.when(F.col("source") == "tencent", "~").otherwise(","))))
    coin = F.element_at(F.create_map(*(F.lit(x) for pair in COINS.items() for x in pair)), F.lower(F.substring_index("symbol", "-", 1)))
    coin = F.coalesce(coin, F.lower(F.substring_index("symbol", "-", 1)))
    is_coin = F.col("source") == "coingecko"
    rows = rows.withColumns({"__coin": coin, "__v": F.when(is_coin, F.try_element_at(F.from_json("body", "map<string, map<string, double>>"), coin))})

    def field(name: str) -> Column:
        return _of(LINES, lambda c: F.get("__p", LINES[c][name]) if name in LINES[c] else None, here, "string")

    number = lambda name: field(name).try_cast("double")
    close = F.coalesce(number("close"), F.try_element_at("__v", F.lit("usd")))
    rows = rows.withColumns({"__close": close, "__change": F.coalesce(F.try_element_at("__v", F.lit("usd_24h_change")), F.lit(0.0))})
    before = F.coalesce(number("prev_close"), F.col("__close") - F.coalesce(number("change"), F.when(F.col("market") == "US", 0.0)))
    before = F.when(is_coin, F.when(F.col("__change") == -100, F.col("__close")).otherwise(F.col("__close") / (1 + F.col("__change") / 100))).otherwise(before)
    day = _of(LINES, lambda c: iso_date(F.get("__p", LINES[c]["date"]), LINES[c].get("hours", 0)), here, "date")
    volume = F.when(is_coin, F.try_element_at("__v", F.lit("usd_24h_vol"))).otherwise(number("volume") * _of(LINES, lambda c: F.lit(LINES[c]["unit"]), here, "int"))
    least = _of(LINES, lambda c: F.lit(LINES[c]["least"]), here, "int")
    name = F.coalesce(F.nullif(field("name"), F.lit("")), F.nullif(field("other_name"), F.lit("")))
    fault = (
        F.when(F.col("body").isNull() | (F.trim("body") == ""), "empty")
        .when(~is_coin & least.isNull(), "unknown service")
        .when(is_coin & F.col("__v").isNull(), "no such coin")
        .when(~is_coin & F.col("__p").isNull(), "malformed")
        .when(~is_coin & ((F.size("__p") < least) | name.isNull()), "few fields")
        .when(F.coalesce(F.col("__close"), F.lit(0.0)) <= 0, "no price")
    )
    rows = rows.withColumn("fault", fault)
    good = lambda x: F.when(F.col("fault").isNull(), x)
    other = lambda n, also: F.coalesce(F.nullif(number(n), F.lit(0.0)), F.when(is_coin, also), F.col("__close"))
    prev = F.coalesce(F.nullif(before, F.lit(0.0)), F.col("__close"))
    made = {
        "name": F.when(is_coin, F.col("__coin")).otherwise(name),
        "date": day,
        "open": other("open", prev),
        "high": other("high", F.col("__close")),
        "low": other("low", F.col("__close")),
        "close": F.col("__close"),
        "volume": F.coalesce(volume, F.lit(0.0)),
        "prev_close": prev,
        "change_pct": F.when(is_coin, F.col("__change")).otherwise(100 * (F.col("__close") - prev) / prev),
    }
    return rows.select("source", "market", "symbol", *(good(x).alias(n) for n, x in made.items()), "fault")


def quote_batches(replies: DataFrame) -> DataFrame:
    """One reply a symbol out of replies about many: (source, market, symbols, body) with a line for each symbol, in their order."""
    rows = texts(replies)
    lines = F.filter(F.split("body", "\n"), lambda x: F.contains(x, F.lit('="')))
    return rows.select("source", "market", F.inline(F.arrays_zip(F.col("symbols").alias("symbol"), lines.alias("body"))))


# --- lists of a market ---


def spots(replies: DataFrame, top: int | None = None) -> DataFrame:
    """source, market, symbol, name, close, change_pct, volume, amount, high, low, open, prev_close, place, fault of lists in JSON.

    Coins count against one currency only and go by amount, other lists keep
    their order; ``place`` counts from 1 and at most ``top`` stay of each reply.
    """
    here = lambda s: F.col("source") == s
    rows = texts(replies).withColumn("__id", F.monotonically_increasing_id()).withColumn("__v", F.try_parse_json("body"))
    listed = _of(SPOTS, lambda s: F.transform(F.try_variant_get("__v", SPOTS[s]["list"], "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"))) if "list" in SPOTS[s] else F.map_entries(F.try_variant_get("__v", SPOTS[s]["map"], "map<string, variant>")), here, "array<struct<key: string, value: variant>>")
    fault = F.when(F.col("body").isNull() | (F.trim("body") == ""), "empty").when(~F.col("source").isin(*SPOTS), "unknown service").when(F.col("__v").isNull(), "not json").when(F.coalesce(F.size("__l"), F.lit(0)) == 0, "empty list")
    rows = rows.withColumn("__l", listed).withColumn("fault", fault)
    told = rows.filter("fault is not null")
    rows = rows.filter("fault is null").select("source", "market", "__id", F.posexplode("__l").alias("__at", "__e"))

    def field(name: str, kind: str = "double") -> Column:
        return _of(SPOTS, lambda s: F.try_variant_get("__e.value", SPOTS[s][name], kind) if name in SPOTS[s] else None, here, kind)

    code = F.coalesce(field("code", "string"), F.col("__e.key"))
    stock = F.when(F.col("market") == "A", normalise_symbol(code)).when(F.col("market") == "HK", F.concat(F.lpad(code, 5, "0"), F.lit(".HK"))).otherwise(F.concat(F.upper(code), F.lit(".US")))
    pair = F.when(here("binance"), F.regexp_replace(code, "USDT$", "-USDT")).otherwise(F.replace(code, F.lit("/"), F.lit("-")))
    coins = F.col("source") != "eastmoney"
    rows = rows.withColumns({"symbol": F.when(coins, pair).otherwise(stock), **{n: field(n) for n in ("close", "change_pct", "volume", "amount", "high", "low", "open", "prev_close")}, "name": field("name", "string")})
    rows = rows.filter(~coins | (F.endswith("symbol", F.lit("-USDT")) & (here("binance") | F.col("change_pct").isNotNull())))
    rows = rows.withColumn("name", F.when(coins, F.substring_index("symbol", "-", 1)).otherwise(F.coalesce("name", F.lit(""))))
    rows = rows.withColumn("amount", F.when(here("okx"), F.coalesce("close", F.lit(0.0)) * F.coalesce("volume", F.lit(0.0))).otherwise(F.col("amount")))
    order = Window.partitionBy("__id").orderBy(F.when(coins, F.col("amount")).desc_nulls_last(), "__at")  # a reply's rows
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows if top is None else rows.filter(F.col("place") <= top)
    names = ["source", "market", "symbol", "name", "close", "change_pct", "volume", "amount", "high", "low", "open", "prev_close", "place"]
    return rows.select(*names).unionByName(told.select("source", "market", "fault"), allowMissingColumns=True)


# --- histories ---


def histories(replies: DataFrame) -> DataFrame:
    """source, market, symbol, date, open, high, low, close, volume, fault: daily bars of every service's own form, unsorted.

    Lists of lines, of lists and of objects, parallel lists, and CSV with heads;
    times are days of UTC.
    """
    rows = texts(replies).withColumn("__v", F.try_parse_json("body"))
    get = lambda path, kind: F.try_variant_get("__v", path, kind)
    bar = "struct<date: date, open: double, high: double, low: double, close: double, volume: double>"
    none = F.lit(None).cast(f"array<{bar}>")
    double = lambda x: x.try_cast("double")

    def of_parts(parts: Column, day: Column, places: dict[str, int]) -> Column:
        return F.struct(day.alias("date"), *(double(F.get(parts, places[n])).alias(n) for n in PRICES))

    order = {"open": 1, "close": 2, "high": 3, "low": 4, "volume": 5}
    csv_lines = F.transform(get("$.data.klines", "array<string>"), lambda x: of_parts(F.split(x, ","), iso_date(F.get(F.split(x, ","), F.lit(0))), order))
    millis = lambda x: F.to_date(F.timestamp_millis(F.get(x, F.lit(0)).try_cast("bigint")))
    lists = F.transform(get("$", "array<array<string>>"), lambda x: of_parts(x, millis(x), {"open": 1, "high": 2, "low": 3, "close": 4, "volume": 5}))
    objects = F.transform(get("$", "array<struct<day: string, open: string, high: string, low: string, close: string, volume: string>>"), lambda x: F.struct(iso_date(x["day"]).alias("date"), *(double(x[n]).alias(n) for n in PRICES)))
    quote = "$.chart.result[0].indicators.quote[0]."
    zipped = F.arrays_zip(get("$.chart.result[0].timestamp", "array<bigint>").alias("t"), *(get(quote + n, "array<double>").alias(n) for n in PRICES))
    parallel = F.transform(zipped, lambda x: F.struct(F.to_date(F.timestamp_seconds(x["t"])).alias("date"), *(x[n].alias(n) for n in PRICES)))
    lines = F.filter(F.split(F.regexp_replace("body", "\r", ""), "\n"), lambda x: F.trim(x) != "")
    head = F.transform(F.split(F.get(lines, 0), ","), lambda x: F.trim(x))
    place = {english: F.array_position(head, head_name) for head_name, english in HEADS.items()}  # 0 where there is none
    cell = lambda parts, n: F.when(place[n] > 0, F.get(parts, place[n] - 1))
    table = F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: F.struct(iso_date(cell(F.split(x, ","), "date")).alias("date"), *(double(cell(F.split(x, ","), n)).alias(n) for n in PRICES)))
    forms = {"eastmoney": csv_lines, "binance": lists, "sina": objects, "yahoo": parallel, "netease": table}
    made = _of(forms, lambda s: forms[s].cast(f"array<{bar}>"), lambda s: F.col("source") == s, f"array<{bar}>")
    page = F.startswith(F.ltrim(F.col("body")), F.lit("<"))
    rows = rows.withColumn("__bars", F.filter(F.coalesce(F.when(~page, made), none), lambda x: x["date"].isNotNull() & (x["close"] > 0)))
    fault = F.when(F.col("body").isNull() | (F.trim("body") == ""), "empty").when(~F.col("source").isin(*forms), "unknown service").when(page, "a page, not data").when((F.col("source") != "netease") & F.col("__v").isNull(), "not json").when(F.coalesce(F.size("__bars"), F.lit(0)) == 0, "no bars")
    rows = rows.withColumn("fault", fault).withColumn("__bars", F.when(F.col("fault").isNull(), F.col("__bars")))
    return rows.select("source", "market", "symbol", F.explode_outer("__bars").alias("b"), "fault").select("source", "market", "symbol", "b.*", "fault")


def snapshots(bars: DataFrame) -> DataFrame:
    """The last bar of each source and symbol with the close before it (its own where there is none)."""
    newest = Window.partitionBy("source", "symbol").orderBy(F.col("date").desc())
    rows = bars.filter("fault is null").withColumns({"__turn": F.row_number().over(newest), "prev_close": F.coalesce(F.lead("close").over(newest), F.col("close"))}).filter("__turn = 1")
    return rows.withColumn("change_pct", 100 * (F.col("close") / F.col("prev_close") - 1)).drop("__turn", "fault")


def faults(parsed: DataFrame) -> DataFrame:
    """How many replies of each service gave nothing, by reason."""
    return parsed.filter("fault is not null").groupBy("source", "market", "fault").agg(F.count(F.lit(1)).alias("n"))
