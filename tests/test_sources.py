"""Recorded replies of each service's form, broken ones among them, and connectors behind a format."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from barloom.sources import connectors, replies

DAY = dt.date(2026, 7, 24)
REPLY = "source string, market string, symbol string, body binary"


def _line(separator: str, size: int, **places: str) -> bytes:
    fields = ["0"] * size
    for place, value in places.items():
        fields[int(place[1:])] = value
    return f'var x="{separator.join(fields)}";\n'.encode("gbk")


QUOTES = [
    ("sina", "A", "600000.SH", _line(",", 33, _0="浦发银行", _1="10.5", _2="10", _3="11", _4="11.5", _5="9.5", _8="12300", _30="2026-07-24")),
    ("sina", "HK", "00001.HK", _line(",", 19, _0="CKH", _1="长和", _2="40", _3="50", _4="44", _5="39", _6="42", _12="777", _17="2026/07/24")),
    ("sina", "HK", "00002.HK", _line(",", 13, _0="CLP", _1="", _2="0", _3="0", _4="0", _5="0", _6="60", _12="1")),
    ("sina", "US", "AAPL.US", _line(",", 11, _0="苹果", _1="330", _3="2026-07-25 04:00:02", _4="30", _5="310", _6="340", _7="305", _10="9000")),
    ("tencent", "A", "600000.SH", _line("~", 50, _1="浦发银行", _3="11", _4="10", _5="10.5", _6="123", _30="20260724150000", _33="11.5", _34="9.5")),
    ("tencent", "HK", "00001.HK", _line("~", 50, _1="长和", _3="42", _4="50", _5="40", _6="777.0", _30="2026/07/24 16:08:00", _33="44", _34="39")),
    ("coingecko", "CRYPTO", "BTC-USDT", json.dumps({"bitcoin": {"usd": 150.0, "usd_24h_change": 50.0, "usd_24h_vol": 5.0}}).encode()),
    ("sina", "A", "600001.SH", b'var x="";'),
    ("sina", "A", "600002.SH", b"oops"),
    ("sina", "A", "600003.SH", None),
    ("sina", "A", "600004.SH", _line(",", 33, _0="n", _3="0")),
    ("tencent", "A", "600005.SH", _line("~", 12, _1="n", _3="5")),
    ("coingecko", "CRYPTO", "NONE-USDT", b"{}"),
    ("other", "A", "600006.SH", b"x"),
]


def test_quotes(spark):
    rows = {(r.source, r.symbol): r for r in replies.quotes(spark.createDataFrame(QUOTES, REPLY)).collect()}
    got = {k: (r.name, r.date, r.open, r.high, r.low, r.close, r.volume, r.prev_close, round(r.change_pct, 6)) for k, r in rows.items() if r.fault is None}
    assert got == {
        ("sina", "600000.SH"): ("浦发银行", DAY, 10.5, 11.5, 9.5, 11.0, 12300.0, 10.0, 10.0),
        ("sina", "00001.HK"): ("长和", DAY, 40.0, 44.0, 39.0, 42.0, 777.0, 50.0, -16.0),
        ("sina", "00002.HK"): ("CLP", None, 60.0, 60.0, 60.0, 60.0, 1.0, 60.0, 0.0),  # no day, no prices but the last
        ("sina", "AAPL.US"): ("苹果", DAY, 310.0, 340.0, 305.0, 330.0, 9000.0, 300.0, 10.0),  # written in the time of another zone
        ("tencent", "600000.SH"): ("浦发银行", DAY, 10.5, 11.5, 9.5, 11.0, 12300.0, 10.0, 10.0),  # in lots of a hundred
        ("tencent", "00001.HK"): ("长和", DAY, 40.0, 44.0, 39.0, 42.0, 777.0, 50.0, -16.0),
        ("coingecko", "BTC-USDT"): ("bitcoin", None, 100.0, 150.0, 150.0, 150.0, 5.0, 100.0, 50.0),
    }
    assert {k[1]: r.fault for k, r in rows.items() if r.fault} == {"600001.SH": "few fields", "600002.SH": "malformed", "600003.SH": "empty", "600004.SH": "no price", "600005.SH": "few fields", "NONE-USDT": "no such coin", "600006.SH": "unknown service"}
    told = {(r.source, r.fault): r.n for r in replies.faults(replies.quotes(spark.createDataFrame(QUOTES, REPLY))).collect()}
    assert told["sina", "empty"] == 1 and sum(told.values()) == 7


def test_a_batch_of_quotes(spark):
    body = b"\n".join(x[3].strip() for x in QUOTES[:1] * 2)
    frame = spark.createDataFrame([("sina", "A", ["600000.SH", "600001.SH"], body)], "source string, market string, symbols array<string>, body binary")
    found = replies.quotes(replies.quote_batches(frame)).collect()
    assert [(r.symbol, r.close) for r in found] == [("600000.SH", 11.0), ("600001.SH", 11.0)]


SPOTS = [
    ("eastmoney", "A", None, {"data": {"total": 3, "diff": [{"f12": "600000", "f14": "浦发", "f2": 11.0, "f3": 1.5, "f5": 7, "f6": 77.0, "f15": 12, "f16": 10, "f17": 10.5, "f18": 10.8}, {"f12": "920001", "f14": "北", "f2": "-", "f3": "-"}, {"f12": "000002", "f2": 3}]}}),
    ("eastmoney", "HK", None, {"data": {"diff": [{"f12": "700", "f2": 400}]}}),
    ("eastmoney", "US", None, {"data": {"diff": [{"f12": "aapl", "f2": 300}]}}),
    ("binance", "CRYPTO", None, [{"symbol": "BTCUSDT", "lastPrice": "60000.5", "priceChangePercent": "-1.25", "volume": "2", "quoteVolume": "10", "highPrice": "3", "lowPrice": "1", "openPrice": "2", "prevClosePrice": "2"}, {"symbol": "ETHBTC", "lastPrice": "1"}, {"symbol": "ETHUSDT", "lastPrice": "5", "quoteVolume": "99"}]),
    ("okx", "CRYPTO", None, {"BTC/USDT": {"last": 2.0, "percentage": 1.0, "baseVolume": 3.0, "previousClose": 1.9}, "ETH/USDT": {"last": 5.0, "percentage": 1.0, "baseVolume": 4.0}, "XRP/USDT": {"last": 1.0, "percentage": None}, "A/EUR": {"last": 1.0, "percentage": 1.0}}),
    ("binance", "CRYPTO", "broken", "{no"),
    ("eastmoney", "A", "none", {"data": None}),
    ("eastmoney", "A", "blank", None),
    ("somewhere", "A", "unknown", {}),
]


def test_lists_of_different_shapes(spark):
    body = lambda x: None if x is None else (x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)).encode()
    frame = spark.createDataFrame([(s, m, y, body(x)) for s, m, y, x in SPOTS], REPLY)
    found = replies.spots(frame).collect()
    got = [(r.source, r.symbol, r.name, r.close, r.change_pct, r.amount, r.place) for r in found if r.fault is None]
    assert sorted(got, key=str) == sorted(
        [
            ("eastmoney", "600000.SH", "浦发", 11.0, 1.5, 77.0, 1), ("eastmoney", "920001.BJ", "北", None, None, None, 2), ("eastmoney", "000002.SZ", "", 3.0, None, None, 3),
            ("eastmoney", "00700.HK", "", 400.0, None, None, 1), ("eastmoney", "AAPL.US", "", 300.0, None, None, 1),
            ("binance", "ETH-USDT", "ETH", 5.0, None, 99.0, 1), ("binance", "BTC-USDT", "BTC", 60000.5, -1.25, 10.0, 2),
            ("okx", "ETH-USDT", "ETH", 5.0, 1.0, 20.0, 1), ("okx", "BTC-USDT", "BTC", 2.0, 1.0, 6.0, 2),
        ], key=str,
    )
    assert sorted(r.fault for r in found if r.fault) == ["empty", "empty list", "not json", "unknown service"]
    assert replies.spots(frame, top=1).filter("fault is null").count() == 5


HISTORIES = [
    ("eastmoney", "A", "a", json.dumps({"data": {"klines": ["2026-07-23,1,2,3,0.5,100,9", "2026-07-24,2,3,4,1,200,9", "bad"]}})),
    ("binance", "CRYPTO", "b", json.dumps([[1784764800000, "1", "3", "0.5", "2", "100", 0, "0"], [1784851200000, "2", "4", "1", "3", "200", 0, "0"]])),
    ("sina", "A", "c", json.dumps([{"day": "2026-07-23", "open": "1", "high": "3", "low": "0.5", "close": "2", "volume": "100"}, {"day": "2026-07-24", "open": "2", "high": "4", "low": "1", "close": "3", "volume": "200"}])),
    ("yahoo", "US", "d", json.dumps({"chart": {"result": [{"timestamp": [1784813400, 1784899800], "indicators": {"quote": [{"open": [1, 2], "high": [3, 4], "low": [0.5, 1], "close": [2, 3], "volume": [100, 200]}]}}]}})),
    ("netease", "A", "e", "日期,股票代码,名称,收盘价,最高价,最低价,开盘价,成交量\r\n2026-07-24,'1,甲,3,4,1,2,200\r\n2026-07-23,'1,甲,2,3,0.5,1,100\r\n2026-07-22,'1,甲,0.0,0.0,0.0,0.0,0\r\n"),
    ("netease", "A", "page", "  <html>"),
    ("yahoo", "US", "none", json.dumps({"chart": {"result": [], "error": "x"}})),
    ("sina", "HK", "null", "null"),
    ("eastmoney", "A", "cut", '{"data": {"kli'),
    ("nowhere", "A", "odd", "{}"),
    ("yahoo", "US", "blank", ""),
]


def test_histories_of_every_form(spark):
    frame = spark.createDataFrame([(s, m, y, b.encode("gbk" if s in replies.GBK else "utf-8")) for s, m, y, b in HISTORIES], REPLY)
    rows = replies.histories(frame).collect()
    want = [(dt.date(2026, 7, 23), 1.0, 3.0, 0.5, 2.0, 100.0), (DAY, 2.0, 4.0, 1.0, 3.0, 200.0)]
    for symbol in "abcde":
        assert sorted(tuple(r)[3:9] for r in rows if r.symbol == symbol) == want, symbol
    assert {r.symbol: r.fault for r in rows if r.fault} == {"page": "a page, not data", "none": "no bars", "null": "no bars", "cut": "not json", "odd": "unknown service", "blank": "empty"}
    last = {r.symbol: r for r in replies.snapshots(replies.histories(frame)).collect()}
    assert set(last) == set("abcde") and all((r.date, r.close, r.prev_close, r.change_pct) == (DAY, 3.0, 2.0, 50.0) for r in last.values())


def _given(rows):
    return lambda symbols, market, first, last: [r for r in rows if r[0] in symbols]


def _bar(symbol: str, day: int, close: float = 1.0) -> tuple:
    return symbol, dt.date(2026, 7, day), 1.0, 2.0, 0.5, close, 10.0


def _fails(*_):
    raise TimeoutError("no answer")


@pytest.fixture
def registry():
    out = connectors.Registry()
    out.register(connectors.Connector("first", frozenset({"A", "US"}), {"bars": _fails, "snapshot": _fails}, 10))
    out.register(connectors.Connector("second", frozenset({"A", "HK"}), {"bars": _given([_bar("600000.SH", d) for d in (20, 21, 22)]), "batch": _fails}, 20, only={"bars": frozenset({"A"})}))
    out.register(connectors.Connector("third", frozenset({"A"}), {"bars": _given([_bar("600000.SH", 20, 9.0), _bar("600001.SH", 21, 9.0)])}, 30))
    out.register(connectors.Connector("absent", frozenset({"A", "HK"}), {"bars": _fails}, 1, requires=("no_such_package_here",)))
    return out


def test_what_connectors_can_do(spark, registry):
    names = lambda *x, **y: [c.name for c in registry.ranked(*x, **y)]
    assert names("A", "bars") == ["first", "second", "third"] and names("HK", "bars") == [] and names("HK", "batch") == ["second"]
    assert names("A", "bars", prefer=("third",)) == ["third", "first", "second"]
    assert names("A", "bars", health={("first", "A"): False, ("third", "A"): True}) == ["third", "second", "first"]
    assert registry.connectors["first"].capabilities() == ["bars", "snapshot"] and not registry.connectors["absent"].installed()
    table = registry.table(spark)
    assert {r.name for r in table.filter("market = 'A' and capability = 'bars' and installed").collect()} == {"first", "second", "third"}
    assert table.filter("market = 'HK' and capability = 'bars'").select("name", "installed").collect() == [("absent", False)]
    registry.register(connectors.Connector("third", frozenset({"HK"}), {}, 1))
    assert names("A", "bars") == ["first", "second"]


def test_reading_through_the_registry(spark, registry):
    connectors.enable(spark, registry, "recorded")
    frame = spark.read.format("recorded").option("symbols", "600000.SH, 600001.SH,AAPL.US,00700.HK,600009.SH,600000.SH").load()
    rows = frame.collect()
    got = sorted((r.symbol, r.date.day, r.close, r.source) for r in rows if r.date)
    assert got == [("600000.SH", d, 1.0, "second") for d in (20, 21, 22)] + [("600001.SH", 21, 9.0, "third")]
    assert sorted((r.market, r.symbol, r.source, r.fault) for r in rows if not r.date if r.market != "HK") == [("A", "600009.SH", "first", "TimeoutError: no answer"), ("US", "AAPL.US", "first", "TimeoutError: no answer")]
    assert [(r.source, r.fault) for r in rows if r.market == "HK"] == [(None, "there is no source")]
    part = frame.filter((F.col("market") == "A") & (F.col("date") > dt.date(2026, 7, 20)) & (F.col("date") <= dt.date(2026, 7, 21)))
    assert sorted((r.symbol, r.date.day) for r in part.collect()) == [("600000.SH", 21), ("600001.SH", 21)]
    prefer = spark.read.format("recorded").option("symbols", "600000.SH").option("prefer", "third").load().collect()
    assert [(r.close, r.source) for r in prefer] == [(9.0, "third")]
    with pytest.raises(PythonException, match="no source gave bars of US: first: TimeoutError"):
        spark.read.format("recorded").option("symbols", "AAPL.US").option("failures", "raise").load().collect()


def test_filters_reach_the_connectors(registry):
    """What is pushed narrows the days that are asked for and the partitions that are made."""
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    symbols = ",".join(f"{600000 + k}.SH" for k in range(130)) + ",AAPL.US"
    reader = connectors._Reader(registry, {"symbols": symbols}, connectors.market_of)
    assert [(p.market, len(p.symbols)) for p in reader.partitions()] == [("A", 60), ("A", 60), ("A", 10), ("US", 1)]
    left = list(reader.pushFilters([EqualTo(("market",), "US"), GreaterThanOrEqual(("date",), DAY), LessThan(("date",), DAY + dt.timedelta(days=3)), EqualTo(("close",), 1.0)]))
    assert [type(f) for f in left] == [GreaterThanOrEqual, LessThan, EqualTo]
    (part,) = reader.partitions()
    assert (part.market, part.first, part.last) == ("US", DAY, DAY + dt.timedelta(days=2))
    assert list(reader.pushFilters([In(("market",), ["A", "HK"])])) == [] and reader.partitions() == []


def test_reasons_of_a_total_failure(registry):
    rows, errors, left = connectors.fetched(registry.ranked("US", "bars"), "US", ["X.US"], DAY, DAY)
    assert (rows, errors, left) == ([], {"first": "TimeoutError: no answer"}, ["X.US"])
    error = connectors.AllSourcesFailed("US", "bars", errors)
    assert error.errors == errors and "no answer" in str(error)
    assert connectors.fetched([registry.connectors["third"]], "A", ["600009.SH"], DAY, DAY)[1] == {"third": "gave nothing"}
