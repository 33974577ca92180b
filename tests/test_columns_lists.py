"""Column files written and read, lists of symbols out of files and tables, cached CSV, and features of minutes."""

from __future__ import annotations

import datetime as dt
import math
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barloom.operators import minutes
from barloom.sources import columns, lists

DAYS = [dt.date(2024, 1, d) for d in range(1, 13)]
BARS = "symbol string, date date, close double, volume double"


def _files(folder) -> dict[str, list[float]]:
    return {str(p.relative_to(folder)): np.fromfile(p, "<f4").tolist() for p in sorted(Path(folder).rglob("*.day.bin"))}


def test_column_files(spark, tmp_path):
    """Gaps go forward and then back; what is written does not depend on what was there; later dates are appended."""
    rows = [("a#1", DAYS[k], float(k), 10.0 * k) for k in (1, 2, 4)] + [("b", DAYS[0], 7.0, None), ("b", DAYS[5], 8.0, None)]
    bars = spark.createDataFrame(rows, BARS)
    path = str(tmp_path / "files")
    columns.write_columns(bars, path, ("close", "volume"))
    used = [DAYS[k] for k in (0, 1, 2, 4, 5)]
    assert (tmp_path / "files/calendars/day.txt").read_text() == "".join(f"{d}\n" for d in used)
    got = _files(path)
    assert got["features/a#1/close.day.bin"] == [1.0, 1.0, 2.0, 4.0, 4.0] and got["features/b/close.day.bin"] == [7.0, 7.0, 7.0, 7.0, 8.0]
    assert all(map(math.isnan, got["features/b/volume.day.bin"]))
    read = {(r.symbol, r.date): (r.close, r.volume) for r in columns.read_columns(spark, path, ("close", "volume")).collect()}
    assert len(read) == 10 and read["a#1", DAYS[5]] == (4.0, 40.0) and read["b", DAYS[0]] == (7.0, None)
    columns.write_columns(bars, path, ("close", "volume"))
    assert str(_files(path)) == str(got)
    later = spark.createDataFrame([("b", DAYS[7], 9.0, 1.0), ("c", DAYS[8], 5.0, 2.0)], BARS)
    columns.write_columns(later, path, ("close", "volume"), append=True)
    got = _files(path)
    assert got["features/a#1/close.day.bin"][-3:] == [4.0, 4.0, 4.0] and got["features/b/close.day.bin"][-3:] == [8.0, 9.0, 9.0]
    assert all(map(math.isnan, got["features/c/close.day.bin"][:5])) and got["features/c/close.day.bin"][5:] == [5.0, 5.0]
    dates = {r.symbol: (r.first_date, r.last_date) for r in columns.instruments(spark, path).collect()}
    assert dates == {"a#1": (DAYS[0], DAYS[8]), "b": (DAYS[0], DAYS[8]), "c": (DAYS[7], DAYS[8])}
    columns.write_instruments(spark, path, "all")
    assert [r.value for r in spark.read.text(f"{path}/instruments/all").collect()] == [f"a#1\t{DAYS[0]}\t{DAYS[8]}", f"b\t{DAYS[0]}\t{DAYS[8]}", f"c\t{DAYS[7]}\t{DAYS[8]}"]
    with pytest.raises(ValueError, match="does not follow"):
        columns.write_columns(later, path, ("close", "volume"), append=True)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    """One task cannot write its file: neither its files nor those of the others are there, and no calendar."""
    path = str(tmp_path / "files")
    good = spark.createDataFrame([("a", DAYS[0], 1.0, 1.0)], BARS)
    columns.write_columns(good, path, ("close",))
    before, calendar = _files(path), (tmp_path / "files/calendars/day.txt").read_text()
    bad = spark.createDataFrame([(s, DAYS[1], 2.0, 2.0) for s in ("a", "b", "c", "no\0name")], BARS)
    with pytest.raises(PySparkException):
        columns.write_columns(bad, path, ("close",), append=True)
    assert _files(path) == before and (tmp_path / "files/calendars/day.txt").read_text() == calendar
    assert not list((tmp_path / "files/_jobs").iterdir())


TABLE = "代码\t名称\t现价\r\n600000\t浦发银行\t10\r\n000001 平安 5\r\n300750\t宁德\r\n830799\t艾融\r\n920001\t某\r\n100001\t债\r\n00700\t腾讯\r\nAAPL\tApple\r\nSH600519\r\nBJ430047\r\n\r\nabc\r\nTOOLONG\r\n00700\tagain"


@pytest.mark.parametrize("encoding", ["utf-8", "gbk", "utf-8-sig"])
def test_import_of_a_list(spark, tmp_path, encoding):
    (tmp_path / "list.txt").write_bytes(TABLE.encode(encoding))
    rows = lists.classified(lists.file_lines(spark, str(tmp_path / "list.txt"))).orderBy("place").collect()
    assert [r.symbol for r in rows] == [None, "600000.SH", "000001.SZ", "300750.SZ", "830799.BJ", "920001.SH", None, "00700.HK", "AAPL.US", "600519.SH", "430047.BJ", None, None, None, "00700.HK"]
    assert {r.place: r.reason for r in rows if r.reason} == {1: "heading", 7: "no such board", 12: "blank", 13: "not a symbol", 14: "not a symbol"}
    assert [r.market for r in rows][7:10] == ["HK", "US", "A"]
    kept = lists.united(lists.classified(lists.file_lines(spark, str(tmp_path / "list.txt"))))
    assert {r.symbol: r.place for r in kept.collect()}["00700.HK"] == 8 and kept.count() == 9


def test_what_a_user_names(spark, tmp_path):
    table = lambda *names: spark.createDataFrame(list(enumerate(names)), "place int, symbol string")
    names = lambda spec, **more: [r.symbol for r in lists.resolved(spec, spark, **more).orderBy("source", "place").collect()]
    pool = tmp_path / "pool.txt"
    pool.write_text("# a frozen pool\n600000.SH, AAPL.US # not this\n\nAAPL.US 00700.HK\n")
    (tmp_path / "empty.txt").write_text("# nothing\n")
    assert names(f"file:{pool}") == ["600000.SH", "AAPL.US", "00700.HK"] and names(f' file:"{pool}" ') == names(f"file:{pool}")
    with pytest.raises(ValueError, match="no symbols"):
        names(f"file:{tmp_path / 'empty.txt'}")
    with pytest.raises(PySparkException):
        names(f"file:{tmp_path / 'none.txt'}")
    held = {"watched": table("b", "a"), "held": table("c", "a", None, "c")}
    assert names("both", **held) == ["b", "a", "c"] and names("portfolio", **held) == ["c", "a"] and names("watchlist", **held) == ["b", "a"]
    market = spark.createDataFrame([("x", "US", 1.0), ("y", "US", 3.0), ("z", "HK", 9.0), ("w", "US", None)], "symbol string, market string, amount double")
    assert names("us", market=market, top=2) == ["y", "x"]
    assert names("q, p,,q") == ["q", "p"]


def test_cached_files(spark, tmp_path):
    folder = tmp_path / "5m"
    folder.mkdir()
    body = "\n".join(f"2024-01-02 09:{30 + k}:00,{k},{k + 1},{k + 2},{k + 3},{k + 4}" for k in range(12))
    (folder / "00700.csv").write_text("Datetime,Open,High,Low,Close,Volume\n" + body + "\n")
    (folder / "00001.csv").write_text("ts,volume,close,low,high,open\r\n" + body.replace("\n", "\r\n"))
    (folder / "00002.csv").write_text("ts,open,high,low,close\n" + body)
    (folder / "00003.csv").write_text("ts,open,high,low,close,volume\n" + "\n".join(body.split("\n")[:9]))
    rows = lists.cached_bars(spark, str(tmp_path), "5m").orderBy("symbol", "ts").collect()
    assert [r.symbol for r in rows] == ["00001"] * 12 + ["00700"] * 12
    assert tuple(rows[13])[1:] == (dt.datetime(2024, 1, 2, 9, 31), 1.0, 2.0, 3.0, 4.0, 5.0) and tuple(rows[1])[2:] == (5.0, 4.0, 3.0, 2.0, 1.0)


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    """The exponential averages and a few others by pandas."""
    close, out = df["close"], pd.DataFrame(index=df.index)
    dif = close.ewm(span=12).mean() - close.ewm(span=26).mean()
    rsv = (close - df["low"].rolling(9).min()) / (df["high"].rolling(9).max() - df["low"].rolling(9).min() + 1e-10) * 100
    k = rsv.ewm(span=3).mean()
    return out.assign(dif=dif, dea=dif.ewm(span=9).mean(), k=k, d=k.ewm(span=3).mean(), volatility30=close.pct_change().rolling(30).std() * 30**0.5, v_price_corr=df["volume"].rolling(10).corr(close))


def test_minute_features(spark):
    rng, rows = random.Random(6), []
    for symbol in "ab":
        price = 10.0
        for k in range(80):
            o, price = price, price * (1 + rng.uniform(-0.02, 0.02))
            rows.append((symbol, dt.datetime(2024, 1, 2, 9, 30) + dt.timedelta(minutes=k), o, max(o, price) * 1.01, min(o, price) * 0.99, price, float(rng.randint(1, 99))))
    frame = spark.createDataFrame(rows, "symbol string, date timestamp, open double, high double, low double, close double, volume double")
    got = minutes.minute_features(frame).toPandas().set_index(["symbol", "date"]).sort_index()
    assert got.shape == (100, 35)
    whole = pd.DataFrame(rows, columns=frame.columns).set_index(["symbol", "date"])
    for symbol in "ab":
        plain = _plain(whole.loc[symbol]).iloc[30:]
        for name in plain:
            np.testing.assert_allclose(got.loc[symbol][name].to_numpy(), plain[name].to_numpy(), rtol=1e-7, err_msg=name)


def test_scores_of_the_day(spark):
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    daily = spark.createDataFrame([("a", DAYS[1], 1.0), ("b", DAYS[1], 2.0), ("a", DAYS[2], 5.0)], "symbol string, date date, score double")
    five = spark.createDataFrame([("a", at(2, 9), 1.0), ("a", at(2, 15), 3.0), ("a", at(4, 9), 9.0)], "symbol string, ts timestamp, score double")
    rows = {(r.symbol, r.date): (r.score, r.score1, r.score2) for r in minutes.day_scores(daily, five, five.limit(0)).collect()}
    assert rows == {("a", DAYS[1]): (1.0, 3.0, None), ("b", DAYS[1]): (2.0, None, None), ("a", DAYS[2]): (5.0, None, None)}
    best = minutes.ensemble_of_day(minutes.day_scores(daily.filter(F.col("date") == DAYS[1]), five), {"score": 0.5, "score1": 0.5})
    assert [(r.symbol, r.score) for r in best.collect()] == [("a", 2.0), ("b", 1.0)]
