"""Bars out of recorded replies of quote services: one text a row, parsed by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of date, open, close, high, low and volume in a k-line record (fixed by the formats).
KLINE = ("date", "open", "close", "high", "low", "volume")


def iso_date(raw: Column, shift_hours: int = 0) -> Column:
    """The date that any text's first eight digits name, ``shift_hours`` earlier where it has a time."""
    day = F.to_date(F.try_to_timestamp(F.substring(F.regexp_replace(raw, "[^0-9]", ""), 1, 8), F.lit("yyyyMMdd")))
    if not shift_hours:
        return day
    moment = F.try_to_timestamp(F.substring(F.regexp_replace(raw, "[^0-9]", ""), 1, 14), F.lit("yyyyMMddHHmmss"))
    return F.coalesce(F.to_date(F.timestamp_add("HOUR", F.lit(-shift_hours), moment)), day)


def _bar(parts: Column) -> Column:
    return F.struct(iso_date(F.get(parts, 0)).alias("date"), *(F.get(parts, k).try_cast("double").alias(n) for k, n in enumerate(KLINE) if k))


def csv_klines(replies: DataFrame, body: str = "body") -> DataFrame:
    """symbol, date and prices of replies ``{"data": {"klines": ["date,open,close,high,low,volume", ...]}}``; broken replies give none."""
    lines = F.from_json(body, "data struct<klines: array<string>>")["data"]["klines"]
    out = replies.select("symbol", F.explode(lines).alias("line")).select("symbol", _bar(F.split("line", ",")).alias("b"), F.size(F.split("line", ",")).alias("n"))
    return out.filter("n >= 6").select("symbol", "b.*")


def array_klines(replies: DataFrame, body: str = "body", code: str = "code") -> DataFrame:
    """The same of ``{"code": 0, "data": {code: {"day": [[date, open, close, high, low, volume], ...]}}}``; adjusted days (``qfqday``) come first."""
    parsed = F.from_json(body, "code int, data map<string, struct<qfqday: array<array<string>>, day: array<array<string>>>>")
    node = F.element_at(parsed["data"], F.col(code))
    rows = F.when(parsed["code"] == 0, F.coalesce(node["qfqday"], node["day"]))
    return replies.select("symbol", F.explode(rows).alias("line")).filter(F.size("line") >= 6).select("symbol", _bar(F.col("line")).alias("b")).select("symbol", "b.*")


def column_klines(replies: DataFrame, body: str = "body") -> DataFrame:
    """The same of parallel arrays ``{"timestamp": [...], "open": [...], ...}`` of seconds and prices."""
    kinds = ", ".join(f"{c}: array<double>" for c in ("open", "high", "low", "close", "volume"))
    parsed = replies.select("symbol", F.from_json(body, f"timestamp array<bigint>, {kinds.replace(':', '')}").alias("p"))
    zipped = F.arrays_zip(*(F.col(f"p.{c}") for c in ("timestamp", "open", "high", "low", "close", "volume")))
    out = parsed.select("symbol", F.explode(zipped).alias("z"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("z.timestamp") / 86_400).cast("int"))
    return out.select("symbol", day.alias("date"), *(F.col(f"z.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")))


def quote_lines(replies: DataFrame, body: str = "body", separator: str = ",", places: dict[str, int] | None = None) -> DataFrame:
    """Snapshots out of lines ``var name="a,b,c,...";``: name, open, prev_close, close, high, low, volume and the change; quotes without a price go."""
    places = places or {"name": 0, "open": 1, "prev_close": 2, "close": 3, "high": 4, "low": 5, "volume": 8}
    parts = F.split(F.regexp_extract(body, '"([^"]*)"', 1), F.lit("[" + separator + "]"))
    out = replies.select("symbol", *((F.get(parts, k) if n == "name" else F.get(parts, k).try_cast("double")).alias(n) for n, k in places.items())).filter("close > 0")
    before = F.coalesce(F.when(F.col("prev_close") > 0, F.col("prev_close")), F.col("close"))
    return out.withColumn("prev_close", before).withColumn("change_pct", 100 * (F.col("close") / F.col("prev_close") - 1))
