"""Lists of symbols out of files and tables, and bars that lie as CSV by symbol."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings in the order in which a file is tried; the last one reads anything.
ENCODINGS = ("utf-8", "gbk", "gb18030", "latin-1")
#: Rows that a cached file needs to count.
LEAST_ROWS = 10
PRICES = ("open", "high", "low", "close", "volume")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes of an encoding that nobody tells."""

    def one(raw: bytes) -> str:
        for name in ENCODINGS:
            try:
                return bytes(raw).decode(name)
            except UnicodeDecodeError:
                continue
        return ""

    return content.map(one)


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, line) of text files of any encoding, one file after another by name; places count from 1."""
    files = spark.read.format("binaryFile").load(path).select("path", decoded("content").alias("text"))
    text = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "\n\\z", "")
    files = files.select("path", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n")).alias("lines"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    sizes = files.select("path", F.size("lines").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("path", "before")
    lines = files.join(sizes, "path").select("before", F.posexplode("lines").alias("at", "line"))
    return lines.select((F.col("before") + F.col("at") + 1).alias("place"), F.ltrim(F.replace("line", F.lit("\ufeff"), F.lit(""))).alias("line"))


def classified(lines: DataFrame) -> DataFrame:
    """(place, code, symbol, market, reason): the first word of each line as a symbol, or why it is none.

    Exported lists write bare codes: six digits by their board (92.... is of
    Shanghai here, unlike in normalise_symbol), five digits of Hong Kong, up to
    five capitals of the US, and the exchange in front of a code.
    """
    line = F.trim(F.regexp_replace("line", "[\\s\\u3000]+", " "))
    code = F.substring_index(line, " ", 1)
    six, five = F.rlike(code, F.lit("^[0-9]{6}$")), F.rlike(code, F.lit("^[0-9]{5}$"))
    front = F.rlike(code, F.lit("^(SH|SZ|BJ)"))
    board = F.when(F.rlike(code, F.lit("^[69]")), ".SH").when(F.rlike(code, F.lit("^[03]")), ".SZ").when(F.rlike(code, F.lit("^[48]")), ".BJ")
    symbol = (
        F.when(front, F.concat(F.substring(F.upper(code), 3, 100), F.lit("."), F.substring(code, 1, 2)))
        .when(six, F.concat(code, board))
        .when(five, F.concat(code, F.lit(".HK")))
        .when(F.rlike(code, F.lit("^[A-Z]{1,5}$")), F.concat(code, F.lit(".US")))
    )
    heading = F.startswith(line, F.lit("代码"))
    symbol = F.when(~heading, symbol)
    reason = F.when(line == "", "blank").when(heading, "heading").when(six & board.isNull(), "no such board").when(symbol.isNull(), "not a symbol")
    market = F.when(F.endswith(symbol, F.lit(".HK")), "HK").when(F.endswith(symbol, F.lit(".US")), "US").when(symbol.isNotNull(), "A")
    return lines.select("place", F.nullif(code, F.lit("")).alias("code"), symbol.alias("symbol"), market.alias("market"), reason.alias("reason"))


def pool_words(lines: DataFrame) -> DataFrame:
    """(place, symbol) of a frozen pool: words between blanks and commas, less what follows a #."""
    words = F.filter(F.split(F.regexp_replace(F.substring_index("line", "#", 1), "[,\\s]+", " "), " "), lambda w: w != "")
    out = lines.select("place", F.posexplode(words).alias("turn", "symbol"))
    return out.select((F.col("place").cast("long") * 1_000_000 + F.col("turn")).alias("place"), "symbol")


def united(*lists: DataFrame) -> DataFrame:
    """(source, place, symbol) of several lists (place, symbol): a symbol stays where it is first, by the list's turn and its place."""
    rows = None
    for turn, listed in enumerate(lists):
        own = listed.select(F.lit(turn).alias("source"), F.col("place").cast("long").alias("place"), "symbol").filter("symbol is not null")
        rows = own if rows is None else rows.unionByName(own)
    first = rows.groupBy("symbol").agg(F.min(F.struct("source", "place")).alias("at"))
    return first.select("at.source", "at.place", "symbol")


def resolved(spec: str, spark: SparkSession, watched: DataFrame | None = None, held: DataFrame | None = None, market: DataFrame | None = None, top: int = 100) -> DataFrame:
    """(source, place, symbol) of what a user names: ``file:path``, ``watchlist``, ``portfolio``, ``both``, a market, or symbols between commas.

    watched, held: place, symbol; market: symbol, market, amount, of which the
    ``top`` largest amounts are taken.  An empty file is an error, as a missing
    one is.
    """
    spec = spec.strip()
    if spec.lower().startswith("file:"):
        found = pool_words(file_lines(spark, spec[5:].strip().strip("\"'")))
        if not found.limit(1).count():
            raise ValueError(f"no symbols in {spec[5:]}")
        return united(found)
    if spec in ("watchlist", "portfolio", "both"):
        return united(*{"watchlist": (watched,), "portfolio": (held,), "both": (watched, held)}[spec])
    if spec.upper() in ("A", "HK", "US", "CRYPTO"):
        best = market.filter(F.col("market") == spec.upper()).orderBy(F.col("amount").desc_nulls_last(), "symbol").limit(top)
        return united(best.withColumn("place", F.row_number().over(Window.orderBy(F.col("amount").desc_nulls_last(), "symbol"))))  # ``top`` rows
    names = [s.strip() for s in spec.split(",") if s.strip()]
    return united(spark.createDataFrame(list(enumerate(names)), "place int, symbol string"))


def cached_bars(spark: SparkSession, folder: str, frequency: str) -> DataFrame:
    """symbol, ts and prices of ``<folder>/<frequency>/<symbol>.csv``: time first, then columns in any order, their names in either case.

    Files that lack a column or have fewer than LEAST_ROWS rows give none.
    """
    files = spark.read.option("pathGlobFilter", "*.csv").text(f"{folder.rstrip('/')}/{frequency}", wholetext=True).withColumn("symbol", F.regexp_extract(F.input_file_name(), "([^/]+)[.]csv$", 1))
    lines = F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: F.trim(x) != "")
    rows = files.select("symbol", lines.alias("lines")).withColumn("head", F.transform(F.split(F.lower(F.get("lines", F.lit(0))), ","), lambda x: F.trim(x)))
    whole = F.forall(F.array(*map(F.lit, PRICES)), lambda n: F.array_contains("head", n))
    rows = rows.filter(whole & (F.size("lines") > LEAST_ROWS)).select("symbol", "head", F.explode(F.slice("lines", 2, F.size("lines") - 1)).alias("line"))
    cells = F.split("line", ",")

    def price(name: str) -> Column:
        return F.get(cells, F.array_position("head", name) - 1).try_cast("double").alias(name)

    return rows.select("symbol", F.try_to_timestamp(F.get(cells, F.lit(0))).alias("ts"), *map(price, PRICES)).filter("ts is not null")
