"""The table of queries, and pieces of SQL that their checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return register


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded half up by plain arithmetic, which both engines do alike; no negative zero."""
    scale = 10.0**digits
    return F.floor((F.col(x) if isinstance(x, str) else x) * scale + 0.5) / scale


def shown(frame: DataFrame, *columns: str, keys: tuple[str, ...] = ("symbol", "date"), digits: int = 6) -> DataFrame:
    return frame.select(*keys, *(rounded(c, digits).alias(c) for c in columns))


# --- SQL -----------------------------------------------------------------------------------------

WEEK = """
ticks AS (
  SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS price,
         l_quantity, l_extendedprice,
         row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pos
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (
  SELECT symbol, date, arg_min(price, pos) AS open, max(price) AS high, min(price) AS low, arg_max(price, pos) AS close,
         CAST(sum(l_quantity) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS amount
  FROM ticks GROUP BY 1, 2)"""


def events_sql(by: str = "event_type", unit: str = "hour") -> str:
    kind = "DATE" if unit == "day" else "TIMESTAMP"
    return f"""
ticks AS (SELECT CAST({by} AS VARCHAR) AS symbol, CAST(date_trunc('{unit}', ts) AS {kind}) AS date, value AS price, row(ts, event_id) AS pos FROM events),
bars AS (
  SELECT symbol, date, arg_min(price, pos) AS open, max(price) AS high, min(price) AS low, arg_max(price, pos) AS close,
         CAST(count(*) AS DOUBLE) AS volume, CAST(sum(CAST(price AS DECIMAL(18, 6))) AS DOUBLE) AS amount
  FROM ticks GROUP BY 1, 2)"""


def w(n: int | str, end: str = "CURRENT ROW") -> str:
    """The last n rows of the symbol."""
    start = "UNBOUNDED PRECEDING" if n == "all" else f"{n - 1} PRECEDING"
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {start} AND {end})"


def prev(n: int) -> str:
    """The n rows before the current one."""
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def full(n: int, value: str, column: str, frame: str | None = None, least: int | None = None) -> str:
    frame = frame or w(n)
    return f"(CASE WHEN count({column}) OVER {frame} >= {least or n} THEN {value} OVER {frame} END)"


def lagged(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY date)"


def led(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER (PARTITION BY symbol ORDER BY date)"


def r(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5::DOUBLE) / 1e{digits}"


def numbered(source: str = "bars", name: str = "x") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM {source})"


def ewm(name: str, source: str, column: str, alpha: float | str) -> str:
    """A recursive CTE ``name`` (symbol, rn, y, wt) of the average of ``column`` in ``source`` (symbol, rn, ...)."""
    a = f"CAST({alpha} AS DOUBLE)"
    return f"""{name} AS (
  SELECT symbol, rn, CAST({column} AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS wt FROM {source} WHERE rn = 1
  UNION ALL
  SELECT s.symbol, s.rn,
         CASE WHEN s.{column} IS NULL THEN e.y WHEN e.y IS NULL THEN s.{column} ELSE (e.wt * (1 - {a}) * e.y + {a} * s.{column}) / (e.wt * (1 - {a}) + {a}) END,
         CASE WHEN s.{column} IS NULL THEN e.wt * (1 - {a}) ELSE 1 END
  FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)"""
