"""Runs SQL over the parquet tables of a folder and compares rows, whatever their order."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(value):
    """Floats to nine significant digits, and whole ones as integers, so that int and double columns compare."""
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, int | float | Decimal):
        value = float(value)
        return "None" if math.isnan(value) else f"{value + 0.0:.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(" ")
    return str(value)


def rows(names: list[str], records) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


def spark_rows(frame: DataFrame) -> tuple[list[str], list[tuple[str, ...]]]:
    return sorted(frame.columns), rows(frame.columns, frame.collect())


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple[str, ...]]]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return sorted(names), rows(names, found.fetchall())
