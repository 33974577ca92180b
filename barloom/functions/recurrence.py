"""Recurrences along a symbol's bars: exponential averages and folds with state.

Symbols are independent, so each runs in its own group; what a group holds is
one symbol's bars.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def per_symbol(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], added: dict[str, str], by: tuple[str, ...] = ("symbol",), order: str = "date") -> DataFrame:
    """``df`` with the columns ``added`` (name: type), which ``function`` sets on each group's rows in order."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in added])
    for name, kind in added.items():
        schema = schema.add(name, kind)
    names = schema.names

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return function(frame.sort_values(order, ignore_index=True))[names]

    return df.groupBy(*by).applyInPandas(run, schema)


def ewm(df: DataFrame, averages: dict[str, tuple[str, float]], adjust: bool = False, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``df`` with exponential averages: name -> (column, alpha).

    y starts at the first value and moves by alpha towards each next one; over a
    null it stays while its weight decays, so the next value weighs more.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(**{name: frame[column].ewm(alpha=alpha, adjust=adjust).mean() for name, (column, alpha) in averages.items()})

    return per_symbol(df, run, dict.fromkeys(averages, "double"), by)


def span(n: float) -> float:
    return 2.0 / (n + 1.0)
