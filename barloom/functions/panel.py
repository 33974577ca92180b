"""Windows over a long panel (symbol, date, ...) and the guards that rolling statistics need."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def in_order() -> WindowSpec:
    """A symbol's rows by date."""
    return Window.partitionBy("symbol").orderBy("date")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def same_date() -> WindowSpec:
    return Window.partitionBy("date")


def rows(first: int, last: int) -> WindowSpec:
    return in_order().rowsBetween(first, last)


def last_n(n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return rows(1 - n, 0)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def over_full(n: int, value: Column, *inputs: Column | str, frame=None, least: int | None = None) -> Column:
    """``value`` over the last n rows, null until ``least`` (n) rows of the frame have all inputs."""
    frame = frame or last_n(n)
    seen = F.count(F.when(_all_known(inputs), 1)).over(frame)
    return F.when(seen >= (n if least is None else least), value.over(frame))


def _all_known(inputs: tuple[Column | str, ...]) -> Column:
    known = col(inputs[0]).isNotNull()
    for x in inputs[1:]:
        known = known & col(x).isNotNull()
    return known


def lag(x: Column | str, n: int = 1) -> Column:
    return F.lag(col(x), n).over(in_order())


def lead(x: Column | str, n: int = 1) -> Column:
    return F.lead(col(x), n).over(in_order())


def ffill(x: Column | str) -> Column:
    return F.last(col(x), ignorenulls=True).over(so_far())


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def holds(condition: Column) -> Column:
    """A comparison with null is false."""
    return F.coalesce(condition, F.lit(False))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rolling_corr(a: str, b: str, n: int, least: int | None = None) -> Column:
    """Pearson correlation over the last n rows, null where a side is constant (corr() would raise)."""
    pair = _all_known((a, b))
    x, y = F.when(pair, F.col(a)), F.when(pair, F.col(b))
    frame = last_n(n)
    spread = F.stddev_pop(x).over(frame) * F.stddev_pop(y).over(frame)
    value = F.try_divide(F.covar_pop(x, y).over(frame), spread)
    return F.when(F.count(F.when(pair, 1)).over(frame) >= (n if least is None else least), value)


def grouped_corr(a: Column, b: Column) -> Column:
    """The same as an aggregate."""
    pair = a.isNotNull() & b.isNotNull()
    x, y = F.when(pair, a), F.when(pair, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def average_rank(x: str, *by: str) -> Column:
    """Rank of x within ``by``, ties averaged; null stays null.  Needs no second pass: the rank of a tie is its smallest plus half its size less one."""
    group = Window.partitionBy(*by)
    first = F.rank().over(group.orderBy(F.col(x).asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(F.col(x).isNotNull(), first + (ties - 1) / 2)
