"""Connectors of quote services as a Spark data source, with failover and the reasons of failures as rows.

A connector says what it can do for which markets, what packages it needs and
how it fetches; a registry holds them by name.  :func:`enable` makes the
registry a format::

    enable(spark, registry, "services")
    spark.read.format("services").option("symbols", "AAPL.US,600519.SH").load().filter("market = 'US' and date >= '2024-01-01'")

Markets and dates in a filter reach the reader: partitions of other markets are
not made, and connectors are asked for the days only.  Each partition is at most
SYMBOLS symbols of one market, tried connector by connector: what one gives is
kept, the symbols that it lacks go to the next.
"""

from __future__ import annotations

import datetime as dt
import importlib.util
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

CAPABILITIES = ("bars", "snapshot", "spot", "batch")
#: Symbols of a partition.
SYMBOLS = 60
SCHEMA = "market string, symbol string, date date, open double, high double, low double, close double, volume double, source string, fault string"

#: (symbols, market, first, last) to rows (symbol, date, open, high, low, close, volume).
Fetch = Callable[[Sequence[str], str, dt.date, dt.date], Iterable[tuple]]


class AllSourcesFailed(RuntimeError):
    """No connector gave anything; ``errors`` has the reason of each."""

    def __init__(self, market: str, capability: str, errors: dict[str, str]):
        super().__init__(f"no source gave {capability} of {market}: " + ("; ".join(f"{k}: {v}" for k, v in errors.items()) or "there is none"))
        self.market, self.capability, self.errors = market, capability, errors


@dataclass(frozen=True)
class Connector:
    """``fetch`` by capability; ``only`` narrows the markets of a capability; a lower ``priority`` is tried earlier."""

    name: str
    markets: frozenset[str]
    fetch: dict[str, Fetch]
    priority: int = 50
    requires: tuple[str, ...] = ()
    only: dict[str, frozenset[str]] = field(default_factory=dict)

    def capabilities(self) -> list[str]:
        return [c for c in CAPABILITIES if c in self.fetch]

    def installed(self) -> bool:
        """Whether the packages that it needs can be found."""

        def found(package: str) -> bool:
            try:
                return importlib.util.find_spec(package) is not None
            except (ImportError, ValueError):
                return False

        return all(map(found, self.requires))

    def supports(self, market: str, capability: str) -> bool:
        return capability in self.fetch and market in self.only.get(capability, self.markets)


class Registry:
    def __init__(self) -> None:
        self.connectors: dict[str, Connector] = {}

    def register(self, connector: Connector) -> Connector:
        """Add it, in place of one of the same name."""
        self.connectors[connector.name] = connector
        return connector

    def ranked(self, market: str, capability: str, prefer: Sequence[str] = (), health: dict[tuple[str, str], bool] | None = None) -> list[Connector]:
        """Those that can and whose packages are there: preferred ones in their order, then by health (well, untried, failed), priority and name."""
        turn = {True: 0, None: 1, False: 2}
        wish = {name: k for k, name in enumerate(prefer)}
        able = [c for c in self.connectors.values() if c.supports(market, capability) and c.installed()]
        return sorted(able, key=lambda c: (wish.get(c.name, len(wish)), turn[(health or {}).get((c.name, market))], c.priority, c.name))

    def table(self, spark: SparkSession) -> DataFrame:
        """name, market, capability, priority, installed: a row for each that a connector supports."""
        rows = [(c.name, m, k, c.priority, c.installed()) for c in self.connectors.values() for k in c.capabilities() for m in sorted(c.only.get(k, c.markets))]
        return spark.createDataFrame(rows, "name string, market string, capability string, priority int, installed boolean")


def fetched(chain: Sequence[Connector], market: str, symbols: Sequence[str], first: dt.date, last: dt.date, capability: str = "bars") -> tuple[list[tuple], dict[str, str], list[str]]:
    """Rows with their connector's name, the reasons of those that gave nothing, and the symbols that none knew."""
    rows: list[tuple] = []
    errors: dict[str, str] = {}
    left = list(dict.fromkeys(symbols))
    for connector in chain:
        if not left:
            break
        try:
            own = [r for r in connector.fetch[capability](left, market, first, last) if r[0] in left and first <= r[1] <= last]
        except Exception as error:  # whatever a service does, the next one is tried
            errors[connector.name] = f"{type(error).__name__}: {error}"[:200]
            continue
        if not own:
            errors[connector.name] = "gave nothing"
        rows += [(*r, connector.name) for r in own]
        known = {r[0] for r in own}
        left = [s for s in left if s not in known]
    return rows, errors, left


@dataclass
class _Part(InputPartition):
    market: str
    symbols: list[str]
    first: dt.date
    last: dt.date


class _Reader(DataSourceReader):
    def __init__(self, registry: Registry, options: dict[str, str], market_of: Callable[[str], str]):
        symbols = [s.strip() for s in options.get("symbols", "").split(",") if s.strip()]
        self.by_market: dict[str, list[str]] = {}
        for symbol in dict.fromkeys(symbols):
            self.by_market.setdefault(market_of(symbol), []).append(symbol)
        self.prefer = [s for s in options.get("prefer", "").split(",") if s]
        self.raises = options.get("failures", "rows") == "raise"
        self.registry = registry
        self.markets: set[str] | None = None
        self.first, self.last = dt.date(1970, 1, 1), dt.date(2999, 12, 31)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Markets and dates narrow what is asked for; all filters stay with Spark but those on the market."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and len(f.attribute) == 1 else None
            if column == "market" and isinstance(f, EqualTo | In):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.markets = asked if self.markets is None else self.markets & asked
                continue
            if column == "date" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.first = max(self.first, f.value + dt.timedelta(days=isinstance(f, GreaterThan)))
            if column == "date" and isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                self.last = min(self.last, f.value - dt.timedelta(days=isinstance(f, LessThan)))
            yield f

    def partitions(self) -> list[_Part]:
        return [_Part(m, s[k : k + SYMBOLS], self.first, self.last) for m, s in self.by_market.items() if self.markets is None or m in self.markets for k in range(0, len(s), SYMBOLS)]

    def read(self, part: _Part) -> Iterator[tuple]:
        chain = self.registry.ranked(part.market, "bars", self.prefer)
        rows, errors, left = fetched(chain, part.market, part.symbols, part.first, part.last)
        if self.raises and not rows:
            raise AllSourcesFailed(part.market, "bars", errors)
        for symbol, day, o, h, low, c, v, source in rows:
            yield part.market, symbol, day, o, h, low, c, v, source, None
        for symbol in left:  # a symbol without bars keeps a row for each reason
            for source, reason in (errors or {None: "no source knows it" if chain else "there is no source"}).items():
                yield part.market, symbol, None, None, None, None, None, None, source, reason


def market_of(symbol: str) -> str:
    """A, HK, US or CRYPTO by a symbol's ending, else an empty text."""
    ending = symbol.rpartition(".")[2]
    return {"SH": "A", "SZ": "A", "BJ": "A", "HK": "HK", "US": "US", "NY": "US", "NQ": "US"}.get(ending, "") if "." in symbol else "CRYPTO" if "-" in symbol else ""


def enable(spark: SparkSession, registry: Registry, name: str = "services", market: Callable[[str], str] = market_of) -> None:
    """Make the registry a format of ``spark.read``.

    Options: ``symbols`` (separated by commas), ``prefer`` (names of connectors),
    ``failures`` (``rows``, or ``raise`` where no connector of a partition gave
    anything).
    """

    class Services(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(registry, dict(self.options), market)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Services)


def parquet_connector(name: str, path: str, markets: Iterable[str], priority: int = 50) -> Connector:
    """Bars that lie as Parquet (symbol, date, open, high, low, close, volume) wherever pyarrow reads; it reads the symbols and days asked for."""

    def bars(symbols: Sequence[str], market: str, first: dt.date, last: dt.date) -> Iterator[tuple]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        table = ds.dataset(inner, filesystem=system, format="parquet").to_table(columns=["symbol", "date", "open", "high", "low", "close", "volume"], filter=ds.field("symbol").isin(list(symbols)) & (ds.field("date") >= first) & (ds.field("date") <= last))
        return zip(*(c.to_pylist() for c in table.columns), strict=True)

    return Connector(name, frozenset(markets), {"bars": bars}, priority)
