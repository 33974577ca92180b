"""Every query of the package, by name."""

from __future__ import annotations

from barloom.plans import backtests, bars, evaluate, models, operations, reviews, signals, sources, stores, technical, training
from barloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "backtests", "bars", "evaluate", "models", "operations", "reviews", "signals", "sources", "stores", "technical", "training"]
