"""Plans: the load of source files and the queries of the driver's tables."""

from quarry.plans import domain, lists, loads, series, texts
from quarry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "domain", "lists", "loads", "series", "texts"]
