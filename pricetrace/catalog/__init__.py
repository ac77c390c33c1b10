"""Registered queries: every operator bound to the given tables, with the SQL its result is checked against."""

from pricetrace.catalog import articles, jobs, months, pages, prices, reports, scores, sources, words  # noqa: F401
from pricetrace.catalog.registry import QUERIES, oracles

ORACLES = oracles()

__all__ = ["ORACLES", "QUERIES"]
