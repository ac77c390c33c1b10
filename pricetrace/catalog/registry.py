"""Registration of queries and assembly of their check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            CHECKS[name] = oracle
        return fn

    return register


def cte(**definitions: str) -> None:
    """Named subqueries for check SQL."""
    CTES.update(definitions)


def with_ctes(body: str) -> str:
    """Prefix `body` with the named subqueries it uses, directly or through others, in order of use."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                ordered.append(name)

    visit(body)
    if not ordered:
        return body.strip()
    parts = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in ordered)
    return f"WITH {parts}\n{body.strip()}"


def oracles() -> dict[str, str]:
    return {name: with_ctes(body) for name, body in CHECKS.items()}
