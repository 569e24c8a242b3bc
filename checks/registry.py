"""Where the checks register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.sql import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: For queries whose order counts: the columns whose sequence of values is compared, in order.
ORDERED: dict[str, list[str]] = {}


def check(
    oracle: str | None, name: str | None = None, ordered: list[str] | None = None
) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL of the same result.

    ``ordered`` names the columns by which both results are sorted: then the order counts too.

    A trailing underscore, which keeps the name apart from the operator's, is dropped.
    """

    def register(query: Query) -> Query:
        key = name or query.__name__.rstrip("_")
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = query
        if ordered is not None:
            ORDERED[key] = ordered
        if oracle is not None:
            ORACLES[key] = sql(oracle)
        return query

    return register
