"""All queries of the library outside the optional training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the DuckDB statement that gives the same rows."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def load() -> None:
    from scoreloom.plans import chain_queries, contract_queries, data_queries, gate_queries, layout_queries, metric_queries, model_queries, reach_queries, stream_queries, text_queries  # noqa: F401
