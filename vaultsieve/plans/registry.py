"""All registered queries and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir), with the SQL that gives the same rows."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return add


from vaultsieve.plans import q_detect, q_features, q_score, q_train  # noqa: E402, F401
