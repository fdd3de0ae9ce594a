"""Key -> (query builder, oracle SQL) registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key``.

    ``oracle`` is DuckDB SQL over the same parquet tables giving the same rows
    (same column names); omitted for operators with no SQL equivalent.
    """
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def ci(pattern: str) -> str:
    """Case-insensitive RE2 pattern literal for DuckDB."""
    return q("(?i)" + pattern)
