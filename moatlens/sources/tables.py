"""Landed input tables (parquet)."""

from __future__ import annotations

import os
import re
import weakref

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# One reader per (session, folder, table): file listing and parquet footers
# are read once, not on every query build. The entries go with their session.
_READERS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_COUNTS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_VIEWS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Column pruning and filter pushdown reach this scan."""
    own = _READERS.setdefault(spark, {})
    if (sf_dir, name) not in own:
        own[sf_dir, name] = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return own[sf_dir, name]


def row_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of an input table, from the parquet footers; counted once per session and folder."""
    own = _COUNTS.setdefault(spark, {})
    if (sf_dir, name) not in own:
        own[sf_dir, name] = table(spark, sf_dir, name).count()
    return own[sf_dir, name]


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register input tables as temp views so shared SQL text can run on them."""
    own = _VIEWS.setdefault(spark, {})
    for n in names:
        if own.get(n) != sf_dir:
            table(spark, sf_dir, n).createOrReplaceTempView(n)
            own[n] = sf_dir


def referenced(sql: str) -> list[str]:
    """Input tables named in a SQL text."""
    words = set(re.findall(r"\b[a-z_]+\b", sql.lower()))
    return [t for t in TABLES if t in words]
