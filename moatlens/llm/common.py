"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moatlens.session import ensure_checkpoint_dir

#: ASCII white space between words: space and U+0009 to U+000D.
WS_CHARS = " \t\n\x0b\x0c\r"
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only when a written table has at most so many rows.
BROADCAST_ROWS = 500_000
#: Ways a key is split by the salted join that serves larger lookup tables.
SALTS = 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/moatlens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table has at most ``rows`` rows (read from its footers)."""
    return table.count() <= rows


def semi(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (a written table of distinct keys).

    Broadcasts ``ids`` only when they are few; else a shuffled semi join.
    """
    side = F.broadcast(ids) if is_small(ids) else ids
    return df.join(side, on, "left_semi")


def anti(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids`` (a written table of distinct keys)."""
    side = F.broadcast(ids) if is_small(ids) else ids
    return df.join(side, on, "left_anti")


def lookup(df: DataFrame, table: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """Left join of a lookup ``table`` (written, one row per key, null keys match null).

    A table of at most BROADCAST_ROWS rows is broadcast. A larger one is joined
    by shuffle with every key split ``SALTS`` ways by the hash of ``spread``, so
    that a key holding a third of all rows still spans many tasks.
    """
    renamed = table.select(*[F.col(k).alias(f"__{k}") for k in keys],
                           *[c for c in table.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    drop = [f"__{k}" for k in keys]
    if is_small(table):
        return df.join(F.broadcast(renamed), cond, "left").drop(*drop)
    left = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    right = renamed.withColumn("__rsalt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    cond.append(F.col("__salt") == F.col("__rsalt"))
    return left.join(right, cond, "left").drop(*drop, "__salt", "__rsalt")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body`` (also in lambdas)."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text (null: none) as an array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS)))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
