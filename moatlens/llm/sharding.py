"""Sharding by rendezvous hashing over weighted shards.

Every record key is hashed together with every shard; the shard of the highest
score ``weight / -ln(u)`` takes the record. A further shard only ever takes
records into itself, about its share of the weights, and nothing else moves.
The choice is an expression of the key alone: no shuffle, and the same on every
run and cluster.

Slots number the records of a shard from 0 without gaps and without sorting a
shard in one task: equal records are counted first, records are dealt into
buckets by hash, and a bucket's offset is the sum of the buckets before it.

Defined cases: a null id is keyed by its text (a null text by nothing), so rows
without ids spread too; a null or empty text has size 1 and checksum 0; rows
that repeat an id share a shard and get slots of their own; records of equal
texts are not kept together, since the id alone decides; a shard of weight 0
takes nothing; an empty table gives no rows; extra columns pass through
``assigned``, its own are prefixed ``shard_`` and replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moatlens.llm.common import lookup, written

SHARDS = 8
SEED = "shard-1"
#: Records numbered together; a shard has as many buckets as its table needs.
BUCKET_ROWS = 1 << 16
#: Repeats of one record that become one array of slots.
REPEATS = 1 << 16

#: What identifies a record among those of its shard, in the order that slots follow.
RECORD = ["shard_key", "shard_size", "shard_crc32", "shard", "shard_grown"]


def _score(key: Column, shard: int, weight: float, seed: str) -> Column:
    """Rendezvous score; u lies strictly between 0 and 1, from 52 bits of a portable hash."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{shard}:"), key)), 1, 13), 16, 10).cast("double")
    return F.lit(float(weight)) / -F.log((bits + 0.5) / F.lit(float(1 << 52)))


def choose(key: Column, weights: Sequence[float], seed: str = SEED) -> Column:
    """The shard that takes a key: highest score, ties to the smaller shard."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one at least positive")
    scores = [F.struct(_score(key, i, w, seed).alias("score"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]
    return (-F.array_max(F.array(*scores))["i"]).cast("int")


def assigned(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, id_col: str = "doc_id", text_col: str = "text",
             grown: float = 1.0, seed: str = SEED) -> DataFrame:
    """Every row with shard, shard_grown (with one more shard of weight ``grown``), shard_key, shard_size and shard_crc32."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.concat(F.lit("t"), text))
    out = docs.withColumn("shard_key", F.md5(key)).withColumn("shard_size", F.octet_length(text).cast("long") + 1)
    out = out.withColumn("shard_crc32", F.crc32(text.cast("binary")))
    out = out.withColumn("shard", choose(F.col("shard_key"), weights, seed))
    return out.withColumn("shard_grown", choose(F.col("shard_key"), [*weights, grown], seed))


def slots(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """RECORD, ``by`` and ``shard_slot`` of every row of ``assigned``.

    ``by`` are further narrow columns to keep. Rows equal in all of these are
    counted before the shuffle and get consecutive slots.
    """
    keys = [*RECORD, *by]
    n = written(records.groupBy(*keys).agg(F.count("*").alias("shard_n")), "shard-records")
    buckets = max(1, -(-n.count() // BUCKET_ROWS))
    n = n.withColumn("shard_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("shard_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = n.groupBy("shard", "shard_bucket").agg(F.sum("shard_n").alias("sum"))  # a row per shard and bucket
    offset = F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("shard_offset")
    offsets = written(sums.select("shard", "shard_bucket", offset), "shard-offsets")
    inside = Window.partitionBy("shard", "shard_bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    first = n.withColumn("shard_before", F.coalesce(F.sum("shard_n").over(inside), F.lit(0)))
    first = lookup(first, offsets, ["shard", "shard_bucket"], F.col("shard_key"))
    start, many = F.col("shard_before") + F.col("shard_offset"), F.col("shard_n")
    # a record repeated very often becomes runs, spread before they are written out row by row
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((many - 1) / REPEATS)))
    runs = first.select(*keys, start.alias("shard_start"), many, run.alias("shard_run"))
    first = F.col("shard_start") + F.col("shard_run") * REPEATS
    last = F.least(first + REPEATS, F.col("shard_start") + many) - 1
    return runs.select(*keys, F.explode(F.sequence(first, last)).alias("shard_slot"))


def write(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS, **how) -> None:
    """The rows as Parquet, a folder per shard; nothing is shuffled."""
    own = [c for c in RECORD if c != "shard"]
    assigned(docs, weights, **how).drop(*own).write.partitionBy("shard").parquet(path)
