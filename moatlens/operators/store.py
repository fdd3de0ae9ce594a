"""Tables that grow by batches and survive killed or repeated jobs.

Every attempt at a batch writes a folder of its own, partitioned by one column,
``data/batch=<id>/attempt=<id>``. The batch counts once its marker is in
``commits``: a single small file, the last thing an append writes, which names
the attempt. Readers read what the markers name, so

- a job killed half-way leaves a folder nobody reads, and the next attempt
  takes nothing away that a reader may have open;
- a batch that is appended again changes nothing.

A marker may also name partitions of earlier batches that its batch replaces.
Pruning and other maintenance write the rows that stay as a new batch and hide
the old partitions with the same one file, so that no reader ever sees both or
neither. Partitions that lose nothing keep their files. ``vacuum`` later
deletes the files of hidden partitions and of attempts that failed.

Appends to one table come one after the other (one writer); readers may run at
any time.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

COMMIT = "batch string, attempt string, seq long, old_batch string, old_part string"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(batch, attempt, seq, old_batch, old_part): a row per batch in order of appends, and per partition it replaces."""
    try:
        return spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def is_committed(spark: SparkSession, path: str, batch: str) -> bool:
    return not commits(spark, path).filter(F.col("batch") == batch).isEmpty()


def write_batch(df: DataFrame, path: str, batch: str, part: str) -> str:
    """The rows of a batch, not visible before ``commit``; the name of this attempt."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"batch id {batch!r} does not name a folder")
    attempt = uuid.uuid4().hex
    df.write.partitionBy(part).parquet(f"{path}/data/batch={batch}/attempt={attempt}")
    return attempt


def commit(spark: SparkSession, path: str, batch: str, attempt: str, replaces: DataFrame | None = None) -> None:
    """Make an attempt at a batch visible and the partitions ``replaces(old_batch, old_part)`` invisible, in one file."""
    seq = commits(spark, path).agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0]
    rows = spark.createDataFrame([(None, None)], "old_batch string, old_part string")
    if replaces is not None:
        rows = rows.unionByName(replaces.select("old_batch", "old_part"))
    rows = rows.select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), F.lit(seq).cast("long").alias("seq"), "old_batch", "old_part")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{batch}")


def append(df: DataFrame, path: str, batch: str, part: str, replaces: DataFrame | None = None) -> bool:
    """Append a batch once; False if it is there already."""
    spark = df.sparkSession
    if is_committed(spark, path, batch):
        return False
    commit(spark, path, batch, write_batch(df, path, batch, part), replaces)
    return True


def read(spark: SparkSession, path: str, schema: StructType, part: str) -> DataFrame:
    """Rows of all committed batches without replaced partitions: ``schema``, ``batch`` and ``seq``."""
    log = commits(spark, path)
    own = [StructField("batch", StringType()), StructField("attempt", StringType())]
    full = StructType([*schema.fields, *own])
    live = log.select("batch", "attempt", "seq").distinct()
    folders = [f"{path}/data/batch={r.batch}/attempt={r.attempt}" for r in live.collect()]  # a name per append
    if not folders:
        return spark.createDataFrame([], StructType([*schema.fields, own[0]])).withColumn("seq", F.lit(0).cast("long"))
    data = spark.read.schema(full).option("basePath", f"{path}/data").parquet(*folders)
    gone = log.filter(F.col("old_batch").isNotNull()).select(F.col("old_batch").alias("_batch"), F.col("old_part").alias("_old")).distinct()
    # both sides list folders; without the hint few folders make a shuffle of all rows to as few tasks
    rows = data.join(F.broadcast(gone), [F.col("batch") == F.col("_batch"), F.col("_old").eqNullSafe(F.col(part).cast("string"))], "left_anti")
    return rows.join(F.broadcast(live.select("batch", "seq")), "batch").select(*schema.names, "batch", "seq")


def partitions(rows: DataFrame, part: str) -> DataFrame:
    """(old_batch, old_part) of the partitions that hold ``rows`` of ``read``."""
    return rows.select(F.col("batch").alias("old_batch"), F.col(part).cast("string").alias("old_part")).distinct()


def prune(spark: SparkSession, path: str, schema: StructType, part: str, batch: str, keep: int, key: str, order: str) -> bool:
    """Keep the newest ``keep`` rows of every key; False if ``batch`` was committed before.

    Only partitions that lose rows are rewritten. Rows that repeat key, order
    and batch stand or fall together; rows without a key stay.
    """
    if is_committed(spark, path, batch):
        return False
    kept, hit = pruned(read(spark, path, schema, part), part, keep, key, order)
    attempt = write_batch(kept.select(*schema.names), path, batch, part)
    commit(spark, path, batch, attempt, hit)
    return True


def pruned(rows: DataFrame, part: str, keep: int, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` of ``read``: what stays of the partitions that lose some, and these partitions.

    A key's border is the oldest row it keeps, found by a top-k before any
    shuffle; only keys with a full archive have one.
    """
    at = F.struct(F.col(order), F.col("seq"))
    newest = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("seq").desc())
    top = rows.select(key, order, "seq").withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= keep)
    border = top.groupBy(key).agg(F.min(at).alias("_border"), F.count("*").alias("_n")).filter(F.col("_n") == keep).select(key, "_border").hint("merge")
    lost = F.coalesce(at < F.col("_border"), F.lit(False))
    hit = partitions(rows.select(key, order, "batch", "seq", part).join(border, key).filter(lost), part)
    there = [rows["batch"] == hit["old_batch"], rows[part].cast("string").eqNullSafe(hit["old_part"])]
    # few partitions: sent to all tasks, or a shuffle by partition would gather a partition's rows in one task
    kept = rows.join(F.broadcast(hit), there, "left_semi").join(border, key, "left").filter(~lost)
    return kept, hit


def vacuum(spark: SparkSession, path: str, part: str) -> int:
    """Delete what readers that start from now on don't look for; how many folders that were."""
    jvm, log = spark.sparkContext._jvm, commits(spark, path)
    attempts = {r.batch: r.attempt for r in log.select("batch", "attempt").distinct().collect()}

    def delete(folder) -> int:
        return int(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True))

    n = 0
    for r in log.filter(F.col("old_batch").isNotNull()).select("old_batch", "old_part").distinct().toLocalIterator():
        name = "__HIVE_DEFAULT_PARTITION__" if r.old_part is None else r.old_part
        n += delete(jvm.org.apache.hadoop.fs.Path(f"{path}/data/batch={r.old_batch}/attempt={attempts[r.old_batch]}/{part}={name}"))
    for batch, attempt in attempts.items():
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/data/batch={batch}")
        found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
        n += sum(delete(f.getPath()) for f in found if f.getPath().getName() != f"attempt={attempt}")
    return n
