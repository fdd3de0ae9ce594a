"""Change reports kept up to date batch by batch, without reading the history again.

``path/state`` holds the newest snapshots of every company (the latest and its
archives), in partitions by hash of the company. A batch reads the partitions
of its companies, pairs its snapshots with their neighbours there and writes
the partitions anew. ``path/reports`` gets a report for every pair the batch
changes, also when it has no changes: a late snapshot between two stored ones
takes the place of the older pair. Both are batch tables (see ``store``):
a batch that is repeated, or retried after a crash, gives the same result.

A snapshot stored again with the same company and time replaces the stored
one. One older than all archives of a company whose archive is full would be
pruned at once and is left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType, TimestampType

from moatlens.functions import lexicons as L
from moatlens.operators import changes, snapshots, store
from moatlens.session import ensure_checkpoint_dir

BUCKETS = 64
_PART = "bucket"


def _bucketed(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(_PART, IntegerType())])


def _report_schema(key: str, ts) -> StructType:
    reports = StructType.fromDDL(f"{key} string, detected_at timestamp, compared_with timestamp, "
                                 "changes array<struct<feature:string,message:string>>, stale_features array<string>, bucket int")
    for at in ("detected_at", "compared_with"):
        reports[at].dataType = ts
    return reports


def _written(rows: DataFrame) -> DataFrame:
    path = f"{ensure_checkpoint_dir(rows.sparkSession)}/moatlens-batch-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def update(snaps: DataFrame, path: str, batch: str, archives: int = L.MAX_SNAPSHOT_ARCHIVES, key: str = "company", ts: str = "snapshot_ts",
           features=snapshots.FEATURES, buckets: int = BUCKETS) -> bool:
    """Take a batch of snapshots into state and reports; False if it is there already."""
    spark = snaps.sparkSession
    if store.is_committed(spark, f"{path}/state", batch):
        return False
    schema = snaps.select(key, ts, *features).schema
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    # written once: every branch below sees the same rows
    rows = snaps.select(*schema.names, bucket.alias(_PART)).filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    new = _written(rows)
    if not new.groupBy(key, ts).count().filter("count > 1").isEmpty():
        new = _written(snapshots.one_per(new, [key, ts]))
    touched = [r[0] for r in new.select(_PART).distinct().collect()]  # ``buckets`` numbers at most

    stored = store.read(spark, f"{path}/state", _bucketed(schema), _PART).filter(F.col(_PART).isin(touched))
    full = stored.groupBy(key).agg(F.count("*").alias("_n"), F.min(ts).alias("_oldest")).filter(F.col("_n") > archives)
    new = new.join(full, key, "left").filter(F.coalesce(F.col(ts) >= F.col("_oldest"), F.lit(True))).select(*schema.names, _PART)
    old = stored.select(*schema.names, _PART).join(new.select(key, ts), [key, ts], "left_anti")
    merged = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))

    pairs = snapshots.with_previous(merged.join(new.select(key).distinct(), key, "left_semi"), key, ts, (*features, "_new"))
    pairs = pairs.filter(F.col("compared_with").isNotNull() & (F.col("_new") | F.col("prev__new")))
    report = changes.report_of_pairs(pairs, key, ts, features).withColumn(_PART, bucket)
    store.append(report, f"{path}/reports", batch, _PART)
    state = snapshots.retention(merged.drop("_new"), archives, key, ts)
    return store.append(state, f"{path}/state", batch, _PART, store.partitions(stored, _PART))


def reports(spark: SparkSession, path: str, key: str = "company", ts_type=None) -> DataFrame:
    """The reports with changes: of several for one snapshot the last one written."""
    schema = _report_schema(key, ts_type or TimestampType())
    rows = store.read(spark, f"{path}/reports", schema, _PART)
    last = Window.partitionBy(key, "detected_at").orderBy(F.col("seq").desc())
    rows = rows.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") == 1)
    return rows.filter(F.size("changes") > 0).select(*[c for c in schema.names if c != _PART])
