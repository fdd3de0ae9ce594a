"""Snapshot history: latest, retention, stale carry-forward, sinks.

A snapshot row is one crawl of one company: ``company, snapshot_ts`` plus one
struct column per feature (``pricing``, ``messaging``, ``signals``,
``complaints``). Each feature struct carries its stale marker fields
``is_stale``, ``stale_since``, ``stale_reason``, and may carry ``attempted``:
false where no URL was found, which makes the feature stale but not listed as
such. A null struct means that the crawl did not have the feature at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from moatlens.functions import lexicons as L
from moatlens.session import ensure_checkpoint_dir

#: In the order reports list them.
FEATURES = ("pricing", "messaging", "signals", "complaints")


def one_per(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: of rows that repeat one, the last in the order of their JSON text, whatever the run."""
    order = Window.partitionBy(*keys).orderBy(F.to_json(F.struct(*rows.columns)).desc())
    return rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") == 1).drop("_rn")


def latest(snaps: DataFrame, key: str = "company", ts: str = "snapshot_ts") -> DataFrame:
    """Newest snapshot per company: those of its newest time, found in every task before the shuffle.

    Of several snapshots of the newest time one comes out (see ``one_per``,
    which needs no shuffle of its own). Rows without company or time have none.
    """
    newest = Window.partitionBy(key).orderBy(F.col(ts).desc())
    known = snaps.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    return one_per(known.withColumn("_rk", F.rank().over(newest)).filter(F.col("_rk") == 1).drop("_rk"), [key])


def retention(snaps: DataFrame, max_archives: int = L.MAX_SNAPSHOT_ARCHIVES,
              key: str = "company", ts: str = "snapshot_ts") -> DataFrame:
    """Keep the latest snapshot and the newest ``max_archives`` archives.

    ``row_number() <= k`` is planned as a per-partition top-k before the
    shuffle (WindowGroupLimit), so a company with a huge history does not
    ship it all to one task.
    """
    w = Window.partitionBy(key).orderBy(F.col(ts).desc())
    return snaps.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_archives + 1).drop("_rn")


#: Snapshots of one company that one task orders; longer histories are cut at time quantiles.
ROWS_PER_BUCKET = 1_000_000


#: Quantiles that cut a hot company's history, at least.
_CUTS = 64


def _hot(snaps: DataFrame, key: str, rows_per_bucket: int) -> DataFrame:
    """(company, count) of the companies with more snapshots than one task should order."""
    return snaps.groupBy(key).count().filter(F.col("count") > rows_per_bucket)


def bucketed(snaps: DataFrame, key: str = "company", ts: str = "snapshot_ts",
             rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``_b``: a time sub-bucket of the company's history.

    A company with more than ``rows_per_bucket`` snapshots is cut at the
    quantiles of its times, so buckets hold about as many rows each, however
    bursty the history, and as many quantiles as the longest history needs. The
    quantiles come from a mergeable sketch (one aggregate over two columns) and
    are written before use: every plan branch sees the same bounds. Other
    companies have the one bucket 0.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    hot = _hot(snaps, key, rows_per_bucket)
    most = hot.agg(F.max("count")).first()[0]
    if most is None:
        return snaps.withColumn("_b", F.lit(0).cast("long"))
    n = max(_CUTS, -(-most // rows_per_bucket))
    cuts = [i / n for i in range(1, n)]
    edges = snaps.select(key, t.alias("_t")).join(hot.select(key), key, "left_semi").groupBy(key).agg(
        F.array_distinct(F.percentile_approx("_t", cuts, F.lit(max(10_000, 20 * n)))).alias("_edges"))
    path = f"{ensure_checkpoint_dir(snaps.sparkSession)}/moatlens-buckets-{uuid.uuid4().hex}"
    edges.write.parquet(path)
    edges = snaps.sparkSession.read.schema(edges.schema).parquet(path)
    b = F.coalesce(F.size(F.filter("_edges", lambda e: t > e)), F.lit(0)).cast("long")
    b = F.when(F.col("_edges").isNull(), F.lit(0).cast("long")).otherwise(b)
    # Distribute on (company, bucket) explicitly: hash partitioning on company
    # alone would satisfy the later windows and keep a hot company in one task.
    return snaps.join(edges, key, "left").withColumn("_b", b).drop("_edges").repartition(key, "_b")


def _split(snaps: DataFrame, key: str, rows_per_bucket: int) -> tuple[DataFrame, DataFrame | None]:
    """Snapshots of companies that one window serves, and those of hot companies (None if there are none)."""
    hot = _hot(snaps, key, rows_per_bucket)
    if hot.isEmpty():
        return snaps, None
    return snaps.join(hot.select(key), key, "left_anti"), snaps.join(hot.select(key), key, "left_semi")


def with_previous(snaps: DataFrame, key: str = "company", ts: str = "snapshot_ts",
                  features=FEATURES, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Attach the previous snapshot of the same company (every consecutive pair).

    A plain ``lag`` over the company's history. The histories of hot companies
    are never one task:
    - ``lag`` runs within (company, time sub-bucket) (see ``bucketed``);
    - the first row of a bucket takes the last row of the company's nearest
      earlier bucket, from a summary with one row per (company, bucket).
    """
    cols = [ts, *features]
    plain, hot = _split(snaps, key, rows_per_bucket)
    w = Window.partitionBy(key).orderBy(ts)
    out = plain.select(*snaps.columns, F.lag(ts).over(w).alias("compared_with"), *[F.lag(c).over(w).alias(f"prev_{c}") for c in features])
    if hot is None:
        return out
    r = bucketed(hot, key, ts, rows_per_bucket)
    w = Window.partitionBy(key, "_b").orderBy(ts)
    inner = r.select("*", *[F.lag(F.col(c)).over(w).alias(f"_lag_{c}") for c in cols])
    last = r.groupBy(key, "_b").agg(F.max_by(F.struct(*cols), F.col(ts)).alias("_last"))
    carry = last.select(key, "_b", F.lag("_last").over(Window.partitionBy(key).orderBy("_b")).alias("_before"))
    paired = inner.join(carry, [key, "_b"], "left")
    first = F.col(f"_lag_{ts}").isNull()
    pick = lambda c: F.when(first, F.col(f"_before.{c}")).otherwise(F.col(f"_lag_{c}"))
    return out.unionByName(paired.select(*snaps.columns, pick(ts).alias("compared_with"), *[pick(c).alias(f"prev_{c}") for c in features]))


def _record_fields(snaps: DataFrame, f: str):
    return [c for c in snaps.schema[f].dataType.fieldNames() if c not in ("is_stale", "stale_since", "stale_reason", "attempted")]


def carry_forward(snaps: DataFrame, key: str = "company", ts: str = "snapshot_ts",
                  features=FEATURES, rows_per_bucket: int = ROWS_PER_BUCKET, first_stale: bool = False) -> DataFrame:
    """Failed features keep the previous snapshot's record, flagged stale.

    A stale feature row holds ``is_stale`` true. It takes the record of the
    snapshot just before it, which may itself have been carried: that is the
    last record that isn't stale, unless a snapshot without the feature lies
    between, which ends the chain. ``stale_since`` is the previous snapshot's
    time when that one had the feature. Else the marker stays empty.

    With ``first_stale`` every record also gets ``first_stale_since``: the time
    of the first snapshot of the run of stale ones it belongs to. A run ends
    with a snapshot that isn't stale for the feature, or hasn't got it.

    Plain windows over a company's history; those of hot companies run per
    (company, time sub-bucket), with a per-bucket summary for the rows whose
    source lies in an earlier bucket.
    """
    plain, hot = _split(snaps, key, rows_per_bucket)
    out = _carried(plain.withColumn("_b", F.lit(0).cast("long")), snaps, key, ts, features, first_stale, False)
    if hot is None:
        return out
    return out.unionByName(_carried(bucketed(hot, key, ts, rows_per_bucket), snaps, key, ts, features, first_stale, True))


def _carried(r: DataFrame, snaps: DataFrame, key: str, ts: str, features, first_stale: bool, stitched: bool) -> DataFrame:
    """``carry_forward`` of rows with a bucket ``_b``; ``stitched`` when a company has several."""
    w = Window.partitionBy(key, "_b").orderBy(ts) if stitched else Window.partitionBy(key).orderBy(ts)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    stale = {f: F.coalesce(F.col(f"{f}.is_stale"), F.lit(False)) for f in features}
    # what a stale row may take over: the record, or nothing where the feature is missing
    fresh = {f: F.when(~stale[f], F.struct(F.col(f).alias("r"))) for f in features}
    runs = features if first_stale else ()
    stale_ts = {f: F.when(stale[f], F.col(ts)) for f in runs}
    fresh_ts = {f: F.when(~stale[f], F.col(ts)) for f in runs}
    # a run begins with the first stale snapshot after the last that isn't: the earliest stale time since then
    run = {f: F.max(fresh_ts[f]).over(before) for f in runs}
    out = r.select("*", F.lag(F.col(ts)).over(w).alias("_lag_ts"),
                   *[F.lag(F.col(f)).over(w).isNotNull().alias(f"_lag_has_{f}") for f in features],
                   *[F.last(fresh[f], ignorenulls=True).over(before).alias(f"_in_{f}") for f in features],
                   *[run[f].alias(f"_ended_{f}") for f in runs])
    if runs:
        within = lambda f: (Window.partitionBy(key, "_b", f"_ended_{f}") if stitched else Window.partitionBy(key, f"_ended_{f}")).orderBy(ts)
        for f in runs:
            so_far = within(f).rowsBetween(Window.unboundedPreceding, 0)
            out = out.withColumn(f"_begun_{f}", F.min(stale_ts[f]).over(so_far))
    prev_ts, has, source = F.col("_lag_ts"), {f: F.col(f"_lag_has_{f}") for f in features}, {f: F.col(f"_in_{f}") for f in features}
    begun = {f: F.col(f"_begun_{f}") for f in runs}
    if stitched:
        out = out.join(_borders(r, key, ts, features, stale, fresh, runs), [key, "_b"], "left")
        first = F.col("_lag_ts").isNull()
        prev_ts = F.when(first, F.col("_before_ts")).otherwise(prev_ts)
        has = {f: F.when(first, F.coalesce(F.col(f"_before_has_{f}"), F.lit(False))).otherwise(has[f]) for f in features}
        source = {f: F.coalesce(source[f], F.col(f"_before_{f}")) for f in features}
        # no snapshot that isn't stale before this one in its bucket: the run may have begun in an earlier one
        begun = {f: F.when(F.col(f"_ended_{f}").isNull(), F.coalesce(F.col(f"_before_run_{f}"), begun[f])).otherwise(begun[f]) for f in runs}
    for f in features:
        tried = [F.col(f"{f}.attempted").alias("attempted")] if "attempted" in snaps.schema[f].dataType.fieldNames() else []
        since = [F.when(stale[f], begun[f]).alias("first_stale_since")] if first_stale else []
        rec = F.struct(
            *[F.when(stale[f], source[f]["r"][c]).otherwise(F.col(f"{f}.{c}")).alias(c) for c in _record_fields(snaps, f)],
            F.col(f"{f}.is_stale").alias("is_stale"),
            F.when(stale[f] & has[f], prev_ts).alias("stale_since"),
            F.col(f"{f}.stale_reason").alias("stale_reason"), *tried, *since,
        )
        out = out.withColumn(f"_out_{f}", F.when(F.col(f).isNotNull(), rec))
    return out.select(*[F.col(f"_out_{c}").alias(c) if c in features else F.col(c) for c in snaps.columns])


def _borders(r: DataFrame, key: str, ts: str, features, stale: dict, fresh: dict, runs) -> DataFrame:
    """What a bucket takes over from the company's earlier ones: a row per (company, bucket)."""
    summ = r.groupBy(key, "_b").agg(
        F.max(F.col(ts)).alias("_last_ts"),
        *[F.max_by(F.col(f).isNotNull(), F.col(ts)).alias(f"_last_has_{f}") for f in features],
        *[F.max_by(F.struct(F.col(f).alias("r")), F.when(~stale[f], F.col(ts))).alias(f"_last_fresh_{f}") for f in features],
        *[F.max(F.when(~stale[f], F.col(ts))).alias(f"_last_ended_{f}") for f in runs],
        *[F.min(F.when(stale[f], F.col(ts))).alias(f"_first_stale_{f}") for f in runs])
    # the first stale time behind the bucket's last snapshot that isn't stale: the run that is open at its end
    for f in runs:
        last = r.select(key, "_b", F.when(stale[f], F.col(ts)).alias("_t")).join(summ.select(key, "_b", f"_last_ended_{f}"), [key, "_b"])
        open_ = last.filter(F.col(f"_last_ended_{f}").isNotNull() & (F.col("_t") > F.col(f"_last_ended_{f}")))
        summ = summ.join(open_.groupBy(key, "_b").agg(F.min("_t").alias(f"_open_{f}")), [key, "_b"], "left")
    wb = Window.partitionBy(key).orderBy("_b")
    wb_before = wb.rowsBetween(Window.unboundedPreceding, -1)
    # a bucket with a snapshot that isn't stale says which run is open behind it (none, maybe); one that is stale throughout passes on
    ends = {f: F.when(F.col(f"_last_ended_{f}").isNotNull(), F.struct(F.col(f"_open_{f}").alias("t"), F.col("_b").alias("b"))) for f in runs}
    out = summ.select("*", F.lag("_last_ts").over(wb).alias("_before_ts"),
                      *[F.lag(f"_last_has_{f}").over(wb).alias(f"_before_has_{f}") for f in features],
                      *[F.last(f"_last_fresh_{f}", ignorenulls=True).over(wb_before).alias(f"_before_{f}") for f in features],
                      *[F.last(ends[f], ignorenulls=True).over(wb_before).alias(f"_end_{f}") for f in runs])
    for f in runs:
        # the first stale time of the buckets after the one that ended a run (of all earlier ones, if none did)
        since = Window.partitionBy(key, f"_end_{f}.b").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        stale_only = F.when(F.col(f"_last_ended_{f}").isNull(), F.col(f"_first_stale_{f}"))
        out = out.withColumn(f"_before_run_{f}", F.coalesce(F.col(f"_end_{f}.t"), F.min(stale_only).over(since)))
    return out.select(key, "_b", "_before_ts", *[f"_before_has_{f}" for f in features], *[f"_before_{f}" for f in features],
                      *[f"_before_run_{f}" for f in runs])


def stale_features(snaps: DataFrame, features=FEATURES) -> Column:
    """Attempted features that are stale in this snapshot, feature order."""
    def listed(f: str) -> Column:
        stale = F.coalesce(F.col(f"{f}.is_stale"), F.lit(False))
        if "attempted" in snaps.schema[f].dataType.fieldNames():
            stale = stale & F.coalesce(F.col(f"{f}.attempted"), F.lit(True))
        return F.when(stale, F.lit(f))
    return F.filter(F.array(*[listed(f) for f in features]), lambda x: x.isNotNull())


def append(snaps: DataFrame, path: str, date_col: str = "snapshot_date") -> None:
    """Plain append partitioned by date; the previous latest simply stays as history.

    Earlier snapshots are never touched. A job that is killed while it commits,
    or repeated, may leave part of its rows or rows twice: ``store.append``
    has neither.
    """
    df = snaps if date_col in snaps.columns else snaps.withColumn(date_col, F.to_date("snapshot_ts"))
    df.write.mode("append").partitionBy(date_col).parquet(path)


def to_json_docs(snaps: DataFrame, key: str = "company", features=FEATURES) -> DataFrame:
    """Nested snapshot document per row: {company, timestamp, analysis{feature: record}}."""
    analysis = F.struct(*[F.col(f).alias(f) for f in features if f in snaps.columns])
    doc = F.struct(F.col(key).alias("company"), F.col("snapshot_ts").alias("timestamp"), analysis.alias("analysis"))
    return snaps.select(key, "snapshot_ts", F.to_json(doc).alias("doc"))


def from_json_docs(docs: DataFrame, schema, key: str = "company", features=FEATURES) -> DataFrame:
    """Parse snapshot documents with an explicit schema (no inference)."""
    parsed = docs.select(F.from_json("doc", schema).alias("d"))
    return parsed.select(F.col("d.company").alias(key), F.col("d.timestamp").alias("snapshot_ts"),
                         *[F.col(f"d.analysis.{f}").alias(f) for f in features if f in schema["analysis"].dataType.fieldNames()])


def read_json_docs(spark: SparkSession, path: str, schema: StructType, key: str = "company", features=FEATURES) -> tuple[DataFrame, DataFrame]:
    """Snapshot documents of one file each, spread over as many lines as they like: (snapshots, quarantine).

    ``quarantine(file, reason, document)`` holds every file that gives no
    snapshot: one that is blank, isn't JSON or has a value of another type, or
    names no company or time. Files of both add up to all files that hold a
    byte (Spark's readers leave out files without any). Documents are parsed
    once and written, so that both parts are judged by the same reading.
    """
    bad = "_document"
    docs = spark.read.schema(StructType([*schema.fields, StructField(bad, StringType())])).option("multiLine", True) \
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).option("recursiveFileLookup", True).json(path)
    docs = docs.select("*", F.col("_metadata.file_path").alias("file"))
    reason = F.when(F.col(bad).isNotNull(), "not a document of the schema").when(F.col("company").isNull(), "no company").when(F.col("timestamp").isNull(), "no timestamp")
    out = f"{ensure_checkpoint_dir(spark)}/moatlens-documents-{uuid.uuid4().hex}"
    docs.withColumn("reason", reason).write.parquet(out)
    judged = spark.read.parquet(out)
    good = judged.filter(F.col("reason").isNull()).select(F.col("company").alias(key), F.col("timestamp").alias("snapshot_ts"), *[
        F.col(f"analysis.{f}").alias(f) for f in features if f in schema["analysis"].dataType.fieldNames()])
    rejected = judged.filter(F.col("reason").isNotNull()).select("file", "reason", F.col(bad).alias("document"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("file"), "length")
    blank = files.join(judged.select("file").distinct(), "file", "left_anti").select("file", F.lit("blank").alias("reason"), F.lit(None).cast("string").alias("document"))
    return good, rejected.unionByName(blank)
