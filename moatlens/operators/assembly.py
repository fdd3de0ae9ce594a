"""Pages of crawls to snapshot rows: one fetch per target, gate, extract, mark failures, assemble.

``targets(company, feature, url)`` lists the features a crawl has per company;
a null url means that none was found. ``fetches(company, feature, markdown,
success, error_message[, fetched_at])`` is the fetch log, with a row per
attempt. Of a target's attempts the newest accepted one counts, else the newest
(else, without times, the smallest text), whatever the order of the rows.
Every target becomes a feature record:

- found, fetched and accepted: the extracted record;
- found but rejected or not fetched: stale, with the reason;
- not found: stale and not attempted.

A feature that isn't among a company's targets is null.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moatlens.functions import lexicons as L
from moatlens.operators import complaints, messaging, pricing, signals
from moatlens.operators.pages import page_gate
from moatlens.session import ensure_checkpoint_dir

EXTRACTORS = {"pricing": pricing.extract_pricing, "messaging": messaging.extract_messaging,
              "signals": signals.extract_signals, "complaints": complaints.extract_complaints}


def best_fetches(fetches: DataFrame, keys: list[str]) -> DataFrame:
    """One gated fetch per target: a per-partition top-1 before the shuffle, so a target fetched very often ships few rows."""
    at = F.col("fetched_at") if "fetched_at" in fetches.columns else F.lit(None).cast("timestamp")
    gated = page_gate(fetches).withColumn("fetched_at", at)
    order = Window.partitionBy(*keys).orderBy(F.col("accepted").desc(), F.col("fetched_at").desc_nulls_last(),
                                              F.col("error_message").asc_nulls_last(), F.col("markdown").asc_nulls_last())
    return gated.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") == 1).select(*keys, "markdown", "accepted", "reject_reason")


def judged_targets(targets: DataFrame, fetches: DataFrame, keys: list[str]) -> DataFrame:
    """Targets with the text of their accepted page, if any, and why there is none."""
    # a merge join: the planner takes pages for as small as their columns' types and would send all of them through the driver
    gated = targets.join(best_fetches(fetches, [*keys, "feature"]).hint("merge"), [*keys, "feature"], "left")
    found = F.col("url").isNotNull()
    ok = found & F.coalesce(F.col("accepted"), F.lit(False))
    reason = F.when(~found, F.lit(L.URL_DISCOVERY_FAILED)).when(~ok, F.coalesce("reject_reason", F.lit(L.PAGE_ERROR_DEFAULT)))
    return gated.select(*keys, F.when(ok, F.col("markdown")).alias("markdown"), ok.alias("_ok"), reason.alias("_reason"), found.alias("_found"), "feature")


def gated_targets(targets: DataFrame, fetches: DataFrame, keys: list[str]) -> DataFrame:
    """``judged_targets``, written once, a folder per feature."""
    spark, rows = targets.sparkSession, judged_targets(targets, fetches, keys)
    path = f"{ensure_checkpoint_dir(spark)}/moatlens-gated-{uuid.uuid4().hex}"
    rows.write.partitionBy("feature").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def feature_records(gated: DataFrame, feature: str, keys: list[str]) -> DataFrame:
    """``keys`` and the record of every target of the feature; only its own rows are read."""
    mine = gated.filter(F.col("feature") == feature)
    # a rejected page has no text to extract from
    out = EXTRACTORS[feature](mine.withColumn("markdown", F.coalesce("markdown", F.lit(""))))
    fields = [c for c in out.columns if c not in gated.columns]
    record = F.struct(*[F.when(F.col("_ok"), F.col(c)).alias(c) for c in fields], (~F.col("_ok")).alias("is_stale"),
                      F.lit(None).cast("timestamp").alias("stale_since"), F.col("_reason").alias("stale_reason"), F.col("_found").alias("attempted"))
    return out.select(*keys, record.alias(feature))


def assemble(targets: DataFrame, fetches: DataFrame, snapshot_ts: Column | None = None) -> DataFrame:
    """(company, snapshot_ts, pricing, messaging, signals, complaints): one snapshot row per company and crawl.

    ``snapshot_ts`` is the time of a single crawl; without it both tables hold
    a column of that name, and many crawls are assembled at once.
    """
    if snapshot_ts is not None:
        targets, fetches = targets.withColumn("snapshot_ts", snapshot_ts), fetches.withColumn("snapshot_ts", snapshot_ts)
    keys = ["company", "snapshot_ts"]
    gated = gated_targets(targets.select(*keys, "feature", "url"), fetches, keys)
    records = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [feature_records(gated, f, keys) for f in EXTRACTORS])
    return records.groupBy(*keys).agg(*[F.first(f, ignorenulls=True).alias(f) for f in EXTRACTORS])
