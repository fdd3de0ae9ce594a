"""Sinks and sources: snapshot append/latest round trip, JSON documents, report files."""

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from moatlens.operators import changes, report, snapshots
from moatlens.plans.q_snap import snapshot_doc_schema, typed_snapshots
from moatlens.sources import fixtures as X
from tests.conftest import SF001


def _scratch():
    return tempfile.mkdtemp(prefix="moatlens-test-", dir="/tmp")


def test_snapshot_append_is_history(spark):
    snaps = typed_snapshots(X.fixture(spark, SF001, "fx_snapshots")).withColumnRenamed("snapshot_date", "snapshot_ts")
    path = os.path.join(_scratch(), "snapshots")
    first = snaps.filter(F.col("snapshot_ts") < F.lit("2024-03-01").cast("date"))
    snapshots.append(first, path)
    snapshots.append(snaps.filter(F.col("snapshot_ts") >= F.lit("2024-03-01").cast("date")), path)
    back = spark.read.parquet(path)
    assert back.count() == snaps.count()
    latest = snapshots.latest(back.drop("snapshot_date"))
    assert latest.count() == snaps.select("company").distinct().count()
    assert tuple(latest.agg(F.min("snapshot_ts"), F.max("snapshot_ts")).first()) == (dt.date(2024, 3, 1), dt.date(2024, 4, 1))


def test_snapshot_json_file_round_trip(spark):
    s = typed_snapshots(X.fixture(spark, SF001, "fx_snapshots"))
    docs = snapshots.to_json_docs(s.withColumnRenamed("snapshot_date", "snapshot_ts"))
    path = os.path.join(_scratch(), "docs")
    docs.select("doc").write.text(path)
    text = spark.read.text(path).withColumnRenamed("value", "doc")
    back = snapshots.from_json_docs(text, snapshot_doc_schema(s))
    assert back.count() == s.count()
    one = json.loads(docs.first().doc)
    assert set(one["analysis"]) == {"pricing", "messaging", "complaints", "signals"}


def test_change_report_files(spark):
    s = typed_snapshots(X.fixture(spark, SF001, "fx_snapshots"))
    rep = changes.change_report(s, ts="snapshot_date")
    path = os.path.join(_scratch(), "changes")
    changes.write_change_reports(rep, path)
    lines = spark.read.text(path).collect()
    assert len(lines) == rep.filter(F.size("changes") > 0).count() > 0
    doc = json.loads(lines[0].value)
    assert set(doc) == {"company", "detected_at", "compared_with", "changes", "stale_features"}


def test_report_files(spark):
    path = os.path.join(_scratch(), "reports")
    from moatlens.plans.q_misc import _rollup
    report.write_reports(_rollup(spark, SF001), path)
    docs = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert docs and all([m["name"] for m in d["modules"]] == ["financial", "ip", "sentiment", "porters", "vrio", "pestel"]
                        for d in docs)
    assert all(d["ticker"] == d["ticker"].upper() for d in docs)
