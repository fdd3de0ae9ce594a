"""Plans that stay within a task's and the driver's memory however large the tables are."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from moatlens.operators import assembly, snapshots, store
from moatlens.plans import QUERIES, q_snap
from moatlens.sources import fixtures as X


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def parts(spark, tmp_path):
    p = spark.range(100).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))
    p.withColumn("p_partkey", F.when(F.col("p_partkey") != 7, F.col("p_partkey"))).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def _rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("view", ["fx_snapshots", "fx_crawls"])
def test_dealt_views_have_the_same_rows_in_bounded_tasks(spark, parts, view):
    d = X.dealt(spark, parts, view, "part", "p_partkey", 10)
    assert d.rdd.getNumPartitions() == 10 and _rows(d) == _rows(X.fixture(spark, parts, view))
    assert X.dealt(spark, parts, view, "part", "p_partkey", 100).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("key", ["snapshot_latest", "snapshot_retention", "stale_carry_forward"])
def test_histories_are_dealt_out_by_company(spark, parts, key, monkeypatch):
    whole = _rows(QUERIES[key](spark, parts))
    monkeypatch.setattr(q_snap, "_SNAPS_PER_TASK", 10)
    d = QUERIES[key](spark, parts)
    p = _plan(d).split("Initial Plan")[-1]
    assert p.count("REPARTITION_BY_NUM") >= 2 and "ENSURE_REQUIREMENTS" not in p, p
    assert _rows(d) == whole


@pytest.mark.parametrize("key", ["snapshot_append", "snapshot_prune", "change_report_batches", "snapshot_assembly", "crawl_to_changes"])
def test_rows_are_made_in_bounded_tasks(spark, parts, key, monkeypatch):
    asked, dealt = [], X.dealt
    monkeypatch.setattr(X, "dealt", lambda *a: asked.append(dealt(*a)) or asked[-1])
    monkeypatch.setattr(q_snap, "_SNAPS_PER_TASK", 50)
    monkeypatch.setattr(q_snap, "_CRAWLS_PER_TASK", 50)
    assert QUERIES[key](spark, parts).count() > 0
    assert [d.rdd.getNumPartitions() for d in asked] == [2]


def test_latest_leaves_out_rows_without_company_or_time(spark):
    d = lambda n: dt.date(2024, 1, n)
    s = spark.createDataFrame([("a", d(1), 1), ("a", d(2), 2), ("a", d(2), 3), ("a", None, 9), (None, d(3), 4), ("b", None, 5)], "company string, at date, v long")
    got = snapshots.latest(s, ts="at")
    assert [tuple(r) for r in got.collect()] == [("a", d(2), 3)]
    assert "Join" not in _plan(got)


def test_pages_are_not_sent_through_the_driver(spark):
    t = spark.createDataFrame([("a", "pricing", "u")], "company string, feature string, url string")
    f = spark.createDataFrame([("a", "pricing", "x" * 600, True, None)], "company string, feature string, markdown string, success boolean, error_message string")
    small = assembly.judged_targets(t, f, ["company"])
    p = _plan(small).split("Initial Plan")[-1]
    assert "SortMergeJoin" in p and small.first()["_ok"]


def test_pruning_gathers_no_partition_in_one_task(spark, tmp_path):
    df = spark.createDataFrame([(c, dt.date(2024, m, 1), m) for c in "xyz" for m in (1, 2, 3)], "company string, d date, v long")
    path, keep = f"{tmp_path}/s", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    store.append(df, path, "all", "d")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept, hit = store.pruned(store.read(spark, path, df.schema, "d"), "d", 2, "company", "d")
        p = _plan(kept).split("Initial Plan")[-1]
        assert not [x for x in p.splitlines() if "SortMergeJoin" in x and "batch" in x], p
        assert hit.count() == 1 and kept.count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
