"""Batch tables: repeated and killed appends, pruning, change reports kept up to date."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from moatlens.operators import change_log, changes, snapshots, store
from moatlens.plans.q_snap import typed_snapshots
from moatlens.sources import fixtures as X
from tests.conftest import SF001


def scratch():
    return tempfile.mkdtemp(prefix="moatlens-test-", dir="/tmp")


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def rows(spark, pairs):
    return spark.createDataFrame([(c, day(d), v) for c, d, v in pairs], "company string, snapshot_date date, v long")


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def read(spark, path, df):
    return sorted(tuple(r)[:3] for r in store.read(spark, path, df.schema, "snapshot_date").collect())


def test_a_repeated_append_changes_nothing(spark):
    path, a, b = scratch() + "/s", rows(spark, [("x", 0, 1), ("y", 1, 2)]), rows(spark, [("x", 1, 3)])
    assert store.read(spark, path, a.schema, "snapshot_date").collect() == []
    assert store.append(a, path, "2024", "snapshot_date") and store.append(b, path, "b-2", "snapshot_date")
    want = [("x", day(0), 1), ("x", day(1), 3), ("y", day(1), 2)]
    assert read(spark, path, a) == want
    assert not store.append(a, path, "2024", "snapshot_date")
    assert read(spark, path, a) == want
    assert [tuple(r) for r in store.commits(spark, path).select("batch", "seq").orderBy("seq").collect()] == [("2024", 1), ("b-2", 2)]


def test_a_killed_append_is_not_seen_and_can_be_repeated(spark):
    path, a, b = scratch() + "/s", rows(spark, [("x", 0, 1)]), rows(spark, [("x", 1, 3), ("x", 2, 4)])
    store.append(a, path, "a", "snapshot_date")
    store.write_batch(rows(spark, [("x", 1, 3), ("z", 9, 9)]), path, "b", "snapshot_date")  # killed before its marker
    os.makedirs(f"{path}/data/batch=c/_temporary/0")
    assert read(spark, path, a) == [("x", day(0), 1)]
    assert store.append(b, path, "b", "snapshot_date")
    assert read(spark, path, a) == [("x", day(0), 1), ("x", day(1), 3), ("x", day(2), 4)]
    for bad in ("", "_x", "a/b", "a=b"):
        with pytest.raises(ValueError):
            store.append(a, path, bad, "snapshot_date")


def test_prune_keeps_the_newest_and_untouched_files(spark):
    path = scratch() + "/s"
    old = [("x", d, d) for d in range(6)] + [("y", 5, 50), (None, 0, 7), ("w", 5, 51)]
    store.append(rows(spark, old), path, "a", "snapshot_date")
    store.append(rows(spark, [("x", 6, 6), ("x", 7, 7), ("y", 7, 70)]), path, "b", "snapshot_date")
    schema, before = rows(spark, []).schema, files(f"{path}/data")
    assert store.prune(spark, path, schema, "snapshot_date", "prune-1", 3, "company", "snapshot_date")
    want = {("x", day(d), d) for d in (5, 6, 7)} | {("y", day(5), 50), ("y", day(7), 70), (None, day(0), 7), ("w", day(5), 51)}
    assert {tuple(r)[:3] for r in store.read(spark, path, schema, "snapshot_date").collect()} == want
    # the dates from the oldest kept one on lose nothing: their files stay as they were, and stay in use
    kept = {f: t for f, t in before.items() if f"snapshot_date={day(5)}" in f or "batch=b" in f}
    assert kept and kept.items() <= files(f"{path}/data").items()
    assert store.vacuum(spark, path, "snapshot_date") == 5
    left = files(f"{path}/data")
    assert kept.items() <= left.items()
    data = spark.read.schema("company string, snapshot_date date, v long, batch string").parquet(f"{path}/data")
    assert {tuple(r) for r in data.select("company", "snapshot_date", "v").collect()} == want
    assert not store.prune(spark, path, schema, "snapshot_date", "prune-1", 1, "company", "snapshot_date")
    assert {tuple(r)[:3] for r in store.read(spark, path, schema, "snapshot_date").collect()} == want


def test_prune_killed_half_way_loses_nothing(spark):
    path = scratch() + "/s"
    df = rows(spark, [("x", d, d) for d in range(6)])
    store.append(df, path, "a", "snapshot_date")
    store.write_batch(df.filter("v > 3"), path, "prune-1", "snapshot_date")
    assert len(read(spark, path, df)) == 6
    assert store.prune(spark, path, df.schema, "snapshot_date", "prune-1", 2, "company", "snapshot_date")
    assert [r[2] for r in read(spark, path, df)] == [4, 5]
    assert store.vacuum(spark, path, "snapshot_date") == 5  # four dates and the failed attempt
    assert [r[2] for r in read(spark, path, df)] == [4, 5]


def history(spark):
    return typed_snapshots(X.fixture(spark, SF001, "fx_snapshots")).withColumnRenamed("snapshot_date", "snapshot_ts")


def said(df):
    return sorted((r.company, str(r.detected_at), str(r.compared_with), [tuple(c) for c in r.changes], r.stale_features) for r in df.collect())


def test_reports_kept_up_to_date_equal_all_computed_anew(spark):
    h, path = history(spark).filter(F.pmod(F.xxhash64("company"), F.lit(3)) == 0), scratch()
    ts = h.schema["snapshot_ts"].dataType
    month = F.month("snapshot_ts")
    late = F.pmod(F.xxhash64("company", "snapshot_ts"), F.lit(5)) == 0  # comes last, between stored ones
    batches = [h.filter((month == 1) & ~late), h.filter((month == 2) & ~late), h.filter(month.isin(3, 4) & ~late), h.filter(late)]
    seen = None
    for i, b in enumerate(batches):
        seen = b if seen is None else seen.unionByName(b)
        assert change_log.update(b, path, f"b{i}", buckets=4)
        assert said(change_log.reports(spark, path, ts_type=ts)) == said(changes.change_report(seen))
    assert not change_log.update(batches[0], path, "b0", buckets=4)
    want = said(changes.change_report(h))
    assert want and said(change_log.reports(spark, path, ts_type=ts)) == want


def test_a_killed_update_is_finished_by_its_repetition(spark):
    h, path = history(spark).filter(F.pmod(F.xxhash64("company"), F.lit(9)) == 0), scratch()
    ts = h.schema["snapshot_ts"].dataType
    early = F.month("snapshot_ts") < 3
    change_log.update(h.filter(early), path, "a", buckets=4)
    real = store.append
    store.append = lambda df, p, *a, **k: real(df, p, *a, **k) if p.endswith("reports") else (_ for _ in ()).throw(OSError("killed"))
    try:
        with pytest.raises(OSError):
            change_log.update(h.filter(~early), path, "b", buckets=4)
    finally:
        store.append = real
    assert change_log.update(h.filter(~early), path, "b", buckets=4)
    assert said(change_log.reports(spark, path, ts_type=ts)) == said(changes.change_report(h))


def test_only_the_partitions_of_a_batchs_companies_are_rewritten(spark):
    h, path = history(spark), scratch()
    change_log.update(h.filter(F.month("snapshot_ts") < 4), path, "a", buckets=16)
    one = h.filter((F.month("snapshot_ts") == 4) & (F.col("company") == "co1"))
    change_log.update(one, path, "b", buckets=16)
    parts = store.commits(spark, f"{path}/state").filter("batch = 'b' and old_batch is not null").collect()
    assert len(parts) == 1
    state = store.read(spark, f"{path}/state", change_log._bucketed(h.schema), "bucket")
    assert state.count() == h.filter((F.month("snapshot_ts") < 4) | (F.col("company") == "co1")).count()


def test_resent_and_ancient_snapshots(spark):
    h, path = history(spark).filter(F.col("company") == "co1"), scratch()
    ts = h.schema["snapshot_ts"].dataType
    full = changes.change_report(h)
    change_log.update(h, path, "a", archives=2, buckets=2)
    before = said(change_log.reports(spark, path, ts_type=ts))
    assert before == said(full)
    ancient = h.limit(1).withColumn("snapshot_ts", F.lit(dt.date(2020, 1, 1)))
    change_log.update(ancient, path, "b", archives=2, buckets=2)  # older than a full archive
    assert said(change_log.reports(spark, path, ts_type=ts)) == before
    again = h.withColumn("messaging", F.col("messaging").withField("main_headline", F.lit("same")).withField("is_stale", F.lit(False)))
    change_log.update(again.filter(F.month("snapshot_ts") > 1), path, "c", archives=2, buckets=2)
    want = changes.change_report(h.filter(F.month("snapshot_ts") == 1).unionByName(again.filter(F.month("snapshot_ts") > 1)))
    assert said(change_log.reports(spark, path, ts_type=ts))[1:] == said(want)[1:]


def test_ties_of_the_newest_time_give_one_latest(spark):
    df = rows(spark, [("x", 1, 5), ("x", 1, 9), ("x", 0, 99), ("y", 0, 1), ("y", 0, 1)])
    for n in (1, 4):
        assert sorted(tuple(r) for r in snapshots.latest(df.repartition(n), ts="snapshot_date").collect()) == [("x", day(1), 9), ("y", day(0), 1)]


def first_since(states):
    out, begun = [], None
    for i, k in enumerate(states):
        begun = (i if begun is None else begun) if k == "s" else None
        out.append(begun)
    return out


def test_first_stale_since_does_not_depend_on_buckets(spark):
    rng = random.Random(4)
    states = {f"c{c}": [rng.choice("gsssn") for _ in range(40)] for c in range(4)} | {"all": list("s" * 40), "runs": list("gssssssssssssssssssg" * 2)}
    data = [(c, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), k) for c, ks in states.items() for i, k in enumerate(ks)]
    df = spark.createDataFrame(data, "company string, snapshot_ts timestamp, k string")
    rec = F.struct(F.unix_seconds("snapshot_ts").alias("v"), (F.col("k") == "s").alias("is_stale"), F.lit(None).cast("timestamp").alias("stale_since"),
                   F.lit(None).cast("string").alias("stale_reason"))
    h = df.select("company", "snapshot_ts", F.when(F.col("k") != "n", rec).alias("pricing"))
    got = {}
    for per in (3, 10, 1000):
        c = snapshots.carry_forward(h, features=("pricing",), rows_per_bucket=per, first_stale=True)
        got[per] = {(r.company, r.snapshot_ts): r.pricing for r in c.collect()}
        for name, ks in states.items():
            want = first_since(ks)
            for i, k in enumerate(ks):
                p = got[per][name, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)]
                since = p and p.first_stale_since
                assert (since and (since - dt.datetime(2024, 1, 1)).seconds) == (want[i] if k == "s" else None), (per, name, i)
    assert got[3] == got[10] == got[1000]
