"""Registered queries: snapshot history, stale handling and change detection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from moatlens.functions import text as T
from moatlens.operators import assembly, change_log, changes, snapshots, store
from moatlens.plans.registry import query
from moatlens.session import ensure_checkpoint_dir
from moatlens.sources import fixtures as X

_STALE_REASON = "no markdown / too short"


def typed_snapshots(fx: DataFrame) -> DataFrame:
    """fx_snapshots rows as typed snapshot records (one struct per feature)."""
    def marks(f: str, tried=None):
        st = F.col(f"st_{f}")
        return [st.alias("is_stale"), F.lit(None).cast("date").alias("stale_since"), F.when(st, F.lit(_STALE_REASON)).alias("stale_reason"),
                (F.lit(True) if tried is None else F.col(tried)).alias("attempted")]
    items = lambda c: F.split(c, r"\|")
    cats = F.array(
        F.struct(F.lit("pricing_value").alias("name"), F.lit(0).alias("ord"), F.col("score_price").cast("bigint").alias("score")),
        F.struct(F.lit("ux_complexity").alias("name"), F.lit(1).alias("ord"), F.col("score_ux").cast("bigint").alias("score")),
        F.struct(F.lit("performance").alias("name"), F.lit(2).alias("ord"), F.col("score_perf").cast("bigint").alias("score")),
    )
    ranked = T.ranked(cats, keep=lambda s: s > 0)
    signals = F.struct("biggest_hiring_push", items("tech").alias("tech_investments"), items("geo").alias("geographic_expansion"),
                       F.col("remote").alias("remote_stance"), *marks("signals"))
    return fx.select(
        "company", "snapshot_date",
        F.struct(items("tiers").alias("tiers_found"), items("monthly_prices").alias("monthly_prices"),
                 "has_free_tier", "requires_sales_call", *marks("pricing")).alias("pricing"),
        F.struct("main_headline", items("segments").alias("target_segments"), F.col("cta").alias("primary_cta"),
                 items("positioning").alias("positioning_angle"), *marks("messaging", "tried_messaging")).alias("messaging"),
        F.when(F.col("has_signals"), signals).alias("signals"),
        F.struct(T.names(ranked).alias("top_complaint_categories"),
                 F.transform(ranked, lambda s: F.struct(s["name"].alias("name"), s["score"].alias("score"))).alias("category_scores"),
                 (F.col("score_price") + F.col("score_ux") + F.col("score_perf")).cast("bigint").alias("total_complaint_signals"),
                 F.transform(items("competitors"), lambda c: F.struct(c.alias("name"), F.lit(1).cast("bigint").alias("count"))).alias("competitor_comparisons"),
                 *marks("complaints")).alias("complaints"),
    )


#: Companies whose snapshots, or whose crawls, one task holds.
_SNAPS_PER_TASK, _CRAWLS_PER_TASK = 25_000, 5_000


def _snaps(spark, sf):
    return typed_snapshots(X.dealt(spark, sf, "fx_snapshots", "part", "p_partkey", _SNAPS_PER_TASK))


def _histories(spark, sf):
    """Snapshots dealt out by company: windows over a history need no other shuffle, and none that grows with the table."""
    n = X.tasks(spark, sf, "part", _SNAPS_PER_TASK)
    return _snaps(spark, sf) if n == 1 else _snaps(spark, sf).repartition(n, "company")


def _flat(df: DataFrame) -> DataFrame:
    return df.select(
        "company", F.col("snapshot_date").cast("string").alias("snapshot_date"),
        F.array_join("pricing.tiers_found", "|").alias("tiers"),
        F.array_join("pricing.monthly_prices", "|").alias("monthly_prices"),
        F.col("pricing.has_free_tier").alias("has_free_tier"),
        F.col("pricing.requires_sales_call").alias("requires_sales_call"),
        F.col("messaging.main_headline").alias("main_headline"),
        F.col("signals.biggest_hiring_push").alias("biggest_hiring_push"),
        F.col("pricing.is_stale").alias("is_stale"))


_FX = X.cte("fx_snapshots")
_FLAT_SQL = """company, cast(snapshot_date as varchar) as snapshot_date, tiers, monthly_prices, has_free_tier,
  requires_sales_call, main_headline, case when has_signals then biggest_hiring_push end as biggest_hiring_push, st_pricing as is_stale"""


@query("snapshot_latest", _FX + f"""
, r as (select *, row_number() over (partition by company order by snapshot_date desc) as rn from fx_snapshots)
select {_FLAT_SQL} from r where rn = 1""")
def q_latest(spark, sf):
    return _flat(snapshots.latest(_histories(spark, sf), ts="snapshot_date"))


# Retention keeps latest + max_archives archives; with three versions per
# company the default (10) keeps everything, so the check uses one archive.
_RET_ARCHIVES = 1


@query("snapshot_retention", _FX + f"""
, r as (select *, row_number() over (partition by company order by snapshot_date desc) as rn from fx_snapshots)
select {_FLAT_SQL} from r where rn <= {_RET_ARCHIVES + 1}""")
def q_retention(spark, sf):
    return _flat(snapshots.retention(_histories(spark, sf), _RET_ARCHIVES, ts="snapshot_date"))


def _run_folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/moatlens-{name}-{uuid.uuid4().hex}"


@query("snapshot_append", _FX + f"select {_FLAT_SQL} from fx_snapshots")
def q_append(spark, sf):
    """Two batches appended to a run folder, the first one twice, read back."""
    s, path = _snaps(spark, sf), _run_folder(spark, "append")
    for batch in ("early", "late", "early"):
        part = s.filter((F.col("snapshot_date") < F.lit("2024-03-01").cast("date")) == F.lit(batch == "early"))
        store.append(part, path, batch, "snapshot_date")
    return _flat(store.read(spark, path, s.schema, "snapshot_date"))


@query("snapshot_prune", _FX + f"""
, r as (select *, row_number() over (partition by company order by snapshot_date desc) as rn from fx_snapshots)
select {_FLAT_SQL} from r where rn <= {_RET_ARCHIVES + 1}""")
def q_prune(spark, sf):
    """A stored history pruned to latest and archives, its replaced files deleted, read back."""
    s, path = _snaps(spark, sf), _run_folder(spark, "prune")
    store.append(s, path, "all", "snapshot_date")
    store.prune(spark, path, s.schema, "snapshot_date", "prune", _RET_ARCHIVES + 1, "company", "snapshot_date")
    store.vacuum(spark, path, "snapshot_date")
    return _flat(store.read(spark, path, s.schema, "snapshot_date"))


def snapshot_doc_schema(df: DataFrame) -> StructType:
    analysis = StructType([StructField(f, df.schema[f].dataType) for f in snapshots.FEATURES])
    return StructType([StructField("company", StringType()), StructField("timestamp", DateType()),
                       StructField("analysis", analysis)])


@query("snapshot_json_io", _FX + f"select {_FLAT_SQL} from fx_snapshots")
def q_json_io(spark, sf):
    """Snapshot documents written as text files to a run folder, read back and parsed."""
    s, path = _snaps(spark, sf), _run_folder(spark, "json")
    snapshots.to_json_docs(s.withColumnRenamed("snapshot_date", "snapshot_ts")).select("doc").write.text(path)
    back = snapshots.from_json_docs(spark.read.text(path).withColumnRenamed("value", "doc"), snapshot_doc_schema(s))
    return _flat(back.withColumnRenamed("snapshot_ts", "snapshot_date"))


# The rule as the crawl applies it, one snapshot after the other: a stale feature
# takes what the previous snapshot had stored for it, if it had the feature.
_CARRY = _FX.replace("with ", "with recursive ", 1) + """
, n as (select *, row_number() over (partition by company order by snapshot_date) as k from fx_snapshots)
, step as (
  select company, k, snapshot_date, case when not st_pricing then tiers end as tiers, case when not st_pricing then monthly_prices end as monthly_prices,
    case when not st_messaging then main_headline end as main_headline, has_signals as had_signals,
    case when has_signals and not st_signals then biggest_hiring_push end as push,
    cast(null as date) as since_pricing, cast(null as date) as since_signals
  from n where k = 1
  union all
  select n.company, n.k, n.snapshot_date, case when n.st_pricing then p.tiers else n.tiers end, case when n.st_pricing then p.monthly_prices else n.monthly_prices end,
    case when n.st_messaging then p.main_headline else n.main_headline end, n.has_signals,
    case when not n.has_signals then null when n.st_signals then case when p.had_signals then p.push end else n.biggest_hiring_push end,
    case when n.st_pricing then p.snapshot_date end, case when n.has_signals and n.st_signals and p.had_signals then p.snapshot_date end
  from step p join n on n.company = p.company and n.k = p.k + 1)
"""


# A run of stale snapshots begins with the first stale one after the last that wasn't.
_RUNS = """
, ended as (select *, max(case when not st_pricing then snapshot_date end) over (partition by company order by snapshot_date) as fresh from fx_snapshots)
, runs as (select company, snapshot_date, min(case when st_pricing then snapshot_date end) over (partition by company, fresh order by snapshot_date) as begun from ended)
"""


@query("stale_carry_forward", _CARRY + _RUNS + """
select case when n.st_pricing then cast(runs.begun as varchar) end as first_stale_since, step.company, cast(step.snapshot_date as varchar) as snapshot_date, n.st_pricing as is_stale,
  cast(since_pricing as varchar) as stale_since, cast(since_signals as varchar) as signals_since, step.tiers, step.monthly_prices, step.main_headline,
  step.push as biggest_hiring_push
from step join n on n.company = step.company and n.k = step.k join runs on runs.company = step.company and runs.snapshot_date = step.snapshot_date""")
def q_carry(spark, sf):
    c = snapshots.carry_forward(_histories(spark, sf), ts="snapshot_date", first_stale=True)
    return c.select(
        "company", F.col("snapshot_date").cast("string").alias("snapshot_date"),
        F.col("pricing.is_stale").alias("is_stale"),
        F.col("pricing.stale_since").cast("string").alias("stale_since"),
        F.col("pricing.first_stale_since").cast("string").alias("first_stale_since"),
        F.col("signals.stale_since").cast("string").alias("signals_since"),
        F.array_join("pricing.tiers_found", "|").alias("tiers"),
        F.array_join("pricing.monthly_prices", "|").alias("monthly_prices"),
        F.col("messaging.main_headline").alias("main_headline"),
        F.col("signals.biggest_hiring_push").alias("biggest_hiring_push"))


@query("stale_features", _FX + """
select company, cast(snapshot_date as varchar) as snapshot_date, concat_ws('|', case when st_pricing then 'pricing' end,
  case when st_messaging and tried_messaging then 'messaging' end, case when st_signals and has_signals then 'signals' end,
  case when st_complaints then 'complaints' end) as stale_features from fx_snapshots""")
def q_stale_features(spark, sf):
    s = _snaps(spark, sf)
    return s.select("company", F.col("snapshot_date").cast("string").alias("snapshot_date"),
                    F.array_join(snapshots.stale_features(s), "|").alias("stale_features"))


_LISTS = {"tl": "tiers", "ml": "monthly_prices", "sl": "segments", "pl": "positioning", "el": "tech", "gl": "geo", "cl": "competitors"}
_LAGS = ["tl", "ml", "sl", "pl", "cl", "has_free_tier", "requires_sales_call", "main_headline", "cta", "cats", "total", "score_price", "score_ux", "score_perf",
         "st_pricing", "st_messaging", "st_signals", "st_complaints", "has_signals"]
_SIGNALS = ["el", "gl", "biggest_hiring_push", "remote"]
_PAIRS = _FX + f"""
, s as (select *, {', '.join(f"string_split({c}, '|') as {a}" for a, c in _LISTS.items())},
    list_sort(list_filter([{{'neg': -score_price, 'ord': 0, 'name': 'pricing_value', 'score': score_price}},
                           {{'neg': -score_ux, 'ord': 1, 'name': 'ux_complexity', 'score': score_ux}},
                           {{'neg': -score_perf, 'ord': 2, 'name': 'performance', 'score': score_perf}}], lambda x: x.score > 0)) as cats,
    score_price + score_ux + score_perf as total from fx_snapshots),
p as (select s.*, {', '.join(f'lag({c}) over w as o_{c}' for c in _LAGS)},
    lag(snapshot_date) over w as compared_with,
    {', '.join(f"lag(case when has_signals then {c} end) over w as o0_{c}" for c in _SIGNALS)}
  from s window w as (partition by company order by snapshot_date)),
p2 as (select *, coalesce(o0_el, []) as o_el, coalesce(o0_gl, []) as o_gl, o0_biggest_hiring_push as o_push, o0_remote as o_remote from p where compared_with is not null),
ok_pricing as (select * from p2 where not st_pricing and not o_st_pricing),
ok_messaging as (select * from p2 where not st_messaging and not o_st_messaging),
ok_complaints as (select * from p2 where not st_complaints and not o_st_complaints),
ok_signals as (select * from p2 where has_signals and not st_signals and not (o_has_signals and o_st_signals))
"""


def _set(expr_new, expr_old):
    return f"list_sort(list_distinct(list_filter({expr_new}, lambda x: not list_contains({expr_old}, x))))"


def _render(lst):
    return "'{' || array_to_string(list_transform(" + lst + ", lambda x: '''' || x || ''''), ', ') || '}'"


def _rows(feature, kind, detail, message, where):
    return (f"select '{feature}' as feature, company, snapshot_date, compared_with, '{kind}' as kind, {detail} as detail, "
            f"{message} as message from ok_{feature} where {where}")


def _set_rows(feature, kind, label, new, old):
    d = _set(new, old)
    return _rows(feature, kind, f"array_to_string({d}, ', ')", f"'{label}: ' || {_render(d)}", f"len({d}) > 0")


def _pair(old, new):
    quoted = lambda c: f"chr(39) || coalesce(cast({c} as varchar), 'None') || chr(39)"
    return f"{quoted(old)} || ' → ' || {quoted(new)}"


def _change_rows(feature, kind, label, old, new):
    text = _pair(old, new)
    return _rows(feature, kind, text, f"'{label}: ' || {text}", f"{old} is distinct from {new}")


_EVENTS = {
    "pricing": [
        _set_rows("pricing", "new_monthly_prices", "NEW monthly prices", "ml", "o_ml"),
        _set_rows("pricing", "removed_monthly_prices", "REMOVED monthly prices", "o_ml", "ml"),
        _set_rows("pricing", "new_tiers", "NEW tiers added", "tl", "o_tl"),
        _set_rows("pricing", "removed_tiers", "REMOVED tiers", "o_tl", "tl"),
        _rows("pricing", "free_tier", _pair("o_has_free_tier", "has_free_tier"),
              "'FREE TIER ' || case when has_free_tier then 'ADDED' else 'REMOVED' end", "o_has_free_tier is distinct from has_free_tier"),
        _rows("pricing", "sales_call", _pair("o_requires_sales_call", "requires_sales_call"),
              "'Sales call requirement ' || case when requires_sales_call then 'now requires' else 'dropped' end",
              "o_requires_sales_call is distinct from requires_sales_call")],
    "messaging": [
        _change_rows("messaging", "headline", "HEADLINE CHANGED", "o_main_headline", "main_headline"),
        _set_rows("messaging", "new_segments", "NOW targeting new segments", "sl", "o_sl"),
        _set_rows("messaging", "dropped_segments", "DROPPED targeting", "o_sl", "sl"),
        _change_rows("messaging", "primary_cta", "PRIMARY CTA CHANGED", "o_cta", "cta"),
        _set_rows("messaging", "new_positioning", "NEW positioning angle", "pl", "o_pl")],
    "complaints": [
        _rows("complaints", "top_shift", _pair("o_cats[1].name", "cats[1].name"), "'TOP COMPLAINT SHIFTED: ' || " + _pair("o_cats[1].name", "cats[1].name"),
              "len(o_cats) > 0 and len(cats) > 0 and o_cats[1].name <> cats[1].name"),
        """select 'complaints' as feature, company, snapshot_date, compared_with, 'share_spike' as kind, c.name as detail,
  'COMPLAINT SHARE SPIKE in \'\'' || c.name || '\'\': ' || cast(cast(round_even(old_share * 100, 0) as bigint) as varchar) || '% → '
    || cast(cast(round_even(new_share * 100, 0) as bigint) as varchar) || '%' as message
from (select *, unnest(cats) as c from ok_complaints) x,
  lateral (select case c.name when 'pricing_value' then o_score_price when 'ux_complexity' then o_score_ux else o_score_perf end as old_score) os,
  lateral (select old_score / (case when o_total = 0 then 1 else o_total end) as old_share,
                  c.score / (case when total = 0 then 1 else total end) as new_share) sh
where old_score <> 0 and new_share > old_share * 1.5 and new_share > 0.05""",
        _set_rows("complaints", "new_competitors", "NEW competitor comparisons appearing", "cl", "o_cl")],
    "signals": [
        _change_rows("signals", "hiring_focus", "HIRING FOCUS SHIFTED", "o_push", "biggest_hiring_push"),
        _set_rows("signals", "new_tech", "NEW tech investment areas", "el", "o_el"),
        _set_rows("signals", "new_geo", "NEW geographic expansion signals", "gl", "o_gl"),
        _change_rows("signals", "remote_stance", "REMOTE POLICY CHANGED", "o_remote", "remote")],
}


def _diff_sql(feature):
    return _PAIRS + ", ev as (" + " union all ".join(_EVENTS[feature]) + """)
select company, cast(snapshot_date as varchar) as detected_at, cast(compared_with as varchar) as compared_with,
  kind, detail, message from ev"""


def _diff_query(spark, sf, feature):
    ev = changes.change_events(_snaps(spark, sf), ts="snapshot_date", features=(feature,))
    return ev.select("company", F.col("detected_at").cast("string").alias("detected_at"),
                     F.col("compared_with").cast("string").alias("compared_with"), "kind", "detail", "message")


@query("diff_pricing", _diff_sql("pricing"))
def q_diff_pricing(spark, sf):
    return _diff_query(spark, sf, "pricing")


@query("diff_messaging", _diff_sql("messaging"))
def q_diff_messaging(spark, sf):
    return _diff_query(spark, sf, "messaging")


@query("diff_complaints", _diff_sql("complaints"))
def q_diff_complaints(spark, sf):
    return _diff_query(spark, sf, "complaints")


@query("diff_signals", _diff_sql("signals"))
def q_diff_signals(spark, sf):
    return _diff_query(spark, sf, "signals")


@query("stale_guard", _PAIRS + """
select company, cast(snapshot_date as varchar) as detected_at, cast(compared_with as varchar) as compared_with,
  not st_pricing and not o_st_pricing as comparable, has_signals and not st_signals and not (o_has_signals and o_st_signals) as signals_comparable from p2""")
def q_stale_guard(spark, sf):
    s = _snaps(spark, sf).select("company", "snapshot_date", "pricing", "signals")
    p = snapshots.with_previous(s, ts="snapshot_date", features=("pricing", "signals")).filter(F.col("compared_with").isNotNull())
    return p.select("company", F.col("snapshot_date").cast("string").alias("detected_at"),
                    F.col("compared_with").cast("string").alias("compared_with"),
                    changes.stale_guard(F.col("prev_pricing"), F.col("pricing")).alias("comparable"),
                    changes.stale_guard(F.col("prev_signals"), F.col("signals")).alias("signals_comparable"))


_ALL = _PAIRS + ", ev as (" + " union all ".join(x for f in snapshots.FEATURES for x in _EVENTS[f]) + ")\n"


_REPORT = """
select company, cast(snapshot_date as varchar) as detected_at, cast(compared_with as varchar) as compared_with,
  cast(count(*) as bigint) as n_changes,
  array_to_string(list_sort(list_distinct(list(feature))), '|') as features_changed
from ev group by company, snapshot_date, compared_with"""


def _report_rows(rep: DataFrame) -> DataFrame:
    return rep.select("company", F.col("detected_at").cast("string").alias("detected_at"),
                      F.col("compared_with").cast("string").alias("compared_with"),
                      F.size("changes").cast("bigint").alias("n_changes"),
                      F.array_join(F.array_sort(F.array_distinct(F.transform("changes", lambda c: c["feature"]))), "|")
                      .alias("features_changed"))


@query("change_report", _ALL + _REPORT)
def q_change_report(spark, sf):
    return _report_rows(changes.change_report(_snaps(spark, sf), ts="snapshot_date"))


@query("change_report_batches", _ALL + _REPORT)
def q_change_batches(spark, sf):
    """Reports kept up to date over three batches, of which the last holds late snapshots; the history is read once."""
    s, path = _snaps(spark, sf), _run_folder(spark, "changelog")
    first, late = F.col("snapshot_date") < F.lit("2024-03-01").cast("date"), F.pmod(F.crc32("company"), F.lit(3)) == F.month("snapshot_date") - 2
    for batch, which in (("1", first & ~late), ("2", ~first & ~late), ("3", late)):
        change_log.update(s.filter(which), path, batch, ts="snapshot_date", buckets=8)
    return _report_rows(change_log.reports(spark, path, ts_type=DateType()))


@query("change_report_write", _ALL + """
, st as (select company, snapshot_date, concat_ws('|', case when st_pricing then 'pricing' end, case when st_messaging and tried_messaging then 'messaging' end,
   case when st_signals and has_signals then 'signals' end, case when st_complaints then 'complaints' end) as stale_features from fx_snapshots)
select ev.company, cast(ev.snapshot_date as varchar) as detected_at, cast(compared_with as varchar) as compared_with, feature,
  array_to_string(list_sort(list(message)), '|') as messages, st.stale_features
from ev join st on st.company = ev.company and st.snapshot_date = ev.snapshot_date group by all""")
def q_change_report_write(spark, sf):
    """Report files written to a run folder, read back and parsed: a row per feature with changes."""
    path = _run_folder(spark, "changes")
    changes.write_change_reports(changes.change_report(_snaps(spark, sf), ts="snapshot_date"), path)
    schema = "company string, detected_at string, compared_with string, changes map<string,array<string>>, stale_features array<string>"
    d = spark.read.schema("value string").text(path).select(F.from_json("value", schema).alias("d")).select("d.*")
    d = d.select("company", "detected_at", "compared_with", F.explode("changes").alias("feature", "m"), "stale_features")
    return d.select("company", "detected_at", "compared_with", "feature", F.array_join(F.array_sort("m"), "|").alias("messages"),
                    F.array_join("stale_features", "|").alias("stale_features"))


def _crawls(spark, sf):
    """Both crawls of every company, assembled in one pass."""
    c = X.dealt(spark, sf, "fx_crawls", "part", "p_partkey", _CRAWLS_PER_TASK).withColumn("snapshot_ts", F.to_timestamp(F.concat(F.lit("2024-01-0"), F.col("day").cast("string"))))
    fetched = c.filter(F.col("url").isNotNull()).select("company", "snapshot_ts", "feature", "markdown", "success", "error_message",
                                                        (F.col("snapshot_ts") + F.make_dt_interval(mins=F.col("attempt"))).alias("fetched_at"))
    return assembly.assemble(c.filter(F.col("attempt") == 2).select("company", "snapshot_ts", "feature", "url"), fetched)


# A target's page is accepted if it was fetched and has 500 characters; what it says was planted in the attempt that counts.
_CRAWL = X.cte("fx_crawls") + """
, g as (select *, url is not null and success and length(markdown) >= 500 as ok,
   case when url is null then 'URL discovery failed (no sitemap match, no probe success)'
        when not (success and length(markdown) >= 500) then coalesce(string_split(error_message, chr(10))[1], 'no markdown / too short') end as reason,
   case feature when 'pricing' then regexp_extract(markdown, '[$][0-9]+/mo') when 'messaging' then regexp_extract(markdown, 'Headline [0-9]')
     when 'signals' then case when contains(markdown, 'recruiter') then 'hr_people' else 'engineering' end else 'pricing_value' end as planted from fx_crawls where attempt = 2)
"""


@query("snapshot_assembly", _CRAWL + """
select company, cast(day as bigint) as day, feature, not ok as is_stale, reason as stale_reason, url is not null as attempted,
  case when ok then planted end as found
from g""")
def q_assembly(spark, sf):
    """Both crawls of every company, a row per feature the crawl had."""
    s = _crawls(spark, sf)
    found = {"pricing": F.get("pricing.monthly_prices", F.lit(0)), "messaging": F.col("messaging.main_headline"),
             "signals": F.col("signals.biggest_hiring_push"), "complaints": F.get("complaints.top_complaint_categories", F.lit(0))}
    per = F.array(*[F.when(F.col(f).isNotNull(), F.struct(
        F.lit(f).alias("feature"), F.col(f"{f}.is_stale").alias("is_stale"), F.col(f"{f}.stale_reason").alias("stale_reason"),
        F.col(f"{f}.attempted").alias("attempted"), v.alias("found"))) for f, v in found.items()])
    day = F.dayofmonth("snapshot_ts").cast("bigint").alias("day")
    return s.select("company", day, T.explode_kept(per).alias("x")).filter(F.col("x").isNotNull()).select("company", "day", "x.*")


@query("crawl_to_changes", _CRAWL + """
, v as (select company, feature, chr(39) || max(planted) filter (day = 1) || chr(39) as old, chr(39) || max(planted) filter (day = 2) || chr(39) as new
  from g group by company, feature having bool_and(ok)),
e as (select company, feature, 'NEW monthly prices: {' || new || '}' as message from v where feature = 'pricing' and old <> new
  union all select company, feature, 'REMOVED monthly prices: {' || old || '}' from v where feature = 'pricing' and old <> new
  union all select company, feature, 'HEADLINE CHANGED: ' || old || ' → ' || new from v where feature = 'messaging' and old <> new
  union all select company, feature, 'HIRING FOCUS SHIFTED: ' || old || ' → ' || new from v where feature = 'signals' and old <> new)
select company, feature, message from e""")
def q_crawl_to_changes(spark, sf):
    """Assembled crawls appended to a history, batch by batch, read back, carried forward and compared."""
    path, crawls = _run_folder(spark, "crawls"), _crawls(spark, sf).withColumn("snapshot_date", F.to_date("snapshot_ts"))
    for day in (1, 2):
        store.append(crawls.filter(F.dayofmonth("snapshot_ts") == day), path, f"day-{day}", "snapshot_date")
    history = store.read(spark, path, crawls.schema, "snapshot_date").drop("snapshot_date", "batch", "seq")
    ev = changes.change_events(snapshots.carry_forward(history))
    return ev.select("company", "feature", "message")
