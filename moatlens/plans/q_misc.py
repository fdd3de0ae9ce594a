"""Registered queries: sentiment, patents, report assembly and timing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from moatlens.functions import lexicons as L
from moatlens.functions import valence as valence_data
from moatlens.operators import filings as fl
from moatlens.operators import patents, report, sentiment, statements
from moatlens.plans import q_fin
from moatlens.plans.registry import q, query
from moatlens.session import ensure_checkpoint_dir
from moatlens.sources import fixtures as X
from moatlens.sources import tables

_PUNCT = "[" + "".join("\\" + c if c in "[]\\^-" else c for c in valence_data.TOKEN_EDGE_PUNCT) + "]"
_VALENCE = "(values " + ", ".join(f"({q(w)}, {float(v)})" for w, v in valence_data.VALENCE) + ") as vl(word, val)"
_BEND = "(values " + ", ".join(f"({q(w)}, {v})" for ws, v in ((valence_data.BOOSTERS, valence_data.BOOST), (valence_data.DAMPENERS, -valence_data.BOOST)) for w in ws) + ") as bl(word, boost)"


def compound_sql(src: str, key: str) -> str:
    """Per-text compound polarity of ``src(key, text_id, text)`` in DuckDB: tokens as rows, the words before by ``lag``."""
    V = valence_data
    bent = lambda v, d: f"n{d} * ({v} + sign({v}) * b{d} * {V.DISTANCE[d - 1]})"
    return f"""
, wl as (select {key}, text_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\s+'),
     lambda t: regexp_replace(t, {q('^' + _PUNCT + '+|' + _PUNCT + '+$')}, '', 'g')), lambda t: t <> '') as ws from {src}),
tk as (select {key}, text_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from wl),
tf as (select tk.*, vl.val, coalesce(bl.boost, 0.0) as boost, regexp_full_match(w, '[A-Z]{{2,}}') as up,
     lower(w) in ({', '.join(q(w) for w in V.NEGATIONS)}) or ends_with(lower(w), 'n''t') as neg, lower(w) = 'but' as isbut
   from tk left join {_VALENCE} on vl.word = lower(tk.w) left join {_BEND} on bl.word = lower(tk.w)),
tx as (select {key}, text_id, bool_or(up) and bool_or(not up) as louder, min(case when isbut then i end) as bp from tf group by {key}, text_id),
tn as (select tf.*, bp, case when louder and up then {V.CAPS} else 0.0 end as shout, case when val is null and neg then {V.NEGATE} else 1.0 end as n,
     case when val is null and boost <> 0 then boost + case when louder and up then {V.CAPS} else 0.0 end else 0.0 end as b from tf join tx using ({key}, text_id)),
tl as (select *, {', '.join(f"coalesce(lag({c}, {d}) over nb, {z}) as {c}{d}" for d in (1, 2, 3) for c, z in (('n', '1.0'), ('b', '0.0')))}
   from tn window nb as (partition by {key}, text_id order by i)),
t0 as (select *, cast(val + sign(val) * shout as double) as v0 from tl), t1 as (select *, {bent('v0', 1)} as v1 from t0),
t2 as (select *, {bent('v1', 2)} as v2 from t1), t3 as (select *, {bent('v2', 3)} as v3 from t2),
sm as (select {key}, text_id, sum(v3 * case when bp is null or i = bp then 1.0 when i < bp then {V.BEFORE_BUT} else {V.AFTER_BUT} end) as s from t3 group by {key}, text_id),
am as (select s.{key}, s.text_id, coalesce(sm.s, 0.0) as s, least(length(text) - length(replace(text, '!', '')), {V.EXCLAMATIONS}) * {V.EXCLAMATION} as ex,
     length(text) - length(replace(text, '?', '')) as qs from {src} s left join sm on sm.{key} = s.{key} and sm.text_id = s.text_id),
ts as (select {key}, text_id, s + sign(s) * (coalesce(ex, 0) + case when qs > {V.QUESTIONS} then {V.MANY_QUESTIONS} when qs > 1 then qs * {V.QUESTION} else 0.0 end) as s from am),
cp as (select {key}, text_id, s / sqrt(s * s + {L.VADER_ALPHA}) as c from ts)
"""


@query("polarity_mean", "with src as (select conv_id, turn as text_id, text from conversations)" + compound_sql("src", "conv_id") + """
select conv_id, round(avg(c), 6) as compound_score, cast(count(*) as bigint) as sample_size from cp group by conv_id""")
def q_polarity(spark, sf):
    c = tables.table(spark, sf, "conversations")
    return sentiment.polarity_mean(c, "conv_id")


def _news_score(v):
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (v - 50) / 50))


@query("news_window_sentiment", f"""
with a as (select max(ts) as m from events),
w as (select user_id, ts, event_id, least(1.0, greatest(-1.0, (value - 50) / 50)) as sc, props as title
  from events, a where ts <= a.m and ts > a.m - interval {L.NEWS_LOOKBACK_DAYS} day),
r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rk from w)
select user_id, cast(count(*) as bigint) as articles_analyzed, round(avg(sc), 4) as average_sentiment_compound,
  cast(count(*) filter (rk <= {L.NEWS_MAX_ARTICLES}) as bigint) as newest_articles,
  round(avg(sc) filter (rk <= {L.NEWS_MAX_ARTICLES}), 4) as newest_sentiment_compound,
  round(avg(sc), 4) < {L.NEGATIVE_SPIKE_BELOW} as negative_spike_detected, round(avg(sc), 4) < {L.NEGATIVE_SPIKE_BELOW} as law11_moat_flag,
  string_agg(title, '|' order by rk) filter (where rk <= {L.NEWS_SAMPLE_HEADLINES}) as sample_headlines,
  round(sum(sc) filter (where rk <= {L.NEWS_SAMPLE_HEADLINES}), 6) as sample_score_sum
from r group by user_id""")
def q_news(spark, sf):
    e = tables.table(spark, sf, "events").withColumnRenamed("event_id", "_id")
    out = sentiment.news_window_sentiment(e, "user_id", "ts", _news_score(F.col("value")), F.col("props"))
    return out.select("user_id", F.col("articles_analyzed").cast("bigint").alias("articles_analyzed"),
                      "average_sentiment_compound", F.col("newest_articles").cast("bigint").alias("newest_articles"),
                      "newest_sentiment_compound", "negative_spike_detected", "law11_moat_flag",
                      F.array_join(F.transform("sample_headlines", lambda h: h["title"]), "|").alias("sample_headlines"),
                      F.round(F.aggregate("sample_headlines", F.lit(0.0), lambda a, h: a + h["score"]), 6).alias("sample_score_sum"))


@query("patent_counts", f"""
with c as (select l_suppkey as company, cast(count(*) filter (where l_linestatus = 'F') as bigint) as active_patent_count,
  cast(count(*) filter (where l_linestatus <> 'F') as bigint) as pending_applications from lineitem group by l_suppkey)
select *, cast(least(active_patent_count, {L.PATENT_CAP}) as bigint) as shown_active, cast(least(pending_applications, {L.PATENT_CAP}) as bigint) as shown_pending
from c""")
def q_patents(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    p = li.select(F.col("l_suppkey").alias("company"),
                  F.when(F.col("l_linestatus") == "F", "granted").otherwise("pending").alias("status"))
    return patents.patent_counts(p)


@query("cpc_density", f"""
with g as (select l_suppkey as company, l_orderkey, l_linenumber, l_partkey from lineitem where l_linestatus = 'F'),
r as (select *, row_number() over (partition by company order by l_orderkey, l_linenumber, l_partkey) as rk from g),
c as (select company, rk, unnest(string_split(p_type, ' ')) as code, unnest(range(0, len(string_split(p_type, ' ')))) as ci
  from r join part on p_partkey = l_partkey),
p as (select company, substr(code, 1, {L.CPC_PREFIX_CHARS}) as prefix, count(*) as n, min(rk * 1000 + ci) as fp from c where code <> '' group by all),
d as (select *, row_number() over (partition by company order by n desc, fp) as density_rank from p)
select company, cast(density_rank as bigint) as density_rank, prefix, cast(n as bigint) as n_patents from d where density_rank <= {L.CPC_TOP_N}""")
def q_cpc(spark, sf):
    li = tables.table(spark, sf, "lineitem").filter(F.col("l_linestatus") == "F")
    part = tables.table(spark, sf, "part")
    order = ("l_orderkey", "l_linenumber", "l_partkey")
    g = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_suppkey").alias("company"), *order, F.split("p_type", " ", -1).alias("codes"))
    return patents.cpc_density(g, order=order).withColumn("density_rank", F.col("density_rank").cast("bigint"))


# --------------------------------------------------------------- report -----
def _rollup(spark, sf):
    """Reports of all nations: every payload from one metrics aggregate, one segment and one event branch."""
    lines = X.fixture(spark, sf, "fx_statement_lines")
    comp = q_fin._companies(spark, sf)
    money = lambda c: F.col(c).cast("decimal(38,6)")
    seg = statements.segment_revenue(lines).groupBy("ticker").agg(F.array_sort(F.collect_list(
        F.struct("line_no", "segment", "kind", F.col("revenue_usd").cast("decimal(38,6)").alias("revenue_usd")))).alias("segments"))
    ev = fl.material_events(fl.filings_head(X.fixture(spark, sf, "fx_filings")).filter(F.col("form") == "8-K"))
    pol = sentiment.polarity_mean(ev.select("ticker", F.col("description").alias("text")), "ticker")
    # a run's times, per company and module: the dates of its customers' orders of one priority
    o = tables.table(spark, sf, "orders").join(tables.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cut = [F.col("o_orderkey") % 6 == i for i in range(len(L.MODULE_ORDER))]
    times = o.groupBy(F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("ticker")).agg(
        *[f(F.when(c, F.col("o_orderdate"))).cast("string").alias(f"{m}_{n}") for m, c in zip(L.MODULE_ORDER, cut, strict=True)
          for f, n in ((F.min, "started_at"), (F.max, "completed_at"))])
    parts = comp.join(statements.newest_metrics(lines), "ticker", "left").join(seg, "ticker", "left").join(pol, "ticker", "left").join(times, "ticker", "left")
    margin, rnd = statements.margins_of()
    payloads = {
        "financial": F.struct(F.format_string("%s (CIK %s)", F.col("name"), F.col("cik")).alias("headline"),
                              money("income.revenue").alias("revenue_usd"), money("balance.total_assets").alias("total_assets_usd")),
        "ip": F.struct(F.lit(None).cast("bigint").alias("patent_count"), F.lit(L.IP_NOT_IMPLEMENTED).alias("notes")),
        "sentiment": F.struct(F.col("compound_score").alias("compound_score"), F.coalesce("sample_size", F.lit(0)).alias("sample_size")),
        "porters": F.struct(money("cashflow.capex").alias("capex_usd"), money("cashflow.free_cash_flow").alias("free_cash_flow_usd"),
                            margin.alias("operating_margin"), rnd.alias("rd_to_revenue_ratio")),
        "vrio": F.struct(money("balance.intangible").alias("intangible_assets_usd"), money("balance.ppe").alias("ppe_usd")),
        "pestel": F.struct(F.coalesce(F.col("segments"), F.array().cast("array<struct<line_no:int,segment:string,kind:string,revenue_usd:decimal(38,6)>>")).alias("segments")),
    }
    statuses = {"financial": (F.col("n_periods") > 0, F.lit("financials_present_but_no_period_data_extracted")),
                "ip": (F.lit(False), F.lit(L.IP_NOT_IMPLEMENTED))}
    return report.module_rollup(parts, payloads, statuses)


_SEG_SQL = f"""select l.ticker, count(*) as n_segments, sum(l.value) as segment_revenue from fx_statement_lines l
  join np on np.ticker = l.ticker and np.period = l.period and np.statement = 'income'
  where l.statement = 'income' and regexp_matches(l.label, '(?i)Revenue|Sales|Net sales') and l.value is not null
  and ({' or '.join(f"contains(lower(trim(l.label)), {q(w)})" for w in L.GEO_SEGMENT_WORDS + L.PRODUCT_SEGMENT_WORDS)}) group by l.ticker"""
_TIMES_SQL = "select 'T' || cast(c_nationkey as varchar) as ticker, " + ", ".join(
    f"cast({f}(o_orderdate) filter (o_orderkey % 6 = {i}) as varchar) as {m}_{n}" for i, m in enumerate(L.MODULE_ORDER)
    for f, n in (("min", "started_at"), ("max", "completed_at"))) + " from orders join customer on o_custkey = c_custkey group by c_nationkey"
_F8 = f"""select ticker, count(*) as sample_size from (select *, row_number() over (partition by ticker order by filed_date desc, filing_id desc) as rk
  from fx_filings where form = '8-K') where rk <= {L.FILING_HEAD_N['8-K']} group by ticker"""
_ROLLUP_SQL = q_fin._MARGINS + ", fx_filings as (" + X.render("fx_filings", "duckdb") + f""")
, c as (select 'T' || cast(n_nationkey as varchar) as ticker, n_name || ' (CIK ' || cast(n_nationkey as varchar) || ')' as headline from nation),
fin as (select distinct ticker from fx_statement_lines where statement in ('income', 'balance')),
bal as (select v.* from v join np on np.ticker = v.ticker and np.period = v.period and np.statement = 'balance'),
inc as (select v.* from v join np on np.ticker = v.ticker and np.period = v.period and np.statement = 'income'),
cash as (select v.* from v join np on np.ticker = v.ticker and np.period = v.period and np.statement = 'cashflow'),
seg as ({_SEG_SQL}), tm as ({_TIMES_SQL}), f8 as ({_F8})
"""


@query("module_rollup", _ROLLUP_SQL + """
select c.ticker, 'financial:' || case when fin.ticker is not null then 'success' else 'error' end
  || '|ip:error|sentiment:success|porters:success|vrio:success|pestel:success' as statuses,
  cast(4 + (fin.ticker is not null)::int as bigint) as n_success, coalesce(n_segments, 0) as n_segments
from c left join fin using (ticker) left join seg using (ticker)""")
def q_rollup(spark, sf):
    r = _rollup(spark, sf)
    return r.select("ticker", F.array_join(F.transform("modules", lambda m: F.concat(m["name"], F.lit(":"), m["status"])), "|")
                    .alias("statuses"), F.col("n_success").cast("bigint").alias("n_success"),
                    F.size(F.col("modules")[L.MODULE_ORDER.index("pestel")]["pestel"]["segments"]).cast("bigint").alias("n_segments"))


@query("module_timing", """
with per as (select user_id, event_type, min(ts) as s, max(ts) as e from events group by all),
wall as (select user_id, epoch_us(max(ts)) - epoch_us(min(ts)) as wall_us from events group by all)
select per.user_id, per.event_type, cast(epoch_us(e) - epoch_us(s) as bigint) as elapsed_us, cast(wall_us as bigint) as wall_us
from per join wall using (user_id)""")
def q_timing(spark, sf):
    t = report.module_timing(tables.table(spark, sf, "events"), "user_id", "event_type", "ts")
    return t.select("user_id", "event_type", "elapsed_us", "wall_us")


# Per module the three numbers of its payload that the check compares.
_NUMBERS = {"financial": ("inc.revenue", "bal.total_assets", "null"), "ip": ("null", "null", "null"),
            "sentiment": ("null", "null", "coalesce(sample_size, 0)"), "porters": ("cash.capex", "cash.free_cash_flow", "operating_margin"),
            "vrio": ("bal.intangible", "bal.ppe", "null"), "pestel": ("segment_revenue", "null", "coalesce(n_segments, 0)")}
_STATUS = {"financial": "case when fin.ticker is not null then 'success' else 'error' end", "ip": "'error'"}


@query("report_write", _ROLLUP_SQL + " union all ".join(
    f"""select c.ticker, '2024-01-01 00:00:00' as generated_at, '{m}' as name, {_STATUS.get(m, "'success'")} as status, tm.{m}_started_at as started_at,
  tm.{m}_completed_at as completed_at, cast({a} as double) as first_value, cast({b} as double) as second_value, cast({n} as double) as number,
  {'headline' if m == 'financial' else 'null'} as headline
from c left join fin using (ticker) left join seg using (ticker) left join f8 using (ticker) left join tm using (ticker)
  left join bal on bal.ticker = c.ticker left join inc on inc.ticker = c.ticker left join cash on cash.ticker = c.ticker left join cm on cm.ticker = c.ticker"""
    for m, (a, b, n) in _NUMBERS.items()))
def q_report_write(spark, sf):
    """Report documents written to a run folder, read back and parsed: a row per module."""
    r = _rollup(spark, sf)
    path = f"{ensure_checkpoint_dir(spark)}/moatlens-reports-{uuid.uuid4().hex}"
    report.write_reports(r, path, F.lit("2024-01-01 00:00:00"))
    schema = StructType([StructField("ticker", StringType()), StructField("generated_at", StringType()), StructField("modules", r.schema["modules"].dataType)])
    d = spark.read.schema("value string").text(path).select(F.from_json("value", schema).alias("d")).select("d.ticker", "d.generated_at", F.explode("d.modules").alias("m"))
    g = lambda c: F.col(f"m.{c}").cast("double")
    return d.select(
        "ticker", "generated_at", "m.name", "m.status", "m.started_at", "m.completed_at",
        F.coalesce(g("financial.revenue_usd"), g("porters.capex_usd"), g("vrio.intangible_assets_usd"),
                   F.when(F.size("m.pestel.segments") > 0, F.aggregate("m.pestel.segments", F.lit(0.0), lambda a, x: a + x["revenue_usd"].cast("double")))).alias("first_value"),
        F.coalesce(g("financial.total_assets_usd"), g("porters.free_cash_flow_usd"), g("vrio.ppe_usd")).alias("second_value"),
        F.coalesce(g("porters.operating_margin"), g("sentiment.sample_size"), F.when(F.col("m.pestel").isNotNull(), F.size("m.pestel.segments")).cast("double")).alias("number"),
        F.col("m.financial.headline").alias("headline"))
