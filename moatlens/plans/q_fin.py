"""Registered queries: statements, DuPont, margins, balance items, segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from moatlens.functions import lexicons as L
from moatlens.operators import statements as st
from moatlens.plans.registry import ci, q, query
from moatlens.sources import fixtures as X
from moatlens.sources import tables


def _lines(spark, sf):
    return X.fixture(spark, sf, "fx_statement_lines")


def _companies(spark, sf):
    n = tables.table(spark, sf, "nation")
    return n.select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("ticker"),
                    F.col("n_name").alias("name"), F.col("n_nationkey").alias("cik"))


_FX = X.cte("fx_statement_lines")
_METRIC_VALUES = "(values " + ", ".join(
    f"({q(m)}, {q(stmt) if stmt else 'null'}, {ci(pat)})" for m, (stmt, pat) in st.METRICS.items()) + ") as m(metric, stmt, pat)"
_LK = f"""
, lk as (select l.ticker, l.period, m.metric, l.value, l.line_no,
    row_number() over (partition by l.ticker, l.period, m.metric order by l.line_no) as rn
  from fx_statement_lines l join {_METRIC_VALUES} on (m.stmt is null or l.statement = m.stmt) and regexp_matches(l.label, m.pat)),
v as (select t.ticker, t.period, {', '.join(f"max(case when lk.metric = {q(m)} and lk.rn = 1 then lk.value end) as {m}, bool_or(lk.metric = {q(m)}) is true as has_{m}" for m in st.METRICS)}
  from (select distinct ticker, period from fx_statement_lines) t left join lk on lk.ticker = t.ticker and lk.period = t.period
  group by t.ticker, t.period),
np as (select ticker, statement, max(period) as period from fx_statement_lines group by ticker, statement)
"""


def _sd(n, d, digits=L.RATIO_DIGITS):
    return f"case when {n} is not null and {d} is not null and {d} <> 0 then round({n} / {d}, {digits}) end"


_LOOKUP_COLS = ["revenue", "net_income", "total_assets", "total_equity", "operating_income", "rnd", "intangible", "ppe"]


@query("label_lookup", _FX + _LK + f"""
select ticker, cast(period as varchar) as period, {', '.join(_LOOKUP_COLS)} from v""")
def q_label_lookup(spark, sf):
    v = st.label_lookup(_lines(spark, sf), _LOOKUP_COLS)
    return v.select("ticker", F.col("period").cast("string").alias("period"), *_LOOKUP_COLS)


@query("period_select", _FX + """
, p as (select distinct ticker, period from fx_statement_lines where statement in ('income', 'balance'))
select ticker, cast(period as varchar) as period, cast(period_rank as bigint) as period_rank from
 (select *, row_number() over (partition by ticker order by period desc) as period_rank from p) where period_rank <= 5""")
def q_period_select(spark, sf):
    p = st.period_select(_lines(spark, sf))
    return p.select("ticker", F.col("period").cast("string").alias("period"), F.col("period_rank").cast("bigint").alias("period_rank"))


_DUPONT = _FX + _LK + f"""
, p as (select distinct ticker, period from fx_statement_lines where statement in ('income', 'balance')),
ps as (select * from (select *, row_number() over (partition by ticker order by period desc) as rk from p) where rk <= {L.MAX_PERIODS}),
d as (select v.ticker, v.period, revenue, net_income, total_assets, total_equity,
   {_sd('net_income', 'revenue')} as profit_margin, {_sd('revenue', 'total_assets')} as asset_turnover,
   {_sd('total_assets', 'total_equity')} as financial_leverage
  from v join ps on ps.ticker = v.ticker and ps.period = v.period),
dd as (select *, case when profit_margin <> 0 and asset_turnover <> 0 and financial_leverage <> 0
   then round(profit_margin * asset_turnover * financial_leverage, {L.RATIO_DIGITS}) end as roe from d)
"""


@query("dupont", _DUPONT + """
select ticker, cast(period as varchar) as period, revenue, net_income, total_assets, total_equity, profit_margin,
  asset_turnover, financial_leverage, roe from dd""")
def q_dupont(spark, sf):
    d = st.dupont(_lines(spark, sf))
    return d.withColumn("period", F.col("period").cast("string"))


@query("latest_financials", _DUPONT + """
, agg as (select ticker, max(period) as period, count(*) as n from dd group by ticker),
c as (select 'T' || cast(n_nationkey as varchar) as ticker, n_name as name, n_nationkey as cik from nation)
select c.ticker, c.name || ' (CIK ' || cast(c.cik as varchar) || ')' as headline, cast(agg.period as varchar) as period,
  dd.revenue as revenue_usd, dd.total_assets as total_assets_usd, cast(coalesce(agg.n, 0) as bigint) as n_periods,
  case when coalesce(agg.n, 0) > 0 then 'success' else 'error' end as status,
  case when coalesce(agg.n, 0) = 0 then 'financials_present_but_no_period_data_extracted' end as error_message
from c left join agg on agg.ticker = c.ticker left join dd on dd.ticker = agg.ticker and dd.period = agg.period""")
def q_latest_fin(spark, sf):
    return st.latest_financials(_lines(spark, sf), _companies(spark, sf)).withColumn("period", F.col("period").cast("string"))


def _r4(a, b):
    return f"case when {a} is not null and {a} <> 0 and {b} is not null and {b} <> 0 then round({a} / {b}, {L.INTENSITY_DIGITS}) end"


@query("asset_intensity", _FX + _LK + f"""
select ticker, cast(period as varchar) as period, total_assets as total_assets_usd,
  {_r4('ppe', 'total_assets')} as fixed_asset_intensity, {_r4('operating_income', 'revenue')} as operating_margin,
  {_r4('rnd', 'revenue')} as rd_to_revenue_ratio from v""")
def q_intensity(spark, sf):
    return st.asset_intensity(_lines(spark, sf)).withColumn("period", F.col("period").cast("string"))


_MARGINS = _FX + _LK + f"""
, cm as (select v.ticker, v.period,
   {_sd('case when has_operating_income then operating_income else net_income end', 'revenue')} as operating_margin,
   {_sd('rnd', 'revenue')} as rd_to_revenue_ratio, not has_operating_income as is_fallback
  from v join np on np.ticker = v.ticker and np.period = v.period and np.statement = 'income')
"""


@query("company_margins", _MARGINS + """
select ticker, cast(period as varchar) as period, operating_margin, rd_to_revenue_ratio, is_fallback from cm""")
def q_margins(spark, sf):
    return st.company_margins(_lines(spark, sf)).withColumn("period", F.col("period").cast("string"))


@query("balance_items", _FX + _LK + """
select v.ticker, cast(v.period as varchar) as period, intangible as intangible_assets_usd, ppe as ppe_usd
from v join np on np.ticker = v.ticker and np.period = v.period and np.statement = 'balance'""")
def q_balance(spark, sf):
    return st.balance_items(_lines(spark, sf)).withColumn("period", F.col("period").cast("string"))


@query("capital_needs", _FX + _LK + """
select v.ticker, cast(v.period as varchar) as period, capex as capex_usd, free_cash_flow as free_cash_flow_usd
from v join np on np.ticker = v.ticker and np.period = v.period and np.statement = 'cashflow'""")
def q_capital(spark, sf):
    return st.capital_needs(_lines(spark, sf)).withColumn("period", F.col("period").cast("string"))


def _any(words):
    return "(" + " or ".join(f"contains(lower(segment), {q(w)})" for w in words) + ")"


@query("segment_revenue", _FX + _LK + f"""
, r as (select l.ticker, l.period, l.line_no, regexp_replace(l.label, '^\\s+|\\s+$', '', 'g') as segment, l.value as revenue_usd
  from fx_statement_lines l join np on np.ticker = l.ticker and np.period = l.period and np.statement = 'income'
  where l.statement = 'income' and regexp_matches(l.label, {ci(L.LABEL_SEGMENT_REVENUE)}) and l.value is not null)
select ticker, cast(period as varchar) as period, line_no, segment, revenue_usd, kind from
 (select *, case when {_any(L.GEO_SEGMENT_WORDS)} then 'geographic' when {_any(L.PRODUCT_SEGMENT_WORDS)} then 'product' end as kind from r)
where kind is not null""")
def q_segments(spark, sf):
    return st.segment_revenue(_lines(spark, sf)).withColumn("period", F.col("period").cast("string"))


@query("statement_unpivot", _FX + """
, k as (select distinct ticker, statement, line_no, label from fx_statement_lines),
yr as (select min(year(o_orderdate)) as a, max(year(o_orderdate)) as b from orders),
p as (select cast(y as varchar) || '-' || d as period from (select unnest(range(a, b + 1)) as y from yr) cross join (values ('09-30'), ('12-31')) as t(d))
select k.ticker, k.statement, k.line_no, k.label, p.period, l.value from k cross join p
left join fx_statement_lines l on l.ticker = k.ticker and l.line_no = k.line_no and cast(l.period as varchar) = p.period""")
def q_unpivot(spark, sf):
    """Wide statements: a line has a cell for every period of the orders' years, without a value where it has none, and other columns."""
    cell = F.struct(F.col("period").cast("string").alias("key"), F.col("value").cast("double").alias("value"))
    filed = _lines(spark, sf).groupBy("ticker", "statement", "line_no", "label").agg(F.collect_list(cell).alias("c"))
    other = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(1.0).alias("value")) for k in ("standard_concept", "2024", "depth", "2024/12/31")])
    year = F.year("o_orderdate")
    years = tables.table(spark, sf, "orders").select(F.min(year).alias("a"), F.max(year).alias("b"))
    ends = F.flatten(F.transform(F.sequence("a", "b"), lambda y: F.array(*[F.concat(y.cast("string"), F.lit(f"-{d}")) for d in ("09-30", "12-31")])))
    wide = filed.withColumn("ends", years.select(ends).scalar())
    own = F.map_from_entries(F.filter("c", lambda x: x["key"].isNotNull()))
    cells = F.transform("ends", lambda p: F.struct(p.alias("key"), F.try_element_at(own, p).alias("value")))
    return st.unpivot_cells(wide.withColumn("cells", F.map_from_entries(F.concat(cells, other))))
