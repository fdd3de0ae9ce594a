"""Registered queries: page gate and pricing extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from moatlens.functions import lexicons as L
from moatlens.functions import text as T
from moatlens.operators import pages, pricing
from moatlens.plans import sqlkit as S
from moatlens.plans.registry import q, query
from moatlens.sources import fixtures as X
from moatlens.sources import tables


def _pricing(spark, sf):
    return pricing.extract_pricing(X.pages(spark, sf, "fx_pricing_pages"))


@query("page_gate", f"""
select doc_id, n_chars,
  (text is not null and length(text) >= {L.MIN_PAGE_CHARS}) as accepted,
  case when not (text is not null and length(text) >= {L.MIN_PAGE_CHARS}) then {q(L.PAGE_ERROR_DEFAULT)} end as reject_reason
from documents""")
def q_page_gate(spark, sf):
    docs = tables.table(spark, sf, "documents").select("doc_id", "n_chars", F.col("text").alias("markdown"))
    return pages.page_gate(docs).select("doc_id", "n_chars", "accepted", "reject_reason")


_M = " || ".join(S.findall("markdown", p, 0, True) for p in L.PRICE_MONTHLY_PATTERNS)
_A = " || ".join(S.findall("markdown", p, 0, True) for p in L.PRICE_ANNUAL_PATTERNS)
_NORM = "list_transform({}, lambda p: regexp_replace(trim(p), '\\s+', ' ', 'g'))"


@query("price_mentions_monthly", X.cte("fx_pricing_pages") + f"""
, m as (select page_id, company, {_NORM.format('(' + _M + ')')} as l from fx_pricing_pages)
select page_id, company, {S.joined(S.dedupe('l'))} as monthly_prices, cast(len({S.dedupe('l')}) as bigint) as n_monthly from m""")
def q_monthly(spark, sf):
    df = X.pages(spark, sf, "fx_pricing_pages").select(
        "page_id", "company", pricing.monthly_prices(F.col("markdown")).alias("l"))
    return df.select("page_id", "company", T.join(F.col("l")).alias("monthly_prices"),
                     F.size("l").cast("bigint").alias("n_monthly"))


@query("price_mentions_annual", X.cte("fx_pricing_pages") + f"""
, m as (select page_id, company, {_NORM.format('(' + _A + ')')} as l from fx_pricing_pages)
select page_id, company, {S.joined(S.dedupe('l'))} as annual_prices, cast(len({S.dedupe('l')}) as bigint) as n_annual from m""")
def q_annual(spark, sf):
    df = X.pages(spark, sf, "fx_pricing_pages").select(
        "page_id", "company", pricing.annual_prices(F.col("markdown")).alias("l"))
    return df.select("page_id", "company", T.join(F.col("l")).alias("annual_prices"),
                     F.size("l").cast("bigint").alias("n_annual"))


_TIER = r"\b(" + "|".join(L.TIER_WORDS) + r")\b"
_TIERS_SQL = X.cte("fx_pricing_pages") + f"""
, pc as (select page_id, markdown, string_split(markdown, '$') as pcs from fx_pricing_pages),
pos as (select page_id, markdown,
   list_filter(list_transform(range(2, len(pcs) + 1), lambda k:
      case when regexp_matches(pcs[k], '^[0-9]')
           then cast(list_sum(list_transform(range(1, k), lambda j: length(pcs[j]))) + k - 2 as bigint) end),
      lambda p: p is not null) as starts
 from pc),
win as (select page_id, markdown, list_transform(starts, lambda p:
   substr(markdown, greatest(p - {L.PRICE_WINDOW_CHARS}, 0) + 1,
          least(length(markdown), p + 2 + {L.PRICE_WINDOW_CHARS}) - greatest(p - {L.PRICE_WINDOW_CHARS}, 0))) as wins
 from pos),
t as (select page_id,
   flatten(list_transform(list_filter({S.lines('markdown')}, lambda l: regexp_matches(l, '^\\s*#')),
                          lambda l: {S.findall('l', _TIER, 1, True)})) ||
   flatten(list_transform(list_filter(wins, lambda w: regexp_matches(w, {q('(?i)' + L.PRICING_CONTEXT_PATTERN)})),
                          lambda w: {S.findall('w', _TIER, 1, True)})) as raw
 from win),
tc as (select page_id, list_transform(raw, lambda x: upper(left(x, 1)) || lower(substr(x, 2))) as l from t)
"""


@query("tier_names", _TIERS_SQL + f"select page_id, {S.joined(S.dedupe('l'))} as tiers_found from tc")
def q_tiers(spark, sf):
    df = X.pages(spark, sf, "fx_pricing_pages")
    return df.select("page_id", T.join(pricing.tier_names(F.col("markdown"))).alias("tiers_found"))


@query("pricing_models", X.cte("fx_pricing_pages") + f"""
select page_id, {S.joined(S.classes('lower(markdown)', L.PRICING_MODELS))} as pricing_model from fx_pricing_pages""")
def q_models(spark, sf):
    df = X.pages(spark, sf, "fx_pricing_pages")
    return df.select("page_id", T.join(pricing.pricing_models(F.lower("markdown"))).alias("pricing_model"))


@query("trial_offers", X.cte("fx_pricing_pages") + f"""
select page_id, {S.joined(S.classes('lower(markdown)', L.TRIAL_OFFERS))} as trial_offers from fx_pricing_pages""")
def q_trials(spark, sf):
    df = X.pages(spark, sf, "fx_pricing_pages")
    return df.select("page_id", T.join(pricing.trial_offers(F.lower("markdown"))).alias("trial_offers"))


_VALS_SQL = X.cte("fx_pricing_pages") + f"""
, v as (select page_id, company, list_filter(list_transform({_M} || {_A}, lambda p:
     try_cast(replace(regexp_extract(p, '\\$([0-9,]+)', 1), ',', '') as bigint)),
     lambda x: x is not null and x > 0 and x < {L.PRICE_CAP}) as vals from fx_pricing_pages)
"""


@query("price_range", _VALS_SQL + """
select page_id, case when len(vals) > 0 then '$' || cast(list_min(vals) as varchar) end as price_lowest,
  case when len(vals) > 0 then '$' || cast(list_max(vals) as varchar) end as price_highest from v""")
def q_range(spark, sf):
    df = X.pages(spark, sf, "fx_pricing_pages").select(
        "page_id", pricing.price_values(F.col("markdown")).alias("v"))
    return df.select("page_id", pricing.price_label(F.array_min("v")).alias("price_lowest"),
                     pricing.price_label(F.array_max("v")).alias("price_highest"))


_FREE_SQL = _TIERS_SQL + f"""
, f as (select p.page_id, p.company,
   ({S.any_sub('lower(p.markdown)', dict(L.PRICING_MODELS)['freemium'])}
    or {S.any_sub('lower(p.markdown)', dict(L.TRIAL_OFFERS)['free_plan'])}
    or (list_contains(tc.l, 'Free') and regexp_matches(p.markdown, {q(L.ZERO_PRICE_PATTERN)}))
    or {S.any_sub('lower(p.markdown)', L.FREE_PHRASES)}) as has_free_tier,
   {S.any_sub('lower(p.markdown)', dict(L.PRICING_MODELS)['contact_sales'])} as requires_sales_call
 from fx_pricing_pages p join tc using (page_id))
"""


@query("has_free_tier", _FREE_SQL + "select page_id, has_free_tier from f")
def q_free(spark, sf):
    return _pricing(spark, sf).select("page_id", "has_free_tier")


@query("requires_sales_call", _FREE_SQL + "select page_id, requires_sales_call from f")
def q_sales(spark, sf):
    return _pricing(spark, sf).select("page_id", "requires_sales_call")


@query("pricing_summary", _FREE_SQL.replace(
    ", f as (", ", v as (select page_id, list_filter(list_transform(" + _M + " || " + _A
    + ", lambda p: try_cast(replace(regexp_extract(p, '\\$([0-9,]+)', 1), ',', '') as bigint)), "
    + f"lambda x: x is not null and x > 0 and x < {L.PRICE_CAP}) as vals, len({S.dedupe(_NORM.format('(' + _M + ')'))}) as n_monthly "
    + "from fx_pricing_pages)\n, f as (", 1) + """
select f.company, cast(count(*) as bigint) as n_pages, cast(count(*) filter (where v.n_monthly > 0) as bigint) as n_with_monthly,
  min(list_min(v.vals)) as lowest_price, max(list_max(v.vals)) as highest_price,
  cast(count(*) filter (where f.has_free_tier) as bigint) as n_free_tier,
  cast(count(*) filter (where f.requires_sales_call) as bigint) as n_sales_call,
  cast(sum(len(list_filter(tc.l, lambda x, i: list_position(tc.l, x) = i))) as bigint) as n_tier_mentions
from f join v using (page_id) join tc using (page_id) group by f.company""")
def q_pricing_summary(spark, sf):
    return pricing.pricing_summary(_pricing(spark, sf))
