"""Registered queries: URL resolution, domains and the company registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from moatlens.functions import lexicons as L
from moatlens.operators import urls as U
from moatlens.plans.registry import q, query
from moatlens.sources import fixtures as X
from moatlens.sources import tables


def _sitemaps(spark, sf):
    """Dealt out by domain: the test table is one unsplittable file, and checking documents is CPU-bound."""
    return X.fixture(spark, sf, "fx_sitemaps").repartition(2 * spark.sparkContext.defaultParallelism, "domain", "url")


def _locs(spark, sf):
    return U.sitemap_locs(_sitemaps(spark, sf))


_DECODE = ("replace(replace(replace(replace(replace(replace(replace({0}, '&#38;', '&'), '&#x41;', 'A'), "
           "'&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', chr(39)), '&amp;', '&')")
# Whether a body is well-formed was planted; indexes are followed to their leaves from child to child.
_LOCS = X.cte("fx_sitemaps").replace("with ", "with recursive ", 1) + f"""
, ok as (select distinct domain, url, contains(body, '<sitemapindex') as is_index, regexp_replace(body, '(?s)<!--.*?-->', '', 'g') as body from fx_sitemaps where planted_ok),
raw as (select domain, url, is_index, regexp_extract_all(body, '(?s)<loc>(.*?)</loc>', 1) as l from ok),
el as (select domain, url, is_index, unnest(l) as r, unnest(range(0, len(l))) as pos from raw),
dec as (select domain, url, is_index, pos, case when contains(r, '<![CDATA[') then trim(replace(replace(r, '<![CDATA[', ''), ']]>', ''))
   else {_DECODE.format("trim(r)")} end as loc from el),
way as (select domain, loc as url, pos + 1 as child from dec where is_index and url = 'https://' || domain || '/sitemap.xml'
   union select dec.domain, dec.loc, way.child from way join dec on dec.domain = way.domain and dec.url = way.url and dec.is_index),
first_way as (select domain, url, min(child) as child from way group by domain, url),
locs as (select domain, 0 as child, url as sitemap_url, pos, loc from dec where not is_index and url = 'https://' || domain || '/sitemap.xml'
   union all select w.domain, w.child, w.url, k.pos, k.loc from first_way w join dec k on k.domain = w.domain and k.url = w.url and not k.is_index)
"""


@query("sitemap_locs", _LOCS + "select domain, cast(child as bigint) as child, sitemap_url, cast(pos as bigint) as pos, loc from locs")
def q_sitemap_locs(spark, sf):
    return _locs(spark, sf).select("domain", F.col("child").cast("bigint").alias("child"), "sitemap_url",
                                   F.col("pos").cast("bigint").alias("pos"), "loc")


def _kw_case(kws):
    return "case " + " ".join(f"when contains(lower(loc), {q(k)}) then {i}" for i, k in enumerate(kws)) + " end"


_PATH = ("case when contains(loc, '/') then string_split(string_split(loc, '://')[-1] || '', '/')[1] end")
_PICK = _LOCS + ", cand as (" + " union all ".join(
    f"select domain, {q(f)} as feature, {_kw_case(kws)} as kw_idx, loc from locs" for f, kws in L.DISCOVERY_KEYWORDS) + """),
pp as (select domain, feature, kw_idx, loc,
   case when not contains(loc, '/') then 0
        when contains(split_part(loc, '://', 2), '/') or not contains(loc, '://')
        then length(case when contains(loc, '://') then substr(loc, strpos(loc, '://') + 3) else loc end)
             - strpos(case when contains(loc, '://') then substr(loc, strpos(loc, '://') + 3) else loc end, '/')
        else length(substr(loc, strpos(loc, '://') + 3)) end as path_len
  from cand where kw_idx is not null),
picks as (select domain, feature, arg_min(loc, (kw_idx, path_len, loc)) as url from pp group by domain, feature)
"""


@query("pick_url", _PICK + "select domain, feature, url from picks")
def q_pick(spark, sf):
    return U.pick_url(_locs(spark, sf))


_FB = "(values " + ", ".join(f"({q(f)}, {q(p)}, {i})" for f, ps in L.FALLBACK_PATHS for i, p in enumerate(ps)) + ") as c(feature, path, cand_ord)"
_PROBE = X.cte("fx_probes") + f"""
, okp as (select distinct domain, path from fx_probes where success and n_chars >= {L.PROBE_MIN_CHARS}),
probe as (select domain, feature, 'https://' || domain || arg_min(c.path, cand_ord) as url from okp join {_FB} using (path) group by domain, feature)
"""


@query("probe_pick", _PROBE + "select domain, feature, url from probe")
def q_probe(spark, sf):
    return U.probe_pick(X.fixture(spark, sf, "fx_probes"))


_SLUG = "regexp_replace(replace(replace(lower(s_name), '_', '-'), ' ', '-'), '[^a-z0-9\\-]', '', 'g')"


@query("ats_candidates", f"""
with s as (select s_name as company, {_SLUG} as slug from supplier)
select company, slug, cast(b.board_no as bigint) as board_no, b.pre || slug || b.post as url
from s cross join (values {', '.join(f"({i}, {q(t.split('{slug}')[0])}, {q(t.split('{slug}')[1])})" for i, t in enumerate(L.ATS_TEMPLATES))}) as b(board_no, pre, post)
where slug <> ''""")
def q_ats(spark, sf):
    s = tables.table(spark, sf, "supplier").select(F.col("s_name").alias("company"))
    return U.ats_candidates(s).withColumn("board_no", F.col("board_no").cast("bigint"))


@query("domain_reachability", X.cte("fx_probes") + """
select domain, bool_or(success or not (contains(lower(coalesce(error_message, '')), 'timeout')
   or contains(lower(coalesce(error_message, '')), 'err_connection'))) as reachable from fx_probes group by domain""")
def q_reach(spark, sf):
    return U.domain_reachability(X.fixture(spark, sf, "fx_probes"))


_ATS_SQL = X.cte("fx_ats_probes").replace("with ", ", ", 1) + f"""
, dm as (select distinct domain, replace(domain, '.com', '') as company from fx_sitemaps),
ac as (select company, b.board_no, b.pre || company || b.post as url from dm
  cross join (values {', '.join(f"({i}, {q(t.split('{slug}')[0])}, {q(t.split('{slug}')[1])})" for i, t in enumerate(L.ATS_TEMPLATES))}) as b(board_no, pre, post)),
ats as (select company, arg_min(ac.url, board_no) as url from ac join (select distinct url from fx_ats_probes where success and n_chars >= {L.ATS_MIN_CHARS}) f using (url) group by company),
rc as (select domain, bool_or(success or not (contains(lower(coalesce(error_message, '')), 'timeout')
   or contains(lower(coalesce(error_message, '')), 'err_connection'))) as reachable from fx_probes group by domain)
"""


@query("resolve_urls", _PICK + _PROBE.replace(X.cte("fx_probes"), ", fx_probes as (" + X.render("fx_probes", "duckdb") + ")\n") + _ATS_SQL + """
select dm.domain, dm.company, coalesce(rc.reachable, true) as reachable,
  case when coalesce(rc.reachable, true) then coalesce(sp.url, pp2.url) end as pricing_url,
  case when coalesce(rc.reachable, true) then case when sp.url is not null then 'sitemap' when pp2.url is not null then 'probe' end end as pricing_source,
  'https://' || dm.domain as messaging_url,
  case when coalesce(rc.reachable, true) then coalesce(ss.url, ps.url, ats.url) end as signals_url,
  case when coalesce(rc.reachable, true) then case when ss.url is not null then 'sitemap' when ps.url is not null then 'probe'
       when ats.url is not null then 'ats' end end as signals_source,
  case when cast(substr(dm.company, 5) as bigint) % 3 = 0 then 'https://www.capterra.com/p/' || substr(dm.company, 5) || '/' || dm.company || '/reviews/' end as complaints_url
from dm left join rc using (domain)
left join picks sp on sp.domain = dm.domain and sp.feature = 'pricing'
left join picks ss on ss.domain = dm.domain and ss.feature = 'signals'
left join probe pp2 on pp2.domain = dm.domain and pp2.feature = 'pricing'
left join probe ps on ps.domain = dm.domain and ps.feature = 'signals'
left join ats on ats.company = dm.company""")
def q_resolve(spark, sf):
    domains = X.fixture(spark, sf, "fx_sitemaps").select("domain", F.replace(F.col("domain"), F.lit(".com"), F.lit("")).alias("company")).distinct()
    number = F.substring("company", 5, 20)
    domains = domains.select("*", F.when(number.cast("bigint") % 3 == 0, number).alias("review_id"), F.col("company").alias("review_slug"))
    ats = U.ats_pick(U.ats_candidates(domains.select("company")), X.fixture(spark, sf, "fx_ats_probes"))
    return U.resolve_urls(domains, _locs(spark, sf), X.fixture(spark, sf, "fx_probes"), ats)


_RAW_DOMAINS = """(select page_id, url as raw from pages
  union all select 1000000 + s_suppkey, case s_suppkey % 4 when 0 then concat(' HTTPS://www.Site-', cast(s_suppkey as string), '.com/ ')
    when 1 then concat('site', cast(s_suppkey as string), '.co.uk') when 2 then concat('-bad', cast(s_suppkey as string), '.com') else concat('http://a.b', cast(s_suppkey as string)) end from supplier)"""


@query("domain_normalize", f"""
with d as (select page_id, raw, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')),
   '^https?://', ''), '^www\\.', ''), '/+$', '') as domain from {_RAW_DOMAINS})
select page_id, domain, regexp_matches(domain, '^(?:[a-zA-Z0-9](?:[a-zA-Z0-9\\-]{{0,61}}[a-zA-Z0-9])?\\.)+[a-zA-Z]{{2,}}$') as is_valid,
  regexp_replace(lower(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')), '\\s+', '-', 'g') as company_key from d""")
def q_domains(spark, sf):
    tables.register(spark, sf, ("pages", "supplier"))
    p = spark.sql(f"select * from {_RAW_DOMAINS}")
    d = U.domain_normalize(F.col("raw"))
    return p.select("page_id", d.alias("domain"), U.domain_valid(d).alias("is_valid"),
                    U.company_key(F.col("raw")).alias("company_key"))


def _registry(spark, sf):
    c = X.fixture(spark, sf, "fx_companies").withColumn("review_slug", F.lit(None).cast("string"))
    return c.filter(F.col("origin") == "builtin"), c.filter(F.col("origin") == "saved")


@query("registry_merge", X.cte("fx_companies") + """
, b as (select * from fx_companies where origin = 'builtin'), s as (select * from fx_companies where origin = 'saved'),
m as (select company, domain, review_id, entry_no, 'builtin' as origin from b
  union all
  select company, domain, review_id, entry_no, 'saved' as origin from s
  where not exists (select 1 from b where b.company is not distinct from s.company and b.domain is not distinct from s.domain
    and b.review_id is not distinct from s.review_id))
select company, domain, review_id, cast(null as varchar) as review_slug, origin, row_number() over (order by origin, entry_no) - 1 as position from m""")
def q_merge(spark, sf):
    b, s = _registry(spark, sf)
    return U.registry_merge(b, s, order="entry_no")


@query("registry_upsert", X.cte("fx_companies") + """
, b as (select * from fx_companies where origin = 'builtin'), s as (select * from fx_companies where origin = 'saved'),
n as (select company, domain, review_id, entry_no from b union all select company, domain, 'again', entry_no + case when entry_no % 2 = 0 then 1 else -1 end from b),
f as (select *, row_number() over (partition by company, domain order by entry_no) as rn from n)
select company, domain, review_id, cast(null as varchar) as review_slug from s
union all
select company, domain, review_id, cast(null as varchar) as review_slug from f
where rn = 1 and not exists (select 1 from s where s.company = f.company and s.domain = f.domain)""")
def q_upsert(spark, sf):
    """New entries come twice, in an order of their own."""
    b, s = _registry(spark, sf)
    step = F.when(F.col("entry_no") % 2 == 0, 1).otherwise(-1)
    again = b.withColumn("review_id", F.lit("again")).withColumn("entry_no", F.col("entry_no") + step)
    return U.registry_upsert(s, b.unionByName(again), "entry_no")
