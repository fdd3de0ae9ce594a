"""Derived input views over the landed tables.

The raw test text holds almost none of the trigger words the extractors look
for, so the extractors are exercised on pages derived from the TPC-H-like
tables. Each view is one portable SQL text that runs unchanged in Spark SQL and
in DuckDB (the oracle uses it as its first CTE), so both engines see the same
input rows. Work grows with the base tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from moatlens.sources import tables

FX_PRICING_PAGES = """
select p_partkey as page_id, p_brand as company, concat_ws(chr(10),
  case when p_partkey % 3 = 0 then '# Simple pricing for every Team' else '# One price, all-inclusive' end,
  case when p_partkey % 4 < 2 then concat('## Pro plan: $', cast(cast(floor(p_retailprice) as bigint) as string), ' per user per month') end,
  case when p_partkey % 5 < 2 then concat('Starter is $', cast(p_size as string), '/mo billed yearly, or $', cast(p_size * 10 as string), ' per year') end,
  case when p_partkey % 7 < 3 then 'Start free trial today, no credit card needed. Free plan at $0 for small teams' end,
  case when p_partkey % 6 = 0 then 'Contact sales for Enterprise, from $3,600 monthly' end,
  concat('Grow your ', p_name, ' Business for only $', cast(p_size as string), '.')) as markdown
from part
"""

FX_MESSAGING_PAGES = """
select c_custkey as page_id, concat('co', cast(c_custkey % 40 as string)) as company, concat_ws(chr(10),
  case when c_custkey % 4 <> 3 then concat('# The easy way to grow revenue in ', lower(c_mktsegment)) end,
  case when c_custkey % 6 = 0 then '# Fast and simple' end,
  case when c_custkey % 2 = 0 then '## Built for small business and startup teams' else '## Enterprise security, trusted by fortune 500' end,
  case when c_custkey % 3 = 0 then '## A powerful api for every developer' end,
  case when c_custkey % 5 = 0 then '### AI-powered, seamless, end-to-end' end,
  concat('Trusted by ', cast(c_custkey * 10 as string), '+ companies and thousands of teams'),
  case when c_custkey % 7 < 2 then '99.9% uptime, guaranteed and certified' end,
  case when c_custkey % 3 < 2 then 'Get started today. Book a demo or contact sales.' else 'Learn more' end,
  'Affordable, fast and easy to use for your team, today and now') as markdown
from customer
"""

FX_REVIEW_PAGES = """
select o_orderkey as page_id, concat('co', cast(o_custkey % 50 as string)) as company, concat_ws(chr(10),
  case when o_orderkey % 3 = 0 then 'The product is expensive and the pricing is too much for us' end,
  case when o_orderkey % 4 = 0 then 'It is slow and buggy, we saw a crash and another crash' end,
  case when o_orderkey % 5 = 0 then 'I wish it had offline calendar export for our people' end,
  case when o_orderkey % 6 < 2 then 'We switched from hubspot, compared to zoho this lacks custom dashboards' end,
  case when o_orderkey % 7 < 3 then 'Great support team, we love it and highly recommend it' end,
  case when o_orderkey % 9 = 2 then 'The app is missing a bulk import wizard and cannot export large archives' end,
  case when o_orderkey % 9 = 4 then 'We need better mobile widgets and would like to see dark mode themes' end,
  case when o_orderkey % 9 = 6 then 'There is no native calendar sync and limited storage for attachments.' end,
  case when o_orderkey % 8 = 1 then 'Terrible onboarding, the worst documentation, awful wait time' end,
  '* [Pricing and plans page](https://example.com/pricing)',
  'short line',
  concat('Overall rating for order ', cast(o_orderkey as string), ' is recorded here')) as markdown
from orders
"""

FX_JOBS_PAGES = """
select c_custkey as page_id, concat('co', cast(c_custkey % 40 as string)) as company, concat_ws(chr(10),
  case when c_custkey % 2 = 0 then 'Senior Software Engineer, backend platform, London' end,
  case when c_custkey % 3 = 0 then 'Data Scientist, machine learning and api, remote' end,
  case when c_custkey % 4 = 0 then 'Account Executive, new york office' end,
  case when c_custkey % 5 < 2 then 'Customer Success Manager, onboarding, fully remote' end,
  case when c_custkey % 6 = 0 then 'Director of Compliance, head of security engineer team' end,
  case when c_custkey % 7 < 2 then 'Junior content writer, seo, singapore, in-office' end,
  'Open positions and benefits') as markdown
from customer
"""

FX_SNAPSHOTS = """
select concat('co', cast(p_partkey as string)) as company,
  cast(concat('2024-0', cast(v + 1 as string), '-01') as date) as snapshot_date,
  concat_ws('|', case when (p_partkey + v) % 3 = 0 then 'Free' end, 'Pro', case when (p_partkey * 2 + v) % 5 = 0 then 'Enterprise' end) as tiers,
  concat_ws('|', concat('$', cast(p_size + (p_partkey * v) % 2 as string), '/mo'), case when (p_partkey + v) % 4 = 0 then '$99/mo' end) as monthly_prices,
  (p_partkey + v) % 3 = 0 as has_free_tier, (p_partkey + 2 * v) % 7 = 0 as requires_sales_call,
  concat('Headline ', cast((p_partkey + v) % 2 as string)) as main_headline,
  case when (p_partkey + v) % 5 = 0 then null else concat('dept', cast((p_partkey * (v + 1)) % 4 as string)) end as biggest_hiring_push,
  10 + (p_partkey * (v + 1)) % 17 as score_ux, 5 + (p_partkey * (v + 2)) % 13 as score_perf, (p_partkey * (v + 1)) % 6 as score_price,
  (p_partkey + v) % 11 = 0 as st_pricing, (p_partkey + 2 * v) % 13 = 0 or (p_partkey + v) % 23 = 5 as st_messaging,
  (p_partkey * 3 + v) % 17 = 0 as st_signals, (p_partkey + v) % 19 = 0 as st_complaints,
  (p_partkey + v) % 23 <> 5 as tried_messaging, (p_partkey + 2 * v) % 7 <> 3 as has_signals,
  concat_ws('|', 'smb', case when (p_partkey + v) % 3 = 0 then 'enterprise' end, case when (p_partkey + v) % 4 = 1 then 'developers' end) as segments,
  case when (p_partkey + v) % 6 <> 0 then concat('cta', cast((p_partkey + v) % 2 as string)) end as cta,
  concat_ws('|', 'price', case when (p_partkey + v) % 2 = 0 then 'ease' end, case when (p_partkey + v) % 5 = 1 then 'speed' end) as positioning,
  concat_ws('|', 'ai', case when (p_partkey + v) % 3 = 1 then 'security' end) as tech,
  concat_ws('|', 'us', case when (p_partkey + 2 * v) % 4 = 2 then 'apac' end) as geo,
  case (p_partkey + v) % 4 when 0 then 'hybrid' when 1 then 'remote' end as remote,
  concat_ws('|', 'zoho', case when (p_partkey + v) % 3 = 2 then 'hubspot' end) as competitors
from part @@EXPAND t|v|(0),(1),(2),(3)@@
where not (v = 3 and p_partkey % 5 = 0)
"""

FX_STATEMENT_LINES = """
with y as (select c_nationkey as n, year(o_orderdate) as yr, cast(count(*) as bigint) as cnt, cast(floor(sum(o_totalprice)) as bigint) as rev
  from orders join customer on o_custkey = c_custkey group by c_nationkey, year(o_orderdate))
select concat('T', cast(n as string)) as ticker,
  cast(concat(cast(yr as string), case when (l.statement = 'balance' and n % 5 = 0) or (l.statement = 'cashflow' and n % 3 = 0) or (l.statement = 'income' and n % 8 = 3) then '-09-30' else '-12-31' end) as date) as period, l.statement, l.line_no, l.label,
  case l.line_no when 1 then rev when 2 then case when (n + yr) % 9 = 0 then null else rev * 3 / 10 end
    when 3 then rev * (2 + (n * 7 + yr) % 11) / 50 when 4 then rev * (1 + n % 6) / 40 when 5 then rev * 2 / 5 when 6 then rev * 3 / 5
    when 7 then cnt * 100 when 8 then cnt * 250 when 9 then rev * 2 + cnt * 1000 when 10 then case when n % 8 = 0 then 0 else rev * 4 / 5 + cnt * 700 end
    when 11 then case when n % 4 <> 3 then rev / 10 end when 12 then rev / 20 - cnt * 300 end as value
from y @@EXPAND l|line_no, statement, label|(1, 'income', 'Total Revenue'), (2, 'income', 'Operating Income'), (3, 'income', 'Net Income'),
  (4, 'income', 'Research and Development'), (5, 'income', 'Revenue - Europe'), (6, 'income', 'Product Sales'),
  (7, 'balance', 'Intangible Assets, Net'), (8, 'balance', 'Property, Plant and Equipment, Net'),
  (9, 'balance', 'Total Assets'), (10, 'balance', 'Total Stockholders Equity'),
  (11, 'cashflow', 'Capital Expenditures'), (12, 'cashflow', 'Free Cash Flow')@@
where not (l.line_no = 2 and n % 6 = 1) and not (l.line_no = 6 and n % 7 = 2) and n <> 24
"""

# Of an event filing's items some are missing: then header items, then the description, then the form say what it is.
FX_FILINGS = """
select concat('T', cast(o_custkey % 25 as string)) as ticker, o_orderkey as filing_id,
  case o_orderkey % 6 when 0 then '10-K' when 1 then '8-K' when 2 then '4' when 3 then '3' when 4 then '5' else 'DEF 14A' end as form,
  cast(o_orderdate as date) as filed_date, o_orderkey % 10 = 0 as amended,
  case when cast(floor(o_orderkey / 6) as bigint) % 4 = 0 then null else concat_ws('; ', concat('Item ', cast(o_orderkey % 9 as string), '.01'), case when o_orderkey % 3 = 0 then 'Item 9.01' end) end as items,
  case when cast(floor(o_orderkey / 6) as bigint) % 16 = 4 then concat('Item 5.0', cast(o_orderkey % 4 as string)) when cast(floor(o_orderkey / 6) as bigint) % 16 = 12 then '' end as header_items,
  case when cast(floor(o_orderkey / 6) as bigint) % 8 = 0 then '' else concat('Filing of ', o_orderpriority) end as description
from orders
"""

# Two of three filings report their transactions in one list, the others by kind of security.
FX_INSIDER_TXNS = """
select l_orderkey as filing_id, l_linenumber as line_no, case when l_suppkey % 11 = 0 then null else concat('Owner ', cast(l_suppkey as string)) end as insider_name,
  case when l_suppkey % 3 = 0 then 'Director' end as officer_title,
  case when l_orderkey % 3 = 0 then case when l_linenumber % 2 = 0 then 'derivative' else 'non_derivative' end
    when l_linenumber % 3 = 2 then 'non_derivative' else 'transactions' end as kind,
  case when l_linenumber = 6 then null else case l_returnflag when 'R' then 'S' when 'A' then 'P' else case when l_linenumber % 2 = 0 then 'M' else 'X' end end end as code,
  case when l_linenumber = 3 then 0 else cast(floor(l_quantity) as bigint) end as transaction_shares,
  cast(floor(l_quantity) as bigint) + 1 as shares,
  case l_linenumber % 4 when 1 then 0 when 2 then null else cast(floor(l_extendedprice) as bigint) end as transaction_price_per_share,
  cast(floor(l_extendedprice) as bigint) + 7 as price_per_share
from lineitem
"""

# Annual reports as whole texts: a table of contents, then items with the words of a
# document; item names also stand within lines, and some reports lack an item.
FX_ANNUAL_REPORTS = """
select concat(source, '-', cast(doc_id % 40 as string)) as ticker, doc_id as filing_id,
  concat_ws(chr(10), 'TABLE OF CONTENTS', 'Item 1. Business 3', 'Item 1A. Risk Factors 9', '  ITEM 7. Discussion 20', 'PART I', '',
    'Item 1. Business', substring(text, 1, 3000), 'See Item 7. for more.', 'Our climate and governance report', concat('ITEM 1a:  Risk Factors of ', cast(doc_id as string)),
    case when doc_id % 5 <> 0 then text end, 'Diversity matters', case when doc_id % 3 <> 0 then 'item 7. Discussion' end, substring(text, 2, 100), 'Item 15. Exhibits', 'none') as body
from documents where doc_id % 4 <> 0
"""

# ``planted_ok`` says whether a body was planted well-formed; only the oracle reads it.
FX_SITEMAPS = """
select concat('site', cast(p_partkey as string), '.com') as domain, concat('https://site', cast(p_partkey as string), '.com/sitemap.xml') as url,
  case when p_partkey % 7 = 3 then concat('<?xml version="1.0" encoding="UTF-8"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><!-- <sitemap><loc>https://old</loc></sitemap> -->',
    '<sitemap><loc>https://site', cast(p_partkey as string), '.com/a.xml</loc></sitemap><sitemap><loc>https://site', cast(p_partkey as string), '.com/none.xml</loc></sitemap>',
    '<sitemap><loc>https://site', cast(p_partkey as string), '.com/c.xml</loc></sitemap><sitemap><loc><![CDATA[https://site', cast(p_partkey as string), '.com/d.xml]]></loc></sitemap>',
    '<sitemap><loc>https://shared.net/s.xml</loc></sitemap></sitemapindex>')
  else concat('<urlset>',
  '<url><loc> https://site', cast(p_partkey as string), '.com/blog/pricing-guide </loc></url>',
  case when p_partkey % 4 = 1 then concat('<url><loc><![CDATA[ https://site', cast(p_partkey as string), '.com/plans?a=1&b=2 ]]></loc></url>') else '' end,
  case when p_partkey % 6 = 1 then concat('<!-- <url><loc>https://site', cast(p_partkey as string), '.com/pricing</loc></url> --><url><loc>https://site', cast(p_partkey as string), '.com/x?a=1&#38;b=&#x41;&amp;c</loc></url>') else '' end,
  case when p_partkey % 2 = 0 then concat('<url><loc>https://site', cast(p_partkey as string), '.com/pricing</loc></url>') else '' end,
  case when p_partkey % 3 = 0 then concat('<url><loc>https://site', cast(p_partkey as string), '.com/careers/jobs</loc></url>') else '' end,
  case p_partkey % 20 when 0 then '<url><loc>broken' when 5 then '<url></urlset>' when 10 then '<url><loc>crossed</url></loc></urlset>' when 15 then '</urlset><urlset></urlset>'
    when 11 then '<url><loc>a?b&c</loc></url></urlset>' else '</urlset>' end) end as body,
  p_partkey % 7 = 3 or not p_partkey % 20 in (0, 5, 10, 15, 11) as planted_ok
from part
union all
select concat('site', cast(p_partkey as string), '.com'), case when k.name = 's' then 'https://shared.net/s.xml' else concat('https://site', cast(p_partkey as string), '.com/', k.name, '.xml') end,
  case when k.name = 'd' and p_partkey % 2 = 0 then concat('<sitemapindex><sitemap><loc>https://site', cast(p_partkey as string), '.com/e.xml</loc></sitemap><sitemap><loc>https://site',
    cast(p_partkey as string), '.com/d.xml</loc></sitemap></sitemapindex>')
  else concat('<urlset><url><loc>https://site', cast(p_partkey as string), '.com/', k.name, k.path, '</loc></url></urlset>') end, true
from part @@EXPAND k|name, path|('a', '/about'), ('a', '/about'), ('c', '/careers'), ('d', '/pricing'), ('e', '/plans'), ('s', '/jobs')@@
where p_partkey % 7 = 3
"""

FX_PROBES = """
select concat('site', cast(p_partkey as string), '.com') as domain, t.path, t.ord,
  p_partkey % 11 <> 4 and (p_partkey + t.ord) % 3 <> 0 as success,
  (p_partkey * (t.ord + 3)) % 1000 as n_chars,
  case when p_partkey % 11 = 4 then 'net::ERR_CONNECTION_REFUSED' when (p_partkey + t.ord) % 3 = 0 then case when p_partkey % 2 = 0 then 'Timeout 8000ms' else 'HTTP 404' end end as error_message
from part @@EXPAND t|path, ord|('/pricing', 0), ('/plans', 1), ('/careers', 2), ('/jobs', 3)@@
"""

FX_COMPANIES = """
select 'builtin' as origin, concat('co', cast(s_suppkey as string)) as company, concat('site', cast(s_suppkey as string), '.com') as domain,
  case when s_suppkey % 3 = 0 then null else cast(1000 + s_suppkey as string) end as review_id, s_suppkey * 37 % 100003 as entry_no
from supplier
union all
select 'saved', concat('co', cast(s_suppkey * 2 as string)), concat('site', cast(s_suppkey * 2 as string), '.com'),
  case when s_suppkey % 3 = 0 then null else cast(1000 + s_suppkey * 2 as string) end, s_suppkey * 53 % 100003
from supplier
"""

# ---- views added for operators the eleven views above do not feed ----------

# Proxy compensation rows: line items of the DEF 14A filings of fx_filings.
# One of three source tables per row; an unnamed executive defaults to Unknown;
# a zero price is a non-numeric total.
FX_PROXY_COMP = """
select l_orderkey as filing_id, l_linenumber as row_no,
  case l_linenumber % 3 when 0 then 'executive_compensation' when 1 then 'compensation' else 'summary_compensation' end as source_table,
  case when l_suppkey % 7 = 0 then null else concat('Exec ', cast(l_suppkey as string)) end as name,
  case when l_partkey % 2 = 0 then 'Chief Officer' end as title,
  cast(floor(l_extendedprice) as bigint) * 100 as total
from lineitem
"""

# Company directory for peers: one entry per customer, industry = nation.
FX_DIRECTORY = """
select c_custkey as dir_ord, c_name as company_name, c_nationkey as sic,
  case when c_custkey % 11 = 0 then null else concat('C', cast(c_custkey as string)) end as ticker
from customer
"""

# Fetch log of job-board candidates (one row per probed URL), companies = parts.
FX_ATS_PROBES = """
select concat(t.pre, 'site', cast(p_partkey as string), t.post) as url,
  (p_partkey + t.b) % 4 <> 0 as success, (p_partkey * (37 + t.b)) % 400 as n_chars
from part @@EXPAND t|pre, post, b|('https://jobs.lever.co/', '', 1), ('https://', '.workable.com', 2)@@
"""

# Two crawls (day 1 and 2) of a company per part: targets with their fetches. Half of the
# targets were tried three times: a time-out, a page that came too early, and what counts.
FX_CRAWLS = """
select concat('co', cast(p_partkey as string)) as company, t.day, t.feature, a.attempt,
  case when (p_partkey + t.ord + t.day) % 9 <> 0 then concat('https://co', cast(p_partkey as string), '.com/', t.feature) end as url,
  a.attempt <> 3 and (p_partkey + 2 * t.ord + t.day) % 7 <> 0 as success,
  case when a.attempt = 3 then 'net::ERR_CONNECTION_RESET' when (p_partkey + 2 * t.ord + t.day) % 7 = 0 and p_partkey % 2 = 0 then concat('Timeout 8000ms', chr(10), 'at page') end as error_message,
  case when a.attempt = 1 then concat('# Free plan, pro plan $1/mo', chr(10), repeat('zzqx wvvk yyqj ', 40)) when a.attempt = 2 then concat(case t.feature when 'pricing' then concat('# Pro plan $', cast(p_size + t.day * (p_partkey % 3) as string), '/mo')
    when 'messaging' then concat('# Headline ', cast((p_partkey * t.day) % 3 as string))
    when 'signals' then case when (p_partkey + t.day) % 2 = 0 then 'recruiter wanted' else 'devops wanted' end
    else 'everybody here finds it overpriced' end, chr(10),
    case when (p_partkey + t.ord) % 5 = 0 then 'short' else repeat('zzqx wvvk yyqj ', 40) end) end as markdown
from part @@EXPAND t|feature, ord, day|('pricing', 0, 1), ('messaging', 1, 1), ('signals', 2, 1), ('complaints', 3, 1), ('pricing', 0, 2), ('messaging', 1, 2), ('signals', 2, 2), ('complaints', 3, 2)@@
@@EXPAND a|attempt|(2), (1), (3)@@
where (t.feature <> 'complaints' or p_partkey % 2 = 0) and (a.attempt = 2 or ((p_partkey + t.ord) % 2 = 0 and (p_partkey + t.ord) % 5 <> 0 and (p_partkey + 2 * t.ord + t.day) % 7 <> 0))
"""

VIEWS = {
    "fx_crawls": FX_CRAWLS,
    "fx_pricing_pages": FX_PRICING_PAGES,
    "fx_messaging_pages": FX_MESSAGING_PAGES,
    "fx_review_pages": FX_REVIEW_PAGES,
    "fx_jobs_pages": FX_JOBS_PAGES,
    "fx_snapshots": FX_SNAPSHOTS,
    "fx_statement_lines": FX_STATEMENT_LINES,
    "fx_filings": FX_FILINGS,
    "fx_annual_reports": FX_ANNUAL_REPORTS,
    "fx_insider_txns": FX_INSIDER_TXNS,
    "fx_sitemaps": FX_SITEMAPS,
    "fx_probes": FX_PROBES,
    "fx_companies": FX_COMPANIES,
    "fx_proxy_comp": FX_PROXY_COMP,
    "fx_directory": FX_DIRECTORY,
    "fx_ats_probes": FX_ATS_PROBES,
}


_EXPAND = re.compile(r"@@EXPAND (\w+)\|([^|]*)\|(.*?)@@", re.S)


def _split_rows(rows: str) -> list[str]:
    """'(a, b), (c, d)' -> ['a, b', 'c, d'] (values hold no parentheses)."""
    return [r.strip() for r in re.findall(r"\(([^()]*)\)", rows)]


def render(name: str, engine: str = "spark") -> str:
    """View SQL for one engine.

    A row expansion is a lateral ``inline`` of a literal array in Spark (a
    generator, no join) and a ``VALUES`` relation in DuckDB.
    """
    def sub(m):
        alias, cols, rows = m.group(1), m.group(2), m.group(3)
        if engine == "spark":
            structs = ", ".join(f"struct({r})" for r in _split_rows(rows))
            return f"lateral view inline(array({structs})) {alias} as {cols}"
        return f"cross join (values {rows}) as {alias}({cols})"
    return _EXPAND.sub(sub, VIEWS[name])


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the tables of ``sf_dir``."""
    sql = render(name, "spark")
    tables.register(spark, sf_dir, tables.referenced(sql))
    return spark.sql(sql)


def tasks(spark: SparkSession, sf_dir: str, table: str, rows: int) -> int:
    """In how many parts ``table`` is dealt out, so that one holds some ``rows`` of its rows however large it is."""
    return max(1, -(-tables.row_count(spark, sf_dir, table) // rows))


def dealt(spark: SparkSession, sf_dir: str, name: str, table: str, key: str, rows: int) -> DataFrame:
    """A derived view whose base table is dealt out by ``key``, some ``rows`` a task.

    A view makes several wide rows of one narrow base row, and the landed table
    may be one file that one task reads. The base rows are shuffled, before they
    grow; a table with fewer rows than that isn't.
    """
    n = tasks(spark, sf_dir, table, rows)
    if n == 1:
        return fixture(spark, sf_dir, name)
    sql = re.sub(rf"\bfrom {table}\b", f"from {table}_dealt", render(name, "spark"))
    tables.register(spark, sf_dir, tables.referenced(sql))
    tables.table(spark, sf_dir, table).repartition(n, key).createOrReplaceTempView(f"{table}_dealt")
    return spark.sql(sql)


def pages(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A page view, dealt out by page id.

    The test tables are one unsplittable file each, while extraction is
    CPU-bound; real page tables of many files need no such shuffle.
    """
    return fixture(spark, sf_dir, name).repartition(2 * spark.sparkContext.defaultParallelism, "page_id")


def cte(*names: str) -> str:
    """``WITH`` clause defining the named views, for oracle SQL."""
    return "with " + ",\n".join(f"{n} as ({render(n, 'duckdb')})" for n in names) + "\n"
