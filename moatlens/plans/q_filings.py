"""Registered queries: filings, insiders, pay, events, ESG text, peers, identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from moatlens.functions import lexicons as L
from moatlens.operators import filings as fl
from moatlens.operators import identity, peers, statements
from moatlens.plans.registry import q, query
from moatlens.sources import fixtures as X
from moatlens.sources import tables


def _head(spark, sf):
    return fl.filings_head(X.fixture(spark, sf, "fx_filings"))


_NMAP = " ".join(f"when {q(k)} then {v}" for k, v in L.FILING_HEAD_N.items())
_HEAD = X.cte("fx_filings") + f"""
, fh as (select * from (select *, row_number() over (partition by ticker, form order by filed_date desc, filing_id desc) as filing_rank
   from fx_filings where form in ({', '.join(q(k) for k in L.FILING_HEAD_N)}) and not (form = '10-K' and amended))
  where filing_rank <= case form {_NMAP} end)
"""


@query("filings_head", _HEAD + """
select ticker, form, filing_id, cast(filed_date as varchar) as filed_date, cast(filing_rank as bigint) as filing_rank from fh""")
def q_filings_head(spark, sf):
    h = _head(spark, sf)
    return h.select("ticker", "form", "filing_id", F.col("filed_date").cast("string").alias("filed_date"),
                    F.col("filing_rank").cast("bigint").alias("filing_rank"))


@query("material_events", _HEAD + f"""
select ticker, filing_id, cast(filed_date as varchar) as filed_date, form as form_type,
  substr(coalesce(nullif(items, ''), nullif(header_items, ''), nullif(description, ''), form), 1, {L.MAX_EVENT_CHARS}) as description,
  coalesce(nullif(items, ''), nullif(header_items, ''), nullif(description, ''), form) as full_description
from fh where form = '8-K'""")
def q_events(spark, sf):
    ev = fl.material_events(_head(spark, sf).filter(F.col("form") == "8-K"))
    return ev.withColumn("filed_date", F.col("filed_date").cast("string"))


_CODES = " ".join(f"when {q(k)} then {q(v)}" for k, v in L.INSIDER_CODES)
_TX = X.cte("fx_filings", "fx_insider_txns").replace("with fx_insider_txns", ", fx_insider_txns") + _HEAD.replace(
    X.cte("fx_filings"), "") + f"""
, tk as (select *, bool_or(kind = 'transactions') over (partition by filing_id) as has_tx from fx_insider_txns)
, tx as (select fh.ticker, fh.form, fh.filing_id, fh.filed_date, t.line_no,
   coalesce(t.insider_name, 'Unknown') as insider_name, t.officer_title as title,
   case when t.code is null then 'Unknown' else case t.code {_CODES} else t.code end end as transaction_type,
   cast(case when t.transaction_shares is not null and t.transaction_shares <> 0 then t.transaction_shares else t.shares end as double) as shares,
   cast(coalesce(nullif(t.transaction_price_per_share, 0), t.price_per_share) as double) as price_per_share
  from fh join tk t on t.filing_id = fh.filing_id where fh.form in ('4', '3', '5') and (t.kind = 'transactions' or not t.has_tx))
"""


@query("insider_transactions", _TX + """
select ticker, form, filing_id, cast(filed_date as varchar) as filed_date, line_no, insider_name, title, transaction_type,
  shares, price_per_share from tx""")
def q_insider(spark, sf):
    t = fl.insider_transactions(_head(spark, sf), X.fixture(spark, sf, "fx_insider_txns"))
    return t.select("ticker", "form", "filing_id", F.col("filed_date").cast("string").alias("filed_date"), "line_no",
                    "insider_name", "title", "transaction_type", "shares", "price_per_share")


@query("insider_summary", _TX + """
select ticker, insider_name, cast(count(*) as bigint) as n_transactions,
  coalesce(sum(shares) filter (transaction_type = {buy}), 0) as bought_shares, coalesce(sum(shares) filter (transaction_type = {sell}), 0) as sold_shares,
  coalesce(sum(shares) filter (transaction_type not in ({buy}, {sell})), 0) as other_shares,
  coalesce(sum(shares) filter (transaction_type = {buy}), 0) - coalesce(sum(shares) filter (transaction_type = {sell}), 0) as net_shares,
  coalesce(sum(shares * price_per_share) filter (transaction_type = {buy}), 0) as bought_value,
  coalesce(sum(shares * price_per_share) filter (transaction_type = {sell}), 0) as sold_value
from tx group by ticker, insider_name""".format(buy=q(dict(L.INSIDER_CODES)["P"]), sell=q(dict(L.INSIDER_CODES)["S"])))
def q_insider_summary(spark, sf):
    t = fl.insider_transactions(_head(spark, sf), X.fixture(spark, sf, "fx_insider_txns"))
    return fl.insider_summary(t)


@query("executive_pay", X.cte("fx_filings", "fx_proxy_comp").replace("with fx_proxy_comp", ", fx_proxy_comp") + _HEAD.replace(
    X.cte("fx_filings"), "") + f"""
, pc as (select *, list_position({L.COMP_TABLES}, source_table) as prio from fx_proxy_comp),
best as (select *, min(prio) over (partition by filing_id) as bp from pc)
select fh.ticker, fh.filing_id, b.row_no, substr(cast(fh.filed_date as varchar), 1, 4) as year,
  coalesce(b.name, 'Unknown') as name, b.title, cast(b.total as double) as total_compensation_usd
from fh join best b on b.filing_id = fh.filing_id where fh.form = 'DEF 14A' and b.prio = b.bp""")
def q_exec_pay(spark, sf):
    return fl.executive_pay(_head(spark, sf), X.fixture(spark, sf, "fx_proxy_comp"))


# The second formulation goes line by line: a heading begins a piece, pieces are put together again by number.
def _items_sql(items):
    names = ", ".join(f"({q(i.upper().removeprefix('ITEM '))}, {q(i)})" for i in items)
    return X.cte("fx_annual_reports") + f""", nf as (select ticker, max(filing_id) as filing_id from fx_annual_reports group by ticker),
nb as (select r.* from fx_annual_reports r join nf using (ticker, filing_id)),
ln as (select ticker, filing_id, unnest(string_split(body, chr(10))) as line, unnest(range(0, len(string_split(body, chr(10))))) as line_no from nb),
hd as (select *, upper(regexp_extract(line, '^[ \\t]*(?i:item)[ \\t]+([0-9]{{1,2}}[a-cA-C]?)[.:]', 1)) as number from ln),
pc as (select *, sum(case when number <> '' then 1 else 0 end) over (partition by ticker order by line_no) as piece from hd),
tx as (select ticker, filing_id, piece, max(number) as number, string_agg(line, chr(10) order by line_no) as text from pc group by ticker, filing_id, piece having max(number) <> ''),
sec as (select nf.ticker, nf.filing_id, n.item, (select regexp_replace(arg_max(tx.text, length(tx.text)), '^\\s+|\\s+$', '', 'g') from tx where tx.ticker = nf.ticker and tx.number = n.number) as text
  from nf cross join (values {names}) as n(number, item))"""


@query("filing_section", f"""{_items_sql(["Item 1A", "Item 7"])}
select ticker, item, filing_id, cast(length(text) as bigint) as n_chars, text as section_text,
  case when length(text) > {L.MAX_TEXT_CHARS} then substr(text, 1, {L.MAX_TEXT_CHARS}) || {q(L.TRUNCATION_SUFFIX)} else text end as excerpt
from sec""")
def q_section(spark, sf):
    """Risk factors and management discussion: Items 1A and 7 of the newest report."""
    s = fl.filing_items(X.fixture(spark, sf, "fx_annual_reports"), {"Item 1A": 1, "Item 7": 2})
    return s.select("ticker", "item", "filing_id", F.length("text").cast("bigint").alias("n_chars"), F.col("text").alias("section_text"),
                    fl.truncate_text(F.col("text")).alias("excerpt"))


def _paras_sql(terms):
    cond = " or ".join(f"contains(lower(p), {q(t)})" for t in terms)
    return f"list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda p: {cond}), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g'))"


@query("esg_paragraphs", f"""{_items_sql(["Item 1", "Item 1A"])},
px as (select source || '-' || cast(doc_id % 40 as varchar) as ticker, doc_id, text from documents where doc_id % 4 = 0),
nq as (select ticker, flatten(list(p order by item)) as p from (select ticker, item, {_paras_sql(L.ESG_TERMS_10K)} as p from sec) group by ticker),
np as (select px.ticker, {_paras_sql(L.ESG_TERMS_PROXY)} as p from px join (select ticker, max(doc_id) as doc_id from px group by ticker) m using (ticker, doc_id)),
a as (select coalesce(nq.ticker, np.ticker) as ticker, coalesce(nq.p, []) || coalesce(np.p, []) as parts from nq full join np on nq.ticker = np.ticker)
select ticker, cast(len(parts) as bigint) as n_paragraphs,
  case when len(parts) > 0 then case when length(array_to_string(parts, chr(10))) > {L.MAX_TEXT_CHARS}
    then substr(array_to_string(parts, chr(10)), 1, {L.MAX_TEXT_CHARS}) || {q(L.TRUNCATION_SUFFIX)} else array_to_string(parts, chr(10)) end end as esg_text,
  case when len(parts) > 0 then array_to_string(parts, chr(10)) end as esg_full_text
from a""")
def q_esg(spark, sf):
    """Items 1 and 1A of the newest report, then the newest proxy statement (a document out of four)."""
    tenk = fl.filing_items(X.fixture(spark, sf, "fx_annual_reports"), {"Item 1": 1, "Item 1A": 2})
    d = tables.table(spark, sf, "documents").filter(F.col("doc_id") % 4 == 0)
    ticker = F.concat("source", F.lit("-"), (F.col("doc_id") % 40).cast("string"))
    proxy = fl.newest_text(d.select(ticker.alias("ticker"), "doc_id", "text"), "ticker", "doc_id", "text")
    return fl.esg_paragraphs(tenk, proxy)


# ----------------------------------------------------------------- peers ----
@query("industry_peers", X.cte("fx_directory") + """
, e as (select * from fx_directory where ticker is not null and ticker <> ''),
pr as (select a.ticker, a.sic, upper(b.ticker) as peer_ticker, b.company_name as peer_name,
   row_number() over (partition by a.ticker order by b.dir_ord) as peer_rank
  from e a join e b on a.sic = b.sic and upper(a.ticker) <> upper(b.ticker))
select ticker, sic, cast(peer_rank as bigint) as peer_rank, peer_ticker, peer_name from pr where peer_rank <= 4""")
def q_peers(spark, sf):
    p = peers.industry_peers(X.fixture(spark, sf, "fx_directory"))
    return p.withColumn("peer_rank", F.col("peer_rank").cast("bigint"))


def _nation_dir(spark, sf):
    n = tables.table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("dir_ord"), F.col("n_name").alias("company_name"),
                    F.col("n_regionkey").alias("sic"), F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("ticker"))


@query("peer_comparison", X.cte("fx_statement_lines") + """
, lk as (select ticker, period, label, value, line_no from fx_statement_lines where statement = 'income'),
np as (select ticker, max(period) as period from fx_statement_lines where statement = 'income' group by ticker),
m as (select lk.ticker,
   max(case when line_no = 1 then value end) as revenue, max(case when line_no = 3 then value end) as net_income,
   case when bool_or(line_no = 2) then max(case when line_no = 2 then value end) else max(case when line_no = 3 then value end) end as op, max(case when line_no = 4 then value end) as rnd
  from lk join np using (ticker, period) group by lk.ticker),
mm as (select ticker, case when revenue is not null and op is not null and revenue <> 0 then round(op / revenue, 6) end as operating_margin,
   case when revenue is not null and rnd is not null and revenue <> 0 then round(rnd / revenue, 6) end as rd_to_revenue_ratio from m),
d as (select 'T' || cast(n_nationkey as varchar) as ticker, n_name as company_name, n_regionkey as sic, n_nationkey as dir_ord from nation),
pr as (select a.ticker, upper(b.ticker) as peer_ticker, b.company_name,
   row_number() over (partition by a.ticker order by b.dir_ord) as peer_rank
  from d a join d b on a.sic = b.sic and upper(a.ticker) <> upper(b.ticker))
select pr.ticker, cast(pr.peer_rank as bigint) as peer_rank, pr.peer_ticker, pr.company_name, mm.operating_margin, mm.rd_to_revenue_ratio
from pr left join mm on mm.ticker = pr.peer_ticker where pr.peer_rank <= 4""")
def q_peer_comparison(spark, sf):
    p = peers.industry_peers(_nation_dir(spark, sf))
    m = statements.company_margins(X.fixture(spark, sf, "fx_statement_lines"))
    return peers.peer_comparison(p, m).withColumn("peer_rank", F.col("peer_rank").cast("bigint"))


# -------------------------------------------------------------- identity ----
def _registry(spark, sf):
    c = tables.table(spark, sf, "customer")
    n = tables.table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        F.col("c_custkey").alias("lei"), F.col("c_name").alias("legal_name"), F.col("n_name").alias("jurisdiction"),
        F.col("c_mktsegment").alias("status"), F.when(F.col("c_custkey") % 4 != 0, F.initcap("n_name")).alias("city"),
        F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).when(F.col("c_custkey") % 3 == 1, F.array(  # one in three lists no address, one has none
            F.concat(F.col("c_custkey").cast("string"), F.lit(" "), F.lower("c_mktsegment"), F.lit(" street")), F.lit("2nd floor"))).alias("address_lines"))


def _lookups(spark, sf):
    s = tables.table(spark, sf, "supplier")
    full = s.select(F.lower(F.regexp_replace("s_name", "Supplier", "customer")).alias("query"))
    short = s.select(F.regexp_replace(F.substring("s_name", 10, 9), "^0+", "").alias("query"))
    return full.unionByName(short).distinct()


_LOOKUP_SQL = """
with qs as (select distinct query from (
   select lower(replace(s_name, 'Supplier', 'customer')) as query from supplier
   union all select regexp_replace(substr(s_name, 10, 9), '^0+', '') as query from supplier)),
m as (select qs.query, min(c.c_custkey) as lei from qs join customer c on contains(lower(c.c_name), lower(qs.query)) group by qs.query)
select qs.query, c.c_name as official_legal_name, cast(m.lei as varchar) as lei_code, n.n_name as jurisdiction,
  c.c_mktsegment as entity_status,
  case when m.lei % 3 = 1 then concat(m.lei, ' ', lower(c.c_mktsegment), ' street') when m.lei is not null then 'N/A' end as legal_address,
  case when m.lei % 4 <> 0 then concat(upper(n.n_name[1]), lower(n.n_name[2:])) end as city
from qs left join m on m.query = qs.query left join customer c on c.c_custkey = m.lei left join nation n on n.n_nationkey = c.c_nationkey"""


@query("legal_entity_lookup", _LOOKUP_SQL)
def q_lookup(spark, sf):
    found = identity.legal_entity_lookup(_lookups(spark, sf), _registry(spark, sf))
    return identity.identity_record(found)


def _misspelt(spark, sf):
    """Names of customers as others spell them: a letter or a digit less, a wrong digit, and too far off."""
    s = tables.table(spark, sf, "supplier")
    n = F.substring("s_name", 10, 9)
    return s.select(F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("Custmer#"), n)).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("customer#"), F.substring(n, 2, 8)))
                    .when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("Customer#9"), F.substring(n, 2, 8))).otherwise(F.concat(F.lit("Kustumer#"), n)).alias("query")).distinct()


@query("legal_entity_approximate", """
with qs as (select distinct case s_suppkey % 4 when 0 then 'Custmer#' || substr(s_name, 10, 9) when 1 then 'customer#' || substr(s_name, 11, 8)
     when 2 then 'Customer#9' || substr(s_name, 11, 8) else 'Kustumer#' || substr(s_name, 10, 9) end as query from supplier),
e as (select qs.query, min(c.c_custkey) as lei from qs join customer c on contains(lower(c.c_name), lower(qs.query)) group by qs.query),
d as (select qs.query, c.c_custkey as lei, levenshtein(lower(qs.query), lower(c.c_name)) as distance from qs join customer c on levenshtein(lower(qs.query), lower(c.c_name)) <= 1),
nr as (select query, lei, distance from d qualify row_number() over (partition by query order by distance, lei) = 1)
select qs.query, c.c_name as official_legal_name, cast(c.c_custkey as varchar) as lei_code, cast(case when e.lei is not null then 0 else nr.distance end as integer) as distance
from qs left join e using (query) left join nr using (query) left join customer c on c.c_custkey = coalesce(e.lei, nr.lei)""")
def q_lookup_approximate(spark, sf):
    found = identity.legal_entity_lookup(_misspelt(spark, sf), _registry(spark, sf), edits=1)
    return found.select("query", F.col("legal_name").alias("official_legal_name"), F.col("lei").cast("string").alias("lei_code"), "distance")


@query("leadership_rollup", """
with b as (select o_custkey as company, o_orderkey as ord, o_orderpriority as ceo,
   case when o_orderstatus <> 'O' then o_orderstatus end as founder,
   case when o_orderkey % 5 = 0 then 'TK' || cast(o_custkey as varchar) end as ticker from orders),
f as (select company, array_to_string(list_sort(list(distinct founder)), '|') as fs from b where founder is not null group by company),
fr as (select company, arg_min(ceo, ord) as ceo, arg_min(ticker, ord) as ticker, min(ord) as o from b group by company)
select fr.company, (select ceo from b where b.company = fr.company and b.ord = fr.o) as ceo,
  coalesce(f.fs, 'Not Found') as founders,
  coalesce((select ticker from b where b.company = fr.company and b.ord = fr.o), '-1') as ticker
from fr left join f on f.company = fr.company""")
def q_leadership(spark, sf):
    o = tables.table(spark, sf, "orders")
    b = o.select(F.col("o_custkey").alias("company"), F.col("o_orderkey").alias("ord"),
                 F.col("o_orderpriority").alias("ceo"),
                 F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("founder"),
                 F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("TK"), F.col("o_custkey").cast("string"))).alias("ticker"))
    return identity.leadership_rollup(b)
