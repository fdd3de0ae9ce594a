"""Landed documents: malformed and nested sitemaps, item texts, retried fetches, event and insider fall-backs."""

import datetime as dt
import itertools
import time

import pytest
from pyspark.sql import functions as F

from moatlens.operators import assembly, filings, pages, snapshots, statements, urls
from moatlens.plans.q_snap import snapshot_doc_schema

GOOD = "<urlset><url><loc>https://d.com/a</loc></url></urlset>"
WELL_FORMED = [
    GOOD, '<?xml version="1.0"?>\n' + GOOD + "\n<!-- end -->", "<!-- <urlset> -->" + GOOD, '<urlset xmlns="http://x" xmlns:i="http://i"><url a="1>2"><loc>https://d.com/a</loc>'
    "<i:image><i:loc>no</i:loc></i:image></url><url/></urlset>", "<urlset><url><loc xml:lang='en'>https://d.com/<![CDATA[a]]></loc></url></urlset>",
    "<urlset><deep><deeper><loc>https://d.com/a</loc></deeper></deep></urlset>", "<urlset ><loc>https://d.com/a<b>c</b>d</loc></urlset >", "<?pi x?>" + GOOD + "<?pi?>"]
MALFORMED = [
    GOOD[:-9], GOOD.replace("</url>", ""), "<urlset><url><loc>https://d.com/a</url></loc></urlset>", GOOD + GOOD, GOOD + "<x/>", GOOD + "text", "text" + GOOD,
    GOOD.replace("/a", "/a?x&y"), GOOD.replace("/a", "/a&no;"), GOOD.replace("<url>", "<url a=b>"), GOOD.replace("<url>", "<url a='1' a='2'>"), GOOD.replace("<url>", "<i:url>").replace("</url>", "</i:url>"),
    GOOD.replace("/a", " < b"), "<html>" + GOOD + "</html>", "", "no xml", "<urlset>", "</urlset>", GOOD.replace("<url>", "<!-- a -- b --><url>"),
    GOOD.replace("</urlset>", "</urlset ").replace("<urlset>", "<urlset><urlset>"), None]


def sitemaps(spark, rows):
    return spark.createDataFrame(rows, "domain string, url string, body string")


def test_malformed_sitemaps_give_nothing(spark):
    rows = [(f"{k}{i}.com", f"https://{k}{i}.com/sitemap.xml", b) for k, bodies in (("good", WELL_FORMED), ("bad", MALFORMED)) for i, b in enumerate(bodies)]
    got = {r.domain: r["loc"] for r in urls.sitemap_locs(sitemaps(spark, rows)).collect()}
    assert got == {f"good{i}.com": "https://d.com/a" for i in range(len(WELL_FORMED))}
    assert urls.sitemap_locs(sitemaps(spark, [])).collect() == []


def test_long_and_odd_bodies_are_linear(spark):
    n = 60_000
    bodies = ["<urlset>" + "<url><loc>https://d.com/a</loc></url>" * n + "</urlset>", "<urlset>" + "<a>" * n, " " * (8 * n) + GOOD, "<urlset><loc>" + "x" * (8 * n) + "</loc></urlset>",
              "<urlset><loc>" + "<![CDATA[x]]>" * 2000 + "</loc></urlset>", "<!--" * n, "<urlset>" + "<" * n]
    df = sitemaps(spark, [(f"{i}.com", f"https://{i}.com/sitemap.xml", b) for i, b in enumerate(bodies)])
    t = time.time()
    got = {r.domain: r["count"] for r in urls.sitemap_locs(df).groupBy("domain").count().collect()}
    assert got == {"0.com": n, "2.com": 1, "3.com": 1, "4.com": 1} and time.time() - t < 30


def index(*children):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{c}</loc></sitemap>" for c in children) + "</sitemapindex>"


def test_indexes_within_indexes_end(spark):
    leaf = lambda x: f"<urlset><url><loc>https://d.com/{x}</loc></url></urlset>"
    docs = {"sitemap.xml": index("https://d.com/1.xml", "https://d.com/i.xml", "https://d.com/2.xml", "https://d.com/1.xml"), "1.xml": leaf("p1"), "2.xml": leaf("p2"),
            "i.xml": index("https://d.com/j.xml", "https://d.com/2.xml", "https://d.com/sitemap.xml"), "j.xml": index("https://d.com/i.xml", "https://d.com/3.xml", "https://d.com/gone.xml"),
            "3.xml": leaf("p3"), "lone.xml": leaf("no")}
    rows = [("d.com", f"https://d.com/{k}", v) for k, v in docs.items()]
    got = sorted((r.child, r.sitemap_url, r["loc"]) for r in urls.sitemap_locs(sitemaps(spark, rows)).collect())
    assert got == [(1, "https://d.com/1.xml", "https://d.com/p1"), (2, "https://d.com/2.xml", "https://d.com/p2"), (2, "https://d.com/3.xml", "https://d.com/p3")]
    flat = sorted((r.child, r["loc"]) for r in urls.sitemap_locs(sitemaps(spark, rows), nested=False).collect())
    assert flat == [(1, "https://d.com/p1"), (3, "https://d.com/p2")]


def test_a_shared_child_and_repeated_fetches_count_once_a_domain(spark):
    rows = [r for d in ("a.com", "b.com") for r in ((d, f"https://{d}/sitemap.xml", index("https://s.net/s.xml")), (d, "https://s.net/s.xml", GOOD))]
    rows += [("a.com", "https://s.net/s.xml", GOOD), ("a.com", "https://s.net/s.xml", "<urlset>")]
    assert sorted((r.domain, r["loc"]) for r in urls.sitemap_locs(sitemaps(spark, rows)).collect()) == [("a.com", "https://d.com/a"), ("b.com", "https://d.com/a")]


BODY = ("Contents\nItem 1. Business 3\nItem 1A. Risk 9\nItem 7. Discussion 20\nItem 7A: Market 30\n\nPART I\nITEM 1. Business\nWe sell. See Item 7. for more.\n"
        "  Item 1a:  Risk\nRisks\nItem 10. Directors\n\nitem 7. Discussion\n\n text \nItem 7A. Market\nwide")


def test_item_texts_skip_contents_and_mentions(spark):
    df = spark.createDataFrame([(BODY,), ("no items",), ("",), (None,), ("Item 1. a\nItem 1. b",)], "body string")
    got = [r[0] for r in df.select(filings.item_texts(F.col("body"), ["Item 1", "Item 1A", "Item 7", "Item 9"])).collect()]
    assert got[0] == ["ITEM 1. Business\nWe sell. See Item 7. for more.", "Item 1a:  Risk\nRisks", "item 7. Discussion\n\n text", None]
    assert got[1] == [None] * 4 and got[2] == [None] * 4 and got[3] == [None] * 4
    assert got[4][0] == "Item 1. a"


def test_items_of_the_newest_filing_only(spark):
    df = spark.createDataFrame([("A", 1, BODY), ("A", 2, "Item 1. New"), ("B", 5, "Item 1. Y"), ("B", 5, "Item 1. X")], "ticker string, filing_id long, body string")
    got = sorted((r.ticker, r.section_ord, r.item, r.text) for r in filings.filing_items(df, {"Item 1": 1, "Item 7": 2}).collect())
    assert got == [("A", 1, "Item 1", "Item 1. New"), ("A", 2, "Item 7", None), ("B", 1, "Item 1", "Item 1. X"), ("B", 2, "Item 7", None)]
    esg = {r.ticker: r.n_paragraphs for r in filings.esg_paragraphs(filings.filing_items(df, {"Item 1": 1, "Item 7": 2})).collect()}
    assert esg == {"A": 0, "B": 0}


def test_items_of_a_long_filing_are_linear(spark):
    df = spark.createDataFrame([("Item 1. x\n" * 50_000 + "Item 7. long\n" + "item \n" * 200_000,)], "body string")
    t = time.time()
    r = df.select(filings.item_texts(F.col("body"), ["Item 1", "Item 7"])).first()[0]
    assert r[0] == "Item 1. x" and len(r[1]) > 900_000 and time.time() - t < 20


def test_events_fall_back_to_header_items(spark):
    rows = [(["Item 1", "Item 2"], "h", "d"), ([], "h", "d"), (None, "", "d"), (None, None, ""), (None, "h", None)]
    df = spark.createDataFrame([("T", i, "2024-01-01", "8-K", *r) for i, r in enumerate(rows)],
                               "ticker string, filing_id int, filed_date string, form string, items array<string>, header_items string, description string")
    assert [r.description for r in filings.material_events(df).orderBy("filing_id").collect()] == ["Item 1; Item 2", "h", "d", "8-K", "h"]
    assert [r.description for r in filings.material_events(df.drop("header_items")).orderBy("filing_id").collect()] == ["Item 1; Item 2", "d", "d", "8-K", "8-K"]


def test_all_filings_of_a_form(spark):
    df = spark.createDataFrame([("T", form, dt.date(2024, 1, 1 + i), i) for form in ("4", "8-K") for i in range(25)], "ticker string, form string, filed_date date, filing_id int")
    n = {r.form: r["count"] for r in filings.filings_head(df, {"4": None, "8-K": 3}).groupBy("form").count().collect()}
    assert n == {"4": 25, "8-K": 3}


def page(price):
    return f"# Pro plan ${price}/mo\n" + "zzqx wvvk " * 60


@pytest.mark.parametrize("order", list(itertools.permutations(range(4)))[::5])
def test_the_newest_accepted_fetch_counts_in_any_order(spark, order):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    log = [("c", "pricing", page(10), True, None, at(1)), ("c", "pricing", page(20), True, None, at(2)), ("c", "pricing", None, False, "Timeout", at(3)), ("c", "messaging", None, False, "late", at(1))]
    log = [log[i] for i in order] + [("c", "messaging", "x", True, "early", at(0)), ("d", "pricing", page(5), True, None, None), ("d", "pricing", page(5), True, None, None)]
    fetches = spark.createDataFrame(log, "company string, feature string, markdown string, success boolean, error_message string, fetched_at timestamp")
    targets = spark.createDataFrame([("c", "pricing", "u"), ("c", "messaging", "u"), ("c", "signals", None), ("d", "pricing", "u"), ("d", "messaging", "u")], "company string, feature string, url string")
    got = {r.company: r for r in assembly.assemble(targets, fetches, F.lit(at(9))).collect()}
    c, d = got["c"], got["d"]
    assert (c.pricing.monthly_prices, c.pricing.is_stale) == (["$20/mo"], False)
    assert (c.messaging.is_stale, c.messaging.stale_reason, c.messaging.attempted) == (True, "late", True)
    assert (c.signals.attempted, c.signals.is_stale) == (False, True) and c.complaints is None
    assert d.pricing.monthly_prices == ["$5/mo"] and d.messaging.is_stale and d.messaging.stale_reason


def test_crawls_assembled_at_once_are_those_assembled_one_by_one(spark):
    days = [dt.datetime(2024, 1, d) for d in (1, 2)]
    targets = spark.createDataFrame([(c, t, f, "u") for c in "ab" for t in days for f in ("pricing", "complaints")], "company string, snapshot_ts timestamp, feature string, url string")
    fetches = targets.select("company", "snapshot_ts", "feature", F.concat(F.lit("# Pro $"), F.dayofmonth("snapshot_ts").cast("string"), F.lit("/mo\n" + "so overpriced here " * 40)).alias("markdown"),
                             F.lit(True).alias("success"), F.lit(None).cast("string").alias("error_message"))
    both = sorted(assembly.assemble(targets, fetches).collect(), key=str)
    one = [r for t in days for r in assembly.assemble(targets.filter(F.col("snapshot_ts") == t).drop("snapshot_ts"), fetches.filter(F.col("snapshot_ts") == t).drop("snapshot_ts"), F.lit(t)).collect()]
    assert both == sorted(one, key=str) and len(both) == 4
    assert snapshots.latest(assembly.assemble(targets, fetches)).count() == 2


def test_statements_with_disjoint_periods_in_one_table(spark):
    rows = [("A", "income", 1, "Revenue", {"2024-12-31": 5.0, "2023-12-31": None, "depth": 1.0}), ("B", "income", 1, "Revenue", {"2022-06-30": 7.0, "2022/06/30": 9.0}),
            ("C", "income", 1, "Revenue", {"label": 2.0}), ("D", "income", 1, "Revenue", {}), ("E", "income", 1, "Revenue", None)]
    df = spark.createDataFrame(rows, "ticker string, statement string, line_no int, label string, cells map<string,double>")
    got = sorted((r.ticker, r.period, r.value) for r in statements.unpivot_cells(df).collect())
    assert got == [("A", "2023-12-31", None), ("A", "2024-12-31", 5.0), ("B", "2022-06-30", 7.0)]


def test_bad_documents_go_to_quarantine(spark, tmp_path):
    good = '{\n "company": "c1",\n "timestamp": "2024-01-02",\n "analysis": {\n  "pricing": {"tiers_found": ["Pro"],\n "is_stale": false}\n }\n}'
    docs = {"a/c1.json": good, "a/c2.json": good.replace("c1", "c2").replace("\n", " "), "b/broken.json": good[:60], "b/type.json": good.replace('["Pro"]', '{"x": 1}'),
            "b/nobody.json": good.replace('"company": "c1",', ""), "b/never.json": good.replace('"timestamp": "2024-01-02",', ""), "empty.json": "", "blank.json": "\n\n", "text.json": "hello"}
    for name, text in docs.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    s = spark.createDataFrame([], "pricing struct<tiers_found:array<string>,is_stale:boolean>, messaging struct<main_headline:string>, signals struct<x:string>, complaints struct<x:string>")
    rows, bad = snapshots.read_json_docs(spark, str(tmp_path), snapshot_doc_schema(s))
    assert sorted((r.company, str(r.snapshot_ts), r.pricing.tiers_found) for r in rows.collect()) == [("c1", "2024-01-02", ["Pro"]), ("c2", "2024-01-02", ["Pro"])]
    got = {r.file.rsplit("/", 1)[1]: r.reason for r in bad.collect()}
    assert len(got) == bad.count() == len(docs) - 3  # all but two good ones and the one without a byte
    assert (got["blank.json"], got["nobody.json"], got["never.json"]) == ("blank", "no company", "no timestamp")
    assert got["broken.json"] == got["type.json"] == got["text.json"] == "not a document of the schema"


def test_positions_follow_the_order_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), F.col("id").alias("v")).repartition(7)
    got = urls.positions(df, ["k"]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1000)) and [r.k for r in got] == sorted(r.k for r in got)
    assert urls.positions(df.limit(0), ["k"]).collect() == []
    same = urls.positions(df.withColumn("k", F.lit(1)), ["k"]).select("position").collect()
    assert sorted(r.position for r in same) == list(range(1000))


def test_whole_errors_on_request(spark):
    df = spark.createDataFrame([("x", False, "e" * 300 + "\nmore")], "markdown string, success boolean, error_message string")
    assert [len(pages.page_gate(df, error_chars=n).first().reject_reason) for n in (200, None, 5)] == [200, 300, 5]


def test_a_wide_statement_has_a_cell_for_every_period(spark, tmp_path):
    from moatlens.plans import QUERIES
    spark.createDataFrame([(1, 1, 10.0, dt.datetime(2020, 5, 1)), (2, 2, 20.0, dt.datetime(2021, 5, 1))],
                          "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1), (2, 2)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    rows = QUERIES["statement_unpivot"](spark, str(tmp_path)).filter("line_no = 9").collect()
    got = {(r.ticker, r.period): r.value for r in rows}
    assert len(rows) == len(got) == 8  # two tickers, two years, two ends of a fiscal year
    assert {k: v for k, v in got.items() if v is not None} == {("T1", "2020-12-31"): 1020.0, ("T2", "2021-12-31"): 1040.0}
