"""Cases that used to be wrong or slow: bursts, barriers, hot grams, entities, long texts."""

import datetime as dt
import time

from pyspark.sql import functions as F

from moatlens.functions import text as T
from moatlens.operators import identity, pricing, snapshots, statements, urls


def history(spark, rows):
    """rows: (company, second, state) with state g(ood), s(tale) or n(one)."""
    df = spark.createDataFrame([(c, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), k, t) for c, t, k in rows],
                               "company string, snapshot_ts timestamp, k string, t long")
    rec = F.struct(F.when(F.col("k") == "g", F.col("t")).alias("v"), (F.col("k") == "s").alias("is_stale"),
                   F.lit(None).cast("timestamp").alias("stale_since"), F.lit(None).cast("string").alias("stale_reason"))
    return df.select("company", "snapshot_ts", F.when(F.col("k") != "n", rec).alias("pricing"))


def test_a_missing_feature_ends_the_carry(spark):
    h = history(spark, [("a", i, k) for i, k in enumerate("gsnsgsss")])
    for rows_per_bucket in (1, 3, 1000):
        c = snapshots.carry_forward(h, features=("pricing",), rows_per_bucket=rows_per_bucket).orderBy("snapshot_ts").collect()
        assert [r.pricing and r.pricing.v for r in c] == [0, 0, None, None, 4, 4, 4, 4]
        assert [bool(r.pricing and r.pricing.stale_since) for r in c] == [False, True, False, False, False, True, True, True]


def test_bursty_history_is_cut_by_rows(spark):
    h = history(spark, [("burst", 0, "g"), *[("burst", 300_000_000 + i, "g") for i in range(999)], ("calm", 5, "g")])
    b = snapshots.bucketed(h, rows_per_bucket=100).groupBy("company", "_b").count().collect()
    sizes = [r["count"] for r in b if r.company == "burst"]
    assert sum(sizes) == 1000 and max(sizes) < 60
    pairs = snapshots.with_previous(h, features=("pricing",), rows_per_bucket=100)
    assert pairs.filter("compared_with is not null").count() == 999
    assert pairs.filter("unix_seconds(snapshot_ts) - unix_seconds(compared_with) = 1").count() == 998


def test_newest_period_is_the_statements_own(spark):
    lines = spark.createDataFrame([("A", "income", 1, "Revenue", "2024-09-30", 100.0), ("A", "income", 2, "Operating Income", "2024-09-30", 30.0),
                                   ("A", "balance", 3, "Total Assets", "2024-12-31", 500.0)],
                                  "ticker string, statement string, line_no int, label string, period string, value double")
    m = statements.company_margins(lines).first()
    assert (m.period, m.operating_margin, m.is_fallback) == ("2024-09-30", 0.3, False)


def test_sitemap_entities_cdata_and_all_children(spark):
    body = ("<urlset><!-- <loc>https://no</loc> --><url><loc>https://d.com/a?x=1&#38;y=&#x26;amp;z</loc></url>"
            "<url><loc><![CDATA[https://d.com/b?x=1&y=2]]></loc></url><url><loc>  </loc></url></urlset>")
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://d.com/{k}.xml</loc></sitemap>" for k in range(5)) + "</sitemapindex>"
    kids = [("e.com", f"https://d.com/{k}.xml", f"<urlset><loc>https://d.com/p{k}</loc></urlset>") for k in range(5)]
    df = spark.createDataFrame([("d.com", "https://d.com/sitemap.xml", body), ("e.com", "https://e.com/sitemap.xml", index), *kids], "domain string, url string, body string")
    got = sorted((r.domain, r.child, r.loc) for r in urls.sitemap_locs(df).collect())
    assert got == [("d.com", 0, "https://d.com/a?x=1&y=&z"), ("d.com", 0, "https://d.com/b?x=1&y=2")] + [("e.com", k + 1, f"https://d.com/p{k}") for k in range(5)]
    assert urls.sitemap_locs(df, children=3).filter("domain = 'e.com'").count() == 3


def test_lookup_of_short_hot_and_empty_queries(spark):
    reg = spark.range(3000).select(F.col("id").alias("lei"), F.concat(F.lit("Firm "), F.col("id"), F.lit(" Inc")).alias("legal_name"),
                                   F.lit("x").alias("jurisdiction"), F.lit("y").alias("status"), F.lit(None).cast("string").alias("city"),
                                   F.array().cast("array<string>").alias("address_lines"))
    q = spark.createDataFrame([("inc",), ("INC",), (" inc",), ("",), ("7",), ("2999 inc",), ("nothing",), ("firm 12",)], "query string")
    found = identity.legal_entity_lookup(q, reg)
    got = {r.query: r.lei for r in found.collect()}
    assert got == {"inc": 0, "INC": 0, " inc": 0, "": 0, "7": 7, "2999 inc": 2999, "nothing": None, "firm 12": 12}
    assert {r.legal_address for r in identity.identity_record(found).collect()} == {"N/A", None}  # an empty address list


def test_strip_and_tiers_are_linear(spark):
    spaces = spark.createDataFrame([("a" + " " * 80_000 + "b",)], "x string").cache()
    spaces.select(T.strip(F.col("x"))).collect()
    t = time.time()
    assert spaces.select(F.length(T.strip(F.col("x"))).alias("n")).first().n == 80_002
    assert time.time() - t < 2
    md = "# Pro plan\n" + " ".join(f"${i}/mo Business" for i in range(32_000))
    page = spark.createDataFrame([(md,)], "markdown string").cache()
    page.count()
    t = time.time()
    assert page.select(pricing.tier_names(F.col("markdown")).alias("t")).first().t == ["Pro", "Business"]
    assert time.time() - t < 10
