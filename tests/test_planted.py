"""Pages built around known facts: the extractors must report exactly what was planted.

Nothing here applies a rule to a page; each page is assembled from facts whose
outcome is known beforehand, between filler that triggers nothing.
"""

import random

import pytest

from moatlens.operators import complaints, messaging, pricing, signals

FILLER = "zzqx wvvk yyqj xkcz qqwv zjxy kkzv wqyx jjzk vvqx zzkw yqjx qkzz wvxj kqqy"  # no keyword, over 60 characters


def frame(spark, pages, company="acme"):
    return spark.createDataFrame([(i, company, p) for i, p in enumerate(pages)], "page_id long, company string, markdown string")


@pytest.mark.parametrize("seed", [1, 2])
def test_prices_and_tiers(spark, seed):
    rng = random.Random(seed)
    pages, facts = [], []
    for _ in range(60):
        monthly = rng.sample(range(5, 900), rng.randint(0, 3))
        annual = rng.sample(range(1000, 9000), rng.randint(0, 2))
        near, headed = rng.choice(["Premium", "Elite", None]), rng.choice(["Starter", None])
        lines = [FILLER]
        if headed:
            lines += [f"## {headed} edition", FILLER]
        for n in monthly:
            lines += [f"{FILLER} ${n}/mo {FILLER}"]
        for n in annual:
            lines += [f"{FILLER} ${n:,} per year {FILLER}"]
        if near:
            lines += [f"{FILLER} {near} plan at $7 each {FILLER}"]
        lines += [f"Ultimate {FILLER} {FILLER}"]  # a tier word far from any price
        pages.append("\n".join(lines))
        facts.append((monthly, annual, [t for t in (headed, near) if t]))
    got = {r.page_id: r for r in pricing.extract_pricing(frame(spark, pages)).collect()}
    for i, (monthly, annual, tiers) in enumerate(facts):
        r = got[i]
        assert r.monthly_prices == [f"${n}/mo" for n in monthly]
        assert r.annual_prices == [f"${n:,} per year" for n in annual]
        assert r.tiers_found == tiers, pages[i]
        assert (r.price_low, r.price_high) == ((min(monthly + annual), max(monthly + annual)) if monthly or annual else (None, None))
        assert r.has_free_tier is False and r.requires_sales_call is False


def test_offers(spark):
    plants = {"free plan": ("has_free_tier", True), "contact sales": ("requires_sales_call", True), "nothing": (None, None)}
    pages = [f"{FILLER} {p} {FILLER}" for p in plants]
    got = {r.page_id: r for r in pricing.extract_pricing(frame(spark, pages)).collect()}
    assert [(got[i].has_free_tier, got[i].requires_sales_call) for i in range(3)] == [(True, False), (False, True), (False, False)]
    assert [got[i].trial_offers for i in range(3)] == [["free_plan"], [], []]


@pytest.mark.parametrize("seed", [3, 4])
def test_headings_claims_and_buzzwords(spark, seed):
    rng = random.Random(seed)
    pages, facts = [], []
    for _ in range(50):
        h1 = [f"zq{k} " + "w" * rng.randint(1, 30) for k in range(rng.randint(0, 3))]
        h2 = [f"xj{k}" for k in range(rng.randint(0, 9))]
        uptime, buzz = rng.choice([None, 97, 99]), rng.sample(["seamless", "holistic", "synergy"], rng.randint(0, 3))
        lines = [f"# {h}" for h in h1] + [f"## {h}" for h in h2] + ["#not a heading", FILLER]
        lines += [f"{uptime}.5% uptime"] if uptime else []
        lines += [" ".join(buzz)]
        pages.append("\n".join(lines))
        facts.append((h1, h2, uptime, buzz))
    got = {r.page_id: r for r in messaging.extract_messaging(frame(spark, pages)).collect()}
    for i, (h1, h2, uptime, buzz) in enumerate(facts):
        r = got[i]
        assert r.main_headline in (h1 or [None]) and all(len(r.main_headline) >= len(h) for h in h1)
        assert r.subheadlines == h2[:6]
        assert r.uptime_claims == ([f"{uptime}.5% uptime"] if uptime else [])
        assert sorted(r.buzzwords) == sorted(buzz) and r.buzzword_count == len(buzz)


@pytest.mark.parametrize("seed", [5, 6])
def test_complaints_and_competitors(spark, seed):
    rng = random.Random(seed)
    pages, facts = [], []
    for _ in range(50):
        slow, pricey, zoho, klaviyo = (rng.randint(0, 4) for _ in range(4))
        good, bad = rng.randint(0, 3), rng.randint(0, 3)
        lines = [f"{FILLER} glitch" for _ in range(slow)] + [f"{FILLER} overpriced" for _ in range(pricey)]
        lines += [f"{FILLER} Zoho" for _ in range(zoho)] + [f"{FILLER} klaviyo" for _ in range(klaviyo)]
        lines += [f"{FILLER} fantastic" for _ in range(good)] + [f"{FILLER} horrible" for _ in range(bad)]
        lines += ["glitch short", f"* [{FILLER} glitch](https://x.y)"]  # too short; navigation
        rng.shuffle(lines)
        pages.append("\n".join(lines))
        facts.append((slow, pricey, zoho, klaviyo, good, bad))
    got = {r.page_id: r for r in complaints.extract_complaints(frame(spark, pages, "klaviyo")).collect()}
    for i, (slow, pricey, zoho, _, good, bad) in enumerate(facts):
        r = got[i]
        assert dict((c.name, c.score) for c in r.category_scores) == {k: v for k, v in (("performance", slow), ("pricing_value", pricey)) if v}
        assert r.total_complaint_signals == slow + pricey
        assert [(c["name"], c["count"]) for c in r.competitor_comparisons] == ([("zoho", zoho)] if zoho else [])  # never the company itself
        assert (r.positive_signal_count, r.negative_signal_count) == (good, bad)
        share = good / (good + bad) if good + bad else None
        assert r.sentiment_lean == ("neutral" if share is None else "positive" if share > 0.6 else "negative" if share < 0.4 else "mixed")
        assert {s.name: len(s.lines) for s in r.sample_complaint_lines} == {k: min(v, 5) for k, v in (("performance", slow), ("pricing_value", pricey)) if v}


def test_gaps_beyond_the_tenth_are_kept(spark):
    page = "\n".join(f"it lacks widget number {chr(97 + k)}{chr(97 + k)}x here" for k in range(14))
    r = complaints.extract_complaints(frame(spark, [page])).first()
    assert len(r.feature_gaps_all) == 14 and r.feature_gaps_mentioned == r.feature_gaps_all[:10]


@pytest.mark.parametrize("seed", [7, 8])
def test_jobs(spark, seed):
    rng = random.Random(seed)
    pages, facts = [], []
    for _ in range(50):
        eng, rec, directors, tokyo = rng.randint(0, 4), rng.randint(0, 4), rng.randint(0, 3), rng.random() < 0.5
        lines = [f"devops {FILLER}"] * eng + [f"recruiter {FILLER}"] * rec + [f"vice president {FILLER}"] * directors + ([f"tokyo {FILLER}"] if tokyo else [])
        rng.shuffle(lines)
        pages.append("\n".join(lines) or FILLER)
        facts.append((eng, rec, directors, tokyo))
    got = {r.page_id: r for r in signals.extract_signals(frame(spark, pages)).collect()}
    for i, (eng, rec, directors, tokyo) in enumerate(facts):
        r = got[i]
        assert {d.name: d["count"] for d in r.hiring_by_department} == {k: v for k, v in (("engineering", eng), ("hr_people", rec)) if v}
        assert r.biggest_hiring_push == (None if not eng + rec else "engineering" if eng >= rec else "hr_people")
        assert r.seniority_distribution.leadership == directors
        assert r.geographic_expansion == (["APAC"] if tokyo else [])
