"""Pricing facts from page text (one pass per page, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moatlens.functions import lexicons as L
from moatlens.functions import text as T


def raw_mentions(md: Column, patterns) -> Column:
    """Raw matches of the patterns, pattern order."""
    return F.concat(*[T.findall(md, p, 0, ignore_case=True) for p in patterns])


def normalise(raw: Column) -> Column:
    """Collapse white space, de-duplicate keeping first-seen order."""
    return F.array_distinct(F.transform(raw, lambda p: F.regexp_replace(T.strip(p), T.rx(r"\s+"), " ")))


def monthly_prices(md: Column) -> Column:
    return normalise(raw_mentions(md, L.PRICE_MONTHLY_PATTERNS))


def annual_prices(md: Column) -> Column:
    return normalise(raw_mentions(md, L.PRICE_ANNUAL_PATTERNS))


def price_values(md: Column, monthly_raw: Column | None = None, annual_raw: Column | None = None) -> Column:
    """Integer part of every raw monthly+annual mention, 0 < v < cap."""
    m = raw_mentions(md, L.PRICE_MONTHLY_PATTERNS) if monthly_raw is None else monthly_raw
    a = raw_mentions(md, L.PRICE_ANNUAL_PATTERNS) if annual_raw is None else annual_raw
    raw = F.concat(m, a)
    vals = F.transform(raw, lambda p: F.replace(
        F.regexp_extract(p, T.rx(L.PRICE_AMOUNT_PATTERN), 1), F.lit(","), F.lit("")).try_cast("bigint"))
    return F.filter(vals, lambda v: v.isNotNull() & (v > 0) & (v < L.PRICE_CAP))


def _tier_matches(c: Column) -> Column:
    pat = r"\b(" + "|".join(L.TIER_WORDS) + r")\b"
    return T.findall(c, pat, 1, ignore_case=True)


def tier_names(md: Column) -> Column:
    """Tier words in heading lines, then near a ``$digit`` with pricing context.

    The text around every ``$digit`` comes from look-behind and look-ahead of
    bounded length, so the work grows with the text, not with its square. The
    look-behind is only tried where the look-ahead has found a ``$digit``.
    """
    heading_lines = F.filter(T.lines(md), lambda l: l.rlike(T.rx(r"^\s*#")))
    pass1 = F.flatten(F.transform(heading_lines, _tier_matches))

    w = L.PRICE_WINDOW_CHARS
    dollar = r"(?=\$\d)"
    full, short = rf"(?<=(.{{{w}}}))", rf"(?<=\A(.{{0,{w - 1}}}))"
    left = lambda group: F.regexp_extract_all(md, F.lit(f"(?Uds){dollar}(?:{full}|{short})"), F.lit(group))
    right = F.regexp_extract_all(md, F.lit(rf"(?Uds)(?=(\$\d.{{0,{w}}}))"), F.lit(1))
    sides = F.arrays_zip(left(1).alias("a"), left(2).alias("b"), right.alias("c"))
    windows = F.transform(sides, lambda x: F.concat(x["a"], x["b"], x["c"]))
    ctx = F.filter(windows, lambda win: win.rlike(T.rx(L.PRICING_CONTEXT_PATTERN, True)))
    pass2 = F.flatten(F.transform(ctx, _tier_matches))
    return F.array_distinct(F.transform(F.concat(pass1, pass2), F.initcap))


def pricing_models(md_lower: Column) -> Column:
    return T.classes_present(md_lower, T.lexicon(L.PRICING_MODELS))


def trial_offers(md_lower: Column) -> Column:
    return T.classes_present(md_lower, T.lexicon(L.TRIAL_OFFERS))


def extract_pricing(df: DataFrame, text_col: str = "markdown") -> DataFrame:
    """Adds the pricing record fields as columns.

    Expensive intermediate columns (lowered text, value list) are projected
    once and reused.
    """
    md = F.col(text_col)
    base = df.select(
        "*", F.lower(md).alias("_lower"),
        raw_mentions(md, L.PRICE_MONTHLY_PATTERNS).alias("_mraw"),
        raw_mentions(md, L.PRICE_ANNUAL_PATTERNS).alias("_araw"))
    base = base.select(
        "*",
        normalise(F.col("_mraw")).alias("monthly_prices"),
        normalise(F.col("_araw")).alias("annual_prices"),
        tier_names(md).alias("tiers_found"),
        pricing_models(F.col("_lower")).alias("pricing_model"),
        trial_offers(F.col("_lower")).alias("trial_offers"),
        price_values(md, F.col("_mraw"), F.col("_araw")).alias("_vals"),
        md.rlike(T.rx(L.ZERO_PRICE_PATTERN)).alias("_zero"),
    )
    return base.select(
        *[c for c in base.columns if c not in ("_lower", "_vals", "_zero", "_mraw", "_araw")],
        F.array_min("_vals").alias("price_low"),
        F.array_max("_vals").alias("price_high"),
        (F.array_contains("pricing_model", "freemium")
         | F.array_contains("trial_offers", "free_plan")
         | (F.array_contains("tiers_found", "Free") & F.col("_zero"))
         | T.any_sub(F.col("_lower"), T.lit_array(L.FREE_PHRASES))).alias("has_free_tier"),
        F.array_contains("pricing_model", "contact_sales").alias("requires_sales_call"),
    )


def price_label(c: Column) -> Column:
    """Render an amount as ``$n``."""
    return F.when(c.isNotNull(), F.concat(F.lit("$"), c.cast("string")))


def pricing_summary(extracted: DataFrame, key: str = "company") -> DataFrame:
    """Per-company roll-up of page records (partial aggregation map-side)."""
    return extracted.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if(F.size("monthly_prices") > 0).alias("n_with_monthly"),
        F.min("price_low").alias("lowest_price"),
        F.max("price_high").alias("highest_price"),
        F.count_if("has_free_tier").alias("n_free_tier"),
        F.count_if("requires_sales_call").alias("n_sales_call"),
        F.sum(F.size("tiers_found")).cast("bigint").alias("n_tier_mentions"),
    )
