"""Complaint facts from review pages: categories, samples, gaps, competitors, lean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moatlens.functions import lexicons as L
from moatlens.functions import text as T
from moatlens.operators.pages import review_lines


def category_scores(low: Column, low_len: Column | None = None) -> Column:
    """All categories as (name, ord, score) in lexicon order."""
    lex = T.lexicon(L.COMPLAINT_CATEGORIES)
    return F.transform(lex, lambda c: F.struct(
        c["name"].alias("name"), c["ord"].alias("ord"), T.sum_counts(low, c["kws"], low_len).alias("score")))


def sample_lines(lines: Column, lines_low: Column | None = None, first: int | None = L.N_SAMPLE_LINES) -> Column:
    """Per category the first review lines (None: all) holding any of its keywords.

    ``lines_low`` (the lowered lines, same order) lets the keyword tests skip
    re-lowering every line for every keyword.
    """
    lex = T.lexicon(L.COMPLAINT_CATEGORIES)
    low = F.transform(lines, F.lower) if lines_low is None else lines_low
    pairs = F.arrays_zip(lines.alias("line"), low.alias("low"))
    cut = (lambda a: a) if first is None else (lambda a: F.slice(a, 1, first))
    per = F.transform(lex, lambda c: F.struct(
        c["name"].alias("name"),
        F.transform(cut(F.filter(pairs, lambda p: T.any_sub(p["low"], c["kws"]))), lambda p: p["line"]).alias("lines")))
    return F.filter(per, lambda x: F.size(x["lines"]) > 0)


# Words each feature-gap pattern cannot match without (a cheap substring
# pre-check that skips the regex scan on pages lacking all of them).
_GAP_ANCHORS = [["wish"], ["missing"], ["doesn't", "does not", "can't", "cannot"], ["lack"],
                ["need"], ["would"], ["no"], ["limited"]]


def feature_gaps(low: Column, first: int | None = None) -> Column:
    """Distinct gaps in pattern order; with ``first`` only those among the first so many mentions."""
    empty = F.array().cast("array<string>")
    raw = F.concat(*[F.when(T.any_sub(low, T.lit_array(a)), T.findall(low, p, 1)).otherwise(empty)
                     for p, a in zip(L.FEATURE_GAP_PATTERNS, _GAP_ANCHORS)])
    cleaned = F.transform(raw, lambda m: F.regexp_replace(T.strip(m), r"[.,;:]+$", ""))
    noise = T.lit_array(L.GAP_NOISE_PREFIXES)
    kept = F.filter(cleaned, lambda m: (F.length(m) > L.GAP_MIN_CHARS)
                    & ~F.exists(noise, lambda n: F.startswith(m, n)))
    return F.array_distinct(kept if first is None else F.slice(kept, 1, first))


def competitor_candidates(md: Column, own: Column) -> Column:
    """Names after comparison phrases (up to 3 words), lowered, filtered."""
    found = F.transform(T.findall(md, L.COMPARISON_TRIGGER_PATTERN, 1, True), lambda m: F.lower(T.strip(m)))
    stop = T.lit_array(L.COMPETITOR_STOP_WORDS)
    return F.filter(found, lambda n: (F.length(n) >= L.COMPETITOR_MIN_CHARS)
                    & ~(n == own) & ~F.array_contains(stop, n))


def _word_count(low: Column, name: Column) -> Column:
    hits = F.regexp_count(low, F.concat(F.lit(r"(?U)\b\Q"), name, F.lit(r"\E\b"))).cast("bigint")
    return F.when(F.contains(low, name), hits).otherwise(F.lit(0).cast("bigint"))


def competitor_mentions(low: Column, candidates: Column, own: Column) -> Column:
    """Alphabetical (name, count) of whole-word mentions > 0, own name removed.

    The built-in names use literal patterns (compiled once per task); only
    names found on the page itself need a per-row pattern.
    """
    common = F.array(*[F.struct(F.lit(n).alias("name"), F.when(F.contains(low, F.lit(n)), F.regexp_count(
        low, F.lit(r"(?U)\b\Q" + n + r"\E\b")).cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("count"))
        for n in L.COMMON_COMPETITORS])
    extra = F.array_except(F.array_distinct(candidates), T.lit_array(L.COMMON_COMPETITORS))
    dynamic = F.transform(extra, lambda n: F.struct(n.alias("name"), _word_count(low, n).alias("count")))
    allc = F.array_sort(F.concat(common, dynamic))
    return F.filter(allc, lambda x: (x["count"] > 0) & ((own == F.lit("")) | (x["name"] != own)))


def top_competitor(mentions: Column) -> Column:
    """Most mentioned; the first alphabetically on ties."""
    keyed = F.transform(mentions, lambda x: F.struct((-x["count"]).alias("k"), x["name"].alias("name")))
    return T.first(F.array_sort(keyed))["name"]


def lean(pos: Column, neg: Column) -> Column:
    total = pos + neg
    ratio = pos / total
    return (F.when(total == 0, "neutral")
            .when(ratio > L.SENTIMENT_POSITIVE_ABOVE, "positive")
            .when(ratio < L.SENTIMENT_NEGATIVE_BELOW, "negative")
            .otherwise("mixed"))


def extract_complaints(df: DataFrame, text_col: str = "markdown", company_col: str = "company") -> DataFrame:
    md = F.col(text_col)
    own = F.lower(T.strip(F.coalesce(F.col(company_col), F.lit(""))))
    stage = df.select("*", review_lines(md).alias("_lines"), own.alias("_own"))
    stage = stage.withColumn("_low", F.lower(F.array_join("_lines", "\n")))
    stage = stage.select("*", F.length("_low").alias("_n"), F.transform("_lines", F.lower).alias("_lines_low"))
    low, lines, n = F.col("_low"), F.col("_lines"), F.col("_n")
    stage = stage.select(
        "*",
        category_scores(low, n).alias("_scores"),
        sample_lines(lines, F.col("_lines_low")).alias("sample_complaint_lines"),
        feature_gaps(low).alias("feature_gaps_all"),
        feature_gaps(low, L.N_FEATURE_GAPS).alias("feature_gaps_mentioned"),
        competitor_mentions(low, competitor_candidates(md, F.col("_own")), F.col("_own")).alias("competitor_comparisons"),
        T.sum_counts(low, T.lit_array(L.POSITIVE_SIGNALS), n).alias("positive_signal_count"),
        T.sum_counts(low, T.lit_array(L.NEGATIVE_SIGNALS), n).alias("negative_signal_count"),
    )
    ranked = T.ranked(F.col("_scores"), keep=lambda s: s > 0)
    out = stage.select(
        "*",
        F.transform(ranked, lambda s: F.struct(s["name"].alias("name"), s["score"].alias("score"))).alias("category_scores"),
        F.slice(T.names(ranked), 1, L.N_TOP_COMPLAINTS).alias("top_complaint_categories"),
        F.aggregate("_scores", F.lit(0).cast("bigint"), lambda a, s: a + s["score"]).alias("total_complaint_signals"),
        top_competitor(F.col("competitor_comparisons")).alias("top_competitor_mentioned"),
        lean(F.col("positive_signal_count"), F.col("negative_signal_count")).alias("sentiment_lean"),
    )
    return out.drop("_lines", "_own", "_low", "_scores", "_n", "_lines_low")
