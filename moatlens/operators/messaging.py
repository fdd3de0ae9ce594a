"""Messaging facts: headlines, ranked buckets, CTAs, proof points, buzzwords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moatlens.functions import lexicons as L
from moatlens.functions import text as T
from moatlens.operators.pages import headings


def longest_first(arr: Column) -> Column:
    """Longest string, the first one on ties (``max(xs, key=len)``)."""
    keyed = F.transform(arr, lambda h, i: F.struct((-F.length(h)).alias("k"), i.alias("i"), h.alias("h")))
    return T.first(F.array_sort(keyed))["h"]


def bucket_rank(body_lower: Column, heading_lower: Column, classes,
                body_len: Column | None = None, heading_len: Column | None = None) -> Column:
    """Top classes by body count + 3 x heading count, score >= 2, ties in lexicon order."""
    lex = T.lexicon(classes)
    scored = F.transform(lex, lambda c: F.struct(
        c["name"].alias("name"), c["ord"].alias("ord"),
        (T.sum_counts(body_lower, c["kws"], body_len)
         + L.HEADING_WEIGHT * T.sum_counts(heading_lower, c["kws"], heading_len)).alias("score")))
    return T.names(T.ranked(scored, keep=lambda s: s >= L.BUCKET_MIN_SCORE, top=L.BUCKET_TOP_N))


def ctas(body_lower: Column) -> Column:
    """ARRAY<STRUCT<type, phrases>> of CTA types with phrases present, lexicon order."""
    lex = T.lexicon(L.CTA_TYPES)
    per = F.transform(lex, lambda c: F.struct(
        c["name"].alias("type"), F.filter(c["kws"], lambda k: F.contains(body_lower, k)).alias("phrases")))
    return F.filter(per, lambda x: F.size(x["phrases"]) > 0)


def proof_points(md: Column) -> Column:
    """All proof points in pattern order."""
    return F.concat(*[T.findall(md, p, 0, True) for p in L.PROOF_PATTERNS])


def uptime_claims(md: Column) -> Column:
    return T.findall(md, L.UPTIME_PATTERN, 0, True)


def buzzwords(body_lower: Column) -> Column:
    lex = F.array(*[F.struct(F.lit(b).alias("word"), F.lit(b.lower()).alias("low")) for b in L.BUZZWORDS])
    return F.transform(F.filter(lex, lambda b: F.contains(body_lower, b["low"])), lambda b: b["word"])


def extract_messaging(df: DataFrame, text_col: str = "markdown") -> DataFrame:
    md = F.col(text_col)
    stage = df.select("*", F.filter(T.lines(md), lambda l: F.startswith(l, F.lit("#"))).alias("_hl"))
    stage = stage.select(
        "*",
        headings(md, L.H1_PATTERN, F.col("_hl")).alias("_h1"),
        headings(md, L.H2_PATTERN, F.col("_hl")).alias("_h2"),
        headings(md, L.H3_PATTERN, F.col("_hl")).alias("_h3"),
        F.lower(md).alias("_low"),
    ).withColumn("_hlow", F.lower(F.array_join(F.concat("_h1", "_h2", "_h3"), " ")))
    stage = stage.select("*", F.length("_low").alias("_n"), F.length("_hlow").alias("_hn"))
    low, hlow, n, hn = F.col("_low"), F.col("_hlow"), F.col("_n"), F.col("_hn")
    out = stage.select(
        "*",
        longest_first(F.col("_h1")).alias("main_headline"), F.size("_h1").alias("n_h1"),
        F.slice("_h2", 1, L.N_SUBHEADLINES).alias("subheadlines"), F.col("_h2").alias("subheadlines_all"),
        F.slice("_h3", 1, L.N_H3).alias("h3_messages"), F.col("_h3").alias("h3_messages_all"),
        bucket_rank(low, hlow, L.SEGMENTS, n, hn).alias("target_segments"),
        bucket_rank(low, hlow, L.VALUE_PROPS, n, hn).alias("positioning_angle"),
        bucket_rank(low, hlow, L.TONES, n, hn).alias("emotional_tone"),
        ctas(low).alias("ctas_by_type"),
        proof_points(md).alias("proof_points_all"),
        uptime_claims(md).alias("uptime_claims"),
        buzzwords(low).alias("buzzwords"),
    )
    out = out.withColumn("proof_points", F.slice("proof_points_all", 1, L.N_PROOF_POINTS)) \
             .withColumn("primary_cta", T.first(F.flatten(F.transform("ctas_by_type", lambda x: x["phrases"])))) \
             .withColumn("buzzword_count", F.size("buzzwords"))
    return out.drop("_hl", "_h1", "_h2", "_h3", "_low", "_hlow", "_n", "_hn")
