"""Hiring and investment signals from jobs pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moatlens.functions import lexicons as L
from moatlens.functions import text as T

_DEPT_IDX = {name: i + 1 for i, (name, _) in enumerate(L.DEPARTMENTS)}
_LEVELS = dict(L.SENIORITY)


def dept_scores(low: Column, low_len: Column | None = None) -> Column:
    lex = T.lexicon(L.DEPARTMENTS)
    return F.transform(lex, lambda c: F.struct(
        c["name"].alias("name"), c["ord"].alias("ord"), T.sum_counts(low, c["kws"], low_len).alias("score")))


def dept_count(scores: Column, name: str) -> Column:
    return F.element_at(scores, _DEPT_IDX[name])["score"]


def seniority_levels(low: Column) -> Column:
    """One level per stripped line of >= 5 chars, highest priority first."""
    kept = F.filter(F.transform(T.lines(low), T.strip), lambda l: F.length(l) >= L.SENIORITY_MIN_LINE_CHARS)

    def level(line):
        expr = None
        for lvl in L.SENIORITY_PRIORITY:
            cond = T.any_sub(line, T.lit_array(_LEVELS[lvl]))
            expr = F.when(cond, F.lit(lvl)) if expr is None else expr.when(cond, F.lit(lvl))
        return expr
    return F.transform(kept, level)


def seniority_distribution(levels: Column) -> Column:
    def is_level(lvl):
        return lambda x: x == lvl
    return F.struct(*[
        F.size(F.filter(levels, is_level(lvl))).cast("bigint").alias(lvl) for lvl, _ in L.SENIORITY])


def dominant_seniority(dist: Column) -> Column:
    keyed = F.array(*[F.struct((-dist[lvl]).alias("k"), F.lit(i).alias("i"), F.lit(lvl).alias("name"))
                      for i, (lvl, _) in enumerate(L.SENIORITY)])
    total = sum((dist[lvl] for lvl, _ in L.SENIORITY), F.lit(0))
    return F.when(total > 0, T.first(F.array_sort(keyed))["name"])


def remote_stance(low: Column) -> Column:
    c = lambda s: F.contains(low, F.lit(s))
    return (F.when(c("fully remote") | c("remote-first"), "remote-first")
            .when(c("remote") & c("office"), "hybrid")
            .when(c("in-office") | c("on-site"), "in-office")
            .when(c("remote"), "remote-friendly")
            .otherwise("unknown"))


def strategic_inferences(scores: Column, tech: Column) -> Column:
    d = lambda n: dept_count(scores, n)
    sales, cs = d("sales"), d("customer_success")
    rules = [
        F.when(d("data_ai") > d("engineering") * 0.3, F.lit(L.INFER_AI)),
        F.when(sales > cs * 1.7, F.lit(L.INFER_SALES_LED))
         .when(cs > sales, F.lit(L.INFER_RETENTION))
         .when((sales > 0) | (cs > 0), F.lit(L.INFER_BALANCED)),
        F.when(d("security") >= 2, F.lit(L.INFER_ENTERPRISE)),
        F.when(d("leadership") >= 3, F.lit(L.INFER_LEADERSHIP)),
        F.when(F.array_contains(tech, "AI_ML") & F.array_contains(tech, "api_platform"), F.lit(L.INFER_DEV_AI)),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def extract_signals(df: DataFrame, text_col: str = "markdown") -> DataFrame:
    stage = df.withColumn("_low", F.lower(F.col(text_col)))
    stage = stage.withColumn("_n", F.length("_low"))
    low = F.col("_low")
    stage = stage.select(
        "*",
        dept_scores(low, F.col("_n")).alias("_scores"),
        T.classes_present(low, T.lexicon(L.TECH_AREAS)).alias("tech_investments"),
        seniority_distribution(seniority_levels(low)).alias("seniority_distribution"),
        T.classes_present(low, T.lexicon(L.REGIONS)).alias("geographic_expansion"),
        remote_stance(low).alias("remote_stance"),
    )
    ranked = T.ranked(F.col("_scores"), keep=lambda s: s > 0)
    out = stage.select(
        "*",
        F.transform(ranked, lambda s: F.struct(s["name"].alias("name"), s["score"].alias("count"))).alias("hiring_by_department"),
        F.aggregate(ranked, F.lit(0).cast("bigint"), lambda a, s: a + s["score"]).alias("total_dept_keyword_hits"),
        T.first(T.names(ranked)).alias("biggest_hiring_push"),
        F.slice(T.names(ranked), 1, 3).alias("top_3_departments"),
        dominant_seniority(F.col("seniority_distribution")).alias("dominant_seniority"),
        strategic_inferences(F.col("_scores"), F.col("tech_investments")).alias("strategic_inferences"),
    )
    return out.drop("_low", "_scores", "_n")
