"""Registered queries: messaging, complaint and hiring-signal extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from moatlens.functions import lexicons as L
from moatlens.functions import text as T
from moatlens.operators import complaints, messaging, sentiment, signals
from moatlens.operators.pages import review_lines
from moatlens.plans import sqlkit as S
from moatlens.plans.q_misc import compound_sql
from moatlens.plans.registry import q, query
from moatlens.sources import fixtures as X


def _name_scores(col, score="score"):
    return F.array_join(F.transform(col, lambda s: F.concat(s["name"], F.lit(":"), s[score].cast("string"))), "|")


# ------------------------------------------------------------- messaging ----
def _msg(spark, sf):
    return messaging.extract_messaging(X.pages(spark, sf, "fx_messaging_pages"))


def _heads(pat):
    return (f"list_transform(list_filter({S.lines('markdown')}, lambda l: regexp_matches(l, {q(pat)})), "
            f"lambda l: regexp_replace({S.strip('l')}, {q(L.HEADING_PREFIX_PATTERN)}, ''))")


_MSG = X.cte("fx_messaging_pages") + f"""
, hh as (select page_id, markdown, lower(markdown) as low, {_heads(L.H1_PATTERN)} as h1,
    {_heads(L.H2_PATTERN)} as h2, {_heads(L.H3_PATTERN)} as h3 from fx_messaging_pages),
mm as (select *, lower(array_to_string(h1 || h2 || h3, ' ')) as hlow from hh)
"""


@query("headings", _MSG + f"""
select page_id,
  list_filter(h1, lambda x: length(x) = list_max(list_transform(h1, lambda y: length(y))))[1] as main_headline,
  array_to_string(list_slice(h2, 1, {L.N_SUBHEADLINES}), '|') as subheadlines,
  array_to_string(list_slice(h3, 1, {L.N_H3}), '|') as h3_messages, cast(len(h1) as bigint) as n_h1,
  array_to_string(h2, '|') as subheadlines_all, array_to_string(h3, '|') as h3_messages_all from mm""")
def q_headings(spark, sf):
    return _msg(spark, sf).select("page_id", "main_headline", T.join(F.col("subheadlines")).alias("subheadlines"),
                                  T.join(F.col("h3_messages")).alias("h3_messages"), F.col("n_h1").cast("bigint").alias("n_h1"),
                                  *[T.join(F.col(c)).alias(c) for c in ("subheadlines_all", "h3_messages_all")])


def _bucket(lex):
    score = lambda kws: f"{S.sum_counts('low', kws)} + {L.HEADING_WEIGHT} * {S.sum_counts('hlow', kws)}"
    return S.joined(S.names_of(S.ranked(lex, score, f">= {L.BUCKET_MIN_SCORE}", L.BUCKET_TOP_N)))


@query("bucket_rank", _MSG + f"""
select page_id, {_bucket(L.SEGMENTS)} as target_segments, {_bucket(L.VALUE_PROPS)} as positioning_angle,
  {_bucket(L.TONES)} as emotional_tone from mm""")
def q_bucket(spark, sf):
    return _msg(spark, sf).select(
        "page_id", *[T.join(F.col(c)).alias(c) for c in ("target_segments", "positioning_angle", "emotional_tone")])


_CTA_PER = "[" + ", ".join(
    f"{{'type': {q(t)}, 'phrases': list_filter({S.sql_list(kws)}, lambda k: contains(low, k))}}"
    for t, kws in L.CTA_TYPES) + "]"


@query("ctas", _MSG + f"""
, c as (select page_id, list_filter({_CTA_PER}, lambda x: len(x.phrases) > 0) as cl from mm)
select page_id, array_to_string(list_transform(cl, lambda x: x.type), '|') as cta_types,
  array_to_string(flatten(list_transform(cl, lambda x: x.phrases)), '|') as cta_phrases,
  flatten(list_transform(cl, lambda x: x.phrases))[1] as primary_cta from c""")
def q_ctas(spark, sf):
    m = _msg(spark, sf)
    return m.select("page_id", T.join(F.transform("ctas_by_type", lambda x: x["type"])).alias("cta_types"),
                    T.join(F.flatten(F.transform("ctas_by_type", lambda x: x["phrases"]))).alias("cta_phrases"),
                    "primary_cta")


@query("proof_points", _MSG + f"""
, pp as (select page_id, {' || '.join(S.findall('markdown', p, 0, True) for p in L.PROOF_PATTERNS)} as p from mm)
select page_id, array_to_string(list_slice(p, 1, {L.N_PROOF_POINTS}), '|') as proof_points, array_to_string(p, '|') as proof_points_all from pp""")
def q_proof(spark, sf):
    return _msg(spark, sf).select("page_id", *[T.join(F.col(c)).alias(c) for c in ("proof_points", "proof_points_all")])


@query("uptime_claims", _MSG + f"""
select page_id, array_to_string({S.findall('markdown', L.UPTIME_PATTERN, 0, True)}, '|') as uptime_claims from mm""")
def q_uptime(spark, sf):
    return _msg(spark, sf).select("page_id", T.join(F.col("uptime_claims")).alias("uptime_claims"))


_BUZZ = "[" + ", ".join(f"case when contains(low, {q(b.lower())}) then {q(b)} end" for b in L.BUZZWORDS) + "]"


@query("buzzwords", _MSG + f"""
, b as (select page_id, list_filter({_BUZZ}, lambda x: x is not null) as bl from mm)
select page_id, array_to_string(bl, '|') as buzzwords, cast(len(bl) as bigint) as buzzword_count from b""")
def q_buzz(spark, sf):
    return _msg(spark, sf).select("page_id", T.join(F.col("buzzwords")).alias("buzzwords"),
                                  F.col("buzzword_count").cast("bigint").alias("buzzword_count"))


# ------------------------------------------------------------ complaints ----
def _cmp(spark, sf):
    return complaints.extract_complaints(X.pages(spark, sf, "fx_review_pages"))


_CMP = X.cte("fx_review_pages") + f"""
, rl as (select page_id, company, markdown, list_transform(list_filter({S.lines('markdown')}, lambda l:
      length({S.strip('l')}) > {L.REVIEW_LINE_MIN_CHARS} and not regexp_matches(l, {q(L.NAV_PATTERN)})),
      lambda l: {S.strip('l')}) as lines, lower(trim(company)) as own from fx_review_pages),
cc as (select *, lower(array_to_string(lines, chr(10))) as low from rl)
"""


@query("review_lines", _CMP + """
select page_id, cast(len(lines) as bigint) as n_lines, array_to_string(lines, chr(10)) as clean_text from cc""")
def q_review_lines(spark, sf):
    from moatlens.operators.pages import review_lines
    df = X.pages(spark, sf, "fx_review_pages").select("page_id", review_lines(F.col("markdown")).alias("l"))
    return df.select("page_id", F.size("l").cast("bigint").alias("n_lines"), F.array_join("l", "\n").alias("clean_text"))


_CAT_RANK = S.ranked(L.COMPLAINT_CATEGORIES, lambda kws: S.sum_counts("low", kws), "> 0")


@query("complaint_scores", _CMP + f"""
select page_id, array_to_string(list_slice({S.names_of(_CAT_RANK)}, 1, {L.N_TOP_COMPLAINTS}), '|') as top_complaint_categories,
  {S.name_scores(_CAT_RANK)} as category_scores,
  cast({' + '.join(S.sum_counts('low', kws) for _, kws in L.COMPLAINT_CATEGORIES)} as bigint) as total_complaint_signals
from cc""")
def q_complaint_scores(spark, sf):
    return _cmp(spark, sf).select(
        "page_id", T.join(F.col("top_complaint_categories")).alias("top_complaint_categories"),
        _name_scores(F.col("category_scores")).alias("category_scores"),
        F.col("total_complaint_signals").cast("bigint").alias("total_complaint_signals"))


_CATS_VALUES = "(values " + ", ".join(f"({q(n)}, {i}, {S.sql_list(kws)})" for i, (n, kws) in enumerate(L.COMPLAINT_CATEGORIES)) + ") as k(category, cat_ord, kws)"


@query("complaint_samples", _CMP + f"""
, u as (select page_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as line_no from cc),
m as (select page_id, category, line, row_number() over (partition by page_id, category order by line_no) as sample_no
  from u cross join {_CATS_VALUES} where len(list_filter(kws, lambda kw: contains(lower(line), kw))) > 0)
select page_id, category, cast(sample_no as bigint) as sample_no, line from m where sample_no <= {L.N_SAMPLE_LINES}""")
def q_complaint_samples(spark, sf):
    df = _cmp(spark, sf).select("page_id", T.explode_kept(F.col("sample_complaint_lines")).alias("s")) \
        .filter(F.col("s").isNotNull())
    return df.select("page_id", F.col("s.name").alias("category"),
                     T.explode_kept(F.col("s.lines"), pos=True).alias("pos", "line")).filter(F.col("line").isNotNull()).select(
        "page_id", "category", (F.col("pos") + 1).cast("bigint").alias("sample_no"), "line")


_GAPS = " || ".join(S.findall("low", p, 1) for p in L.FEATURE_GAP_PATTERNS)
_NOISE = " or ".join(f"starts_with(m, {q(n)})" for n in L.GAP_NOISE_PREFIXES)


@query("feature_gaps", _CMP + f"""
, g as (select page_id, list_filter(list_transform({_GAPS}, lambda m: regexp_replace({S.strip('m')}, '[.,;:]+$', '')),
   lambda m: length(m) > {L.GAP_MIN_CHARS} and not ({_NOISE})) as ga, list_slice(ga, 1, {L.N_FEATURE_GAPS}) as gl from cc)
select page_id, array_to_string({S.dedupe('gl')}, '|') as feature_gaps_mentioned, array_to_string({S.dedupe('ga')}, '|') as feature_gaps_all from g""")
def q_gaps(spark, sf):
    return _cmp(spark, sf).select("page_id", T.join(F.col("feature_gaps_mentioned")).alias("feature_gaps_mentioned"),
                                  T.join(F.col("feature_gaps_all")).alias("feature_gaps_all"))


@query("competitor_candidates", _CMP + f"""
select page_id, array_to_string(list_filter(list_transform({S.findall('markdown', L.COMPARISON_TRIGGER_PATTERN, 1, True)},
   lambda m: lower({S.strip('m')})), lambda n: length(n) >= {L.COMPETITOR_MIN_CHARS} and n <> own
   and not list_contains({S.sql_list(L.COMPETITOR_STOP_WORDS)}, n)), '|') as candidates from cc""")
def q_candidates(spark, sf):
    df = X.pages(spark, sf, "fx_review_pages")
    own = F.lower(T.strip(F.col("company")))
    return df.select("page_id", T.join(complaints.competitor_candidates(F.col("markdown"), own)).alias("candidates"))


_CANDS = (f"list_filter(list_transform({S.findall('markdown', L.COMPARISON_TRIGGER_PATTERN, 1, True)}, "
          f"lambda m: lower({S.strip('m')})), lambda n: length(n) >= {L.COMPETITOR_MIN_CHARS} and n <> own "
          f"and not list_contains({S.sql_list(L.COMPETITOR_STOP_WORDS)}, n))")


@query("competitor_mentions", _CMP + f"""
, nm as (select page_id, low, own, list_sort(list_distinct({S.sql_list(L.COMMON_COMPETITORS)} || {_CANDS})) as names from cc),
ct as (select page_id, list_filter(list_transform(list_filter(names, lambda n: own = '' or n <> own),
   lambda n: {{'name': n, 'score': len(regexp_extract_all(low, '\\b' || n || '\\b', 0))}}), lambda x: x.score > 0) as cl from nm)
select page_id, {S.name_scores('cl')} as competitor_comparisons,
  list_sort(list_transform(cl, lambda x: {{'k': -x.score, 'name': x.name}}))[1].name as top_competitor_mentioned from ct""")
def q_mentions(spark, sf):
    return _cmp(spark, sf).select(
        "page_id", _name_scores(F.col("competitor_comparisons"), "count").alias("competitor_comparisons"),
        "top_competitor_mentioned")


@query("sentiment_lean", _CMP + f"""
, s as (select page_id, cast({S.sum_counts('low', L.POSITIVE_SIGNALS)} as bigint) as pos,
  cast({S.sum_counts('low', L.NEGATIVE_SIGNALS)} as bigint) as neg from cc)
select page_id, pos as positive_signal_count, neg as negative_signal_count,
  case when pos + neg = 0 then 'neutral' when pos / (pos + neg) > {L.SENTIMENT_POSITIVE_ABOVE} then 'positive'
       when pos / (pos + neg) < {L.SENTIMENT_NEGATIVE_BELOW} then 'negative' else 'mixed' end as sentiment_lean from s""")
def q_lean(spark, sf):
    return _cmp(spark, sf).select("page_id", "positive_signal_count", "negative_signal_count", "sentiment_lean")


# --------------------------------------------------------------- signals ----
def _sig(spark, sf):
    return signals.extract_signals(X.pages(spark, sf, "fx_jobs_pages"))


_SIG = X.cte("fx_jobs_pages") + ", jj as (select page_id, lower(markdown) as low from fx_jobs_pages)\n"
_DEPT_RANK = S.ranked(L.DEPARTMENTS, lambda kws: S.sum_counts("low", kws), "> 0")


@query("dept_hits", _SIG + f"""
select page_id, {S.name_scores(_DEPT_RANK)} as hiring_by_department, {S.names_of(_DEPT_RANK)}[1] as biggest_hiring_push,
  array_to_string(list_slice({S.names_of(_DEPT_RANK)}, 1, 3), '|') as top_3_departments,
  cast({' + '.join(S.sum_counts('low', kws) for _, kws in L.DEPARTMENTS)} as bigint) as total_dept_keyword_hits from jj""")
def q_dept(spark, sf):
    return _sig(spark, sf).select(
        "page_id", _name_scores(F.col("hiring_by_department"), "count").alias("hiring_by_department"),
        "biggest_hiring_push", T.join(F.col("top_3_departments")).alias("top_3_departments"),
        F.col("total_dept_keyword_hits").cast("bigint").alias("total_dept_keyword_hits"))


@query("tech_areas", _SIG + f"select page_id, {S.joined(S.classes('low', L.TECH_AREAS))} as tech_investments from jj")
def q_tech(spark, sf):
    return _sig(spark, sf).select("page_id", T.join(F.col("tech_investments")).alias("tech_investments"))


@query("geo_signals", _SIG + f"select page_id, {S.joined(S.classes('low', L.REGIONS))} as geographic_expansion from jj")
def q_geo(spark, sf):
    return _sig(spark, sf).select("page_id", T.join(F.col("geographic_expansion")).alias("geographic_expansion"))


_LV = dict(L.SENIORITY)
_LEVEL_CASE = "case " + " ".join(f"when {S.any_sub('l', _LV[v])} then {q(v)}" for v in L.SENIORITY_PRIORITY) + " end"


@query("seniority_mix", _SIG + f"""
, lv as (select page_id, list_transform(list_filter(list_transform({S.lines('low')}, lambda l: {S.strip('l')}),
    lambda l: length(l) >= {L.SENIORITY_MIN_LINE_CHARS}), lambda l: {_LEVEL_CASE}) as levels from jj),
c as (select page_id, {', '.join(f"cast(len(list_filter(levels, lambda x: x = {q(v)})) as bigint) as {v}" for v, _ in L.SENIORITY)} from lv)
select page_id, junior, mid, senior, leadership,
  case when junior + mid + senior + leadership = 0 then null
       when junior = greatest(junior, mid, senior, leadership) then 'junior'
       when mid = greatest(junior, mid, senior, leadership) then 'mid'
       when senior = greatest(junior, mid, senior, leadership) then 'senior' else 'leadership' end as dominant_seniority from c""")
def q_seniority(spark, sf):
    return _sig(spark, sf).select("page_id", *[F.col(f"seniority_distribution.{v}").alias(v) for v, _ in L.SENIORITY],
                                  "dominant_seniority")


@query("remote_stance", _SIG + """
select page_id, case when contains(low, 'fully remote') or contains(low, 'remote-first') then 'remote-first'
  when contains(low, 'remote') and contains(low, 'office') then 'hybrid'
  when contains(low, 'in-office') or contains(low, 'on-site') then 'in-office'
  when contains(low, 'remote') then 'remote-friendly' else 'unknown' end as remote_stance from jj""")
def q_remote(spark, sf):
    return _sig(spark, sf).select("page_id", "remote_stance")


_D = {n: S.sum_counts("low", kws) for n, kws in L.DEPARTMENTS}
_TECH = S.classes("low", L.TECH_AREAS)


@query("strategic_inferences", _SIG + f"""
, d as (select page_id, {', '.join(f'{v} as {n}' for n, v in _D.items())}, {_TECH} as tech from jj)
select page_id, array_to_string(list_filter([
  case when data_ai > engineering * 0.3::double then {q(L.INFER_AI)} end,
  case when sales > customer_success * 1.7::double then {q(L.INFER_SALES_LED)}
       when customer_success > sales then {q(L.INFER_RETENTION)}
       when sales > 0 or customer_success > 0 then {q(L.INFER_BALANCED)} end,
  case when security >= 2 then {q(L.INFER_ENTERPRISE)} end,
  case when leadership >= 3 then {q(L.INFER_LEADERSHIP)} end,
  case when list_contains(tech, 'AI_ML') and list_contains(tech, 'api_platform') then {q(L.INFER_DEV_AI)} end],
  lambda x: x is not null), '|') as strategic_inferences from d""")
def q_infer(spark, sf):
    return _sig(spark, sf).select("page_id", T.join(F.col("strategic_inferences")).alias("strategic_inferences"))


@query("polarity_rules", _CMP + """
, rv as (select company, page_id, unnest(lines) as text, unnest(range(1, len(lines) + 1)) as line_no from cc),
src as (select company, concat(page_id, ':', line_no) as text_id, text from rv)""" + compound_sql("src", "company") + """
select company, round(avg(c), 6) as compound_score, cast(count(*) as bigint) as sample_size, cast(count_if(c <> 0) as bigint) as lines_with_polarity
from cp group by company""")
def q_polarity_rules(spark, sf):
    """Polarity of the review lines of every company."""
    lines = X.pages(spark, sf, "fx_review_pages").select("company", T.explode_kept(review_lines(F.col("markdown"))).alias("text"))
    return sentiment.polarity_mean(lines, "company", counted=True)
