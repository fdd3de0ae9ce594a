"""Change detection between consecutive snapshots of a company.

Each ``diff_<feature>(old, new)`` returns ARRAY<STRUCT<seq, kind, detail,
message>> for one pair of feature records (structs). ``change_events`` applies
them to every consecutive pair of a snapshot history; the newest pair is the
comparison a crawl makes against the stored latest snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moatlens.functions import lexicons as L
from moatlens.functions import text as T
from moatlens.operators import snapshots as snap

def _arr(rec: Column, field: str) -> Column:
    return F.coalesce(rec[field], F.array().cast("array<string>"))


def render_set(arr: Column) -> Column:
    """``{'a', 'b'}`` with sorted items (a set prints unordered in Python)."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(arr), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("}"))


def _q(c: Column) -> Column:
    return F.concat(F.lit("'"), F.coalesce(c, F.lit("None")), F.lit("'"))


def _ev(seq: int, cond: Column, kind: str, detail: Column, message: Column) -> Column:
    return F.when(cond, F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"),
                                 detail.alias("detail"), message.alias("message")))


def _set_ev(seq: int, kind: str, label: str, diff: Column) -> Column:
    return _ev(seq, F.size(diff) > 0, kind, F.array_join(F.array_sort(diff), ", "),
               F.concat(F.lit(label + ": "), render_set(diff)))


def _flip_ev(seq: int, kind: str, old: Column, new: Column, message: Column) -> Column:
    return _ev(seq, ~old.eqNullSafe(new), kind,
               F.concat(_q(old.cast("string")), F.lit(" → "), _q(new.cast("string"))), message)


def _change_ev(seq: int, kind: str, label: str, old: Column, new: Column) -> Column:
    text = F.concat(_q(old), F.lit(" → "), _q(new))
    return _ev(seq, ~old.eqNullSafe(new), kind, text, F.concat(F.lit(label + ": "), text))


def _events(*evs: Column) -> Column:
    return F.filter(F.array(*evs), lambda e: e.isNotNull())


def diff_pricing(old: Column, new: Column) -> Column:
    om, nm = _arr(old, "monthly_prices"), _arr(new, "monthly_prices")
    ot, nt = _arr(old, "tiers_found"), _arr(new, "tiers_found")
    return _events(
        _set_ev(1, "new_monthly_prices", "NEW monthly prices", F.array_except(nm, om)),
        _set_ev(2, "removed_monthly_prices", "REMOVED monthly prices", F.array_except(om, nm)),
        _set_ev(3, "new_tiers", "NEW tiers added", F.array_except(nt, ot)),
        _set_ev(4, "removed_tiers", "REMOVED tiers", F.array_except(ot, nt)),
        _flip_ev(5, "free_tier", old["has_free_tier"], new["has_free_tier"],
                 F.concat(F.lit("FREE TIER "), F.when(F.coalesce(new["has_free_tier"], F.lit(False)), "ADDED").otherwise("REMOVED"))),
        _flip_ev(6, "sales_call", old["requires_sales_call"], new["requires_sales_call"],
                 F.concat(F.lit("Sales call requirement "),
                          F.when(F.coalesce(new["requires_sales_call"], F.lit(False)), "now requires").otherwise("dropped"))),
    )


def diff_messaging(old: Column, new: Column) -> Column:
    os_, ns = _arr(old, "target_segments"), _arr(new, "target_segments")
    return _events(
        _change_ev(1, "headline", "HEADLINE CHANGED", old["main_headline"], new["main_headline"]),
        _set_ev(2, "new_segments", "NOW targeting new segments", F.array_except(ns, os_)),
        _set_ev(3, "dropped_segments", "DROPPED targeting", F.array_except(os_, ns)),
        _change_ev(4, "primary_cta", "PRIMARY CTA CHANGED", old["primary_cta"], new["primary_cta"]),
        _set_ev(5, "new_positioning", "NEW positioning angle",
                F.array_except(_arr(new, "positioning_angle"), _arr(old, "positioning_angle"))),
    )


def _pct(share: Column) -> Column:
    """Python ``{share:.0%}`` (round half to even of share*100)."""
    return F.concat(F.bround(share * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def diff_complaints(old: Column, new: Column) -> Column:
    old_top = F.try_element_at(_arr(old, "top_complaint_categories"), F.lit(1))
    new_top = F.try_element_at(_arr(new, "top_complaint_categories"), F.lit(1))
    shift = _ev(1, old_top.isNotNull() & new_top.isNotNull() & (old_top != new_top), "top_shift",
                F.concat(_q(old_top), F.lit(" → "), _q(new_top)),
                F.concat(F.lit("TOP COMPLAINT SHIFTED: "), _q(old_top), F.lit(" → "), _q(new_top)))
    old_total = F.coalesce(F.nullif(old["total_complaint_signals"], F.lit(0)), F.lit(1))
    new_total = F.coalesce(F.nullif(new["total_complaint_signals"], F.lit(0)), F.lit(1))
    old_scores = F.coalesce(old["category_scores"], F.array().cast("array<struct<name:string,score:bigint>>"))
    new_scores = F.coalesce(new["category_scores"], F.array().cast("array<struct<name:string,score:bigint>>"))

    def spike(s):
        old_score = F.coalesce(F.aggregate(F.filter(old_scores, lambda o: o["name"] == s["name"]),
                                           F.lit(None).cast("bigint"), lambda a, o: F.coalesce(a, o["score"])), F.lit(0))
        old_share = old_score / old_total
        new_share = s["score"] / new_total
        fire = (old_score != 0) & (new_share > old_share * L.SHARE_SPIKE_FACTOR) & (new_share > L.SHARE_SPIKE_FLOOR)
        return F.when(fire, F.struct(
            F.lit(2).alias("seq"), F.lit("share_spike").alias("kind"), s["name"].alias("detail"),
            F.concat(F.lit("COMPLAINT SHARE SPIKE in '"), s["name"], F.lit("': "), _pct(old_share),
                     F.lit(" → "), _pct(new_share)).alias("message")))
    spikes = F.filter(F.transform(new_scores, spike), lambda e: e.isNotNull())
    old_c = F.transform(F.coalesce(old["competitor_comparisons"], F.array().cast("array<struct<name:string,count:bigint>>")), lambda x: x["name"])
    new_c = F.transform(F.coalesce(new["competitor_comparisons"], F.array().cast("array<struct<name:string,count:bigint>>")), lambda x: x["name"])
    comps = _set_ev(3, "new_competitors", "NEW competitor comparisons appearing", F.array_except(new_c, old_c))
    return F.concat(_events(shift), spikes, _events(comps))


def diff_signals(old: Column, new: Column) -> Column:
    return _events(
        _change_ev(1, "hiring_focus", "HIRING FOCUS SHIFTED", old["biggest_hiring_push"], new["biggest_hiring_push"]),
        _set_ev(2, "new_tech", "NEW tech investment areas",
                F.array_except(_arr(new, "tech_investments"), _arr(old, "tech_investments"))),
        _set_ev(3, "new_geo", "NEW geographic expansion signals",
                F.array_except(_arr(new, "geographic_expansion"), _arr(old, "geographic_expansion"))),
        _change_ev(4, "remote_stance", "REMOTE POLICY CHANGED", old["remote_stance"], new["remote_stance"]),
    )


DIFFS = {"pricing": diff_pricing, "messaging": diff_messaging, "complaints": diff_complaints, "signals": diff_signals}


def stale_guard(old: Column, new: Column) -> Column:
    """True when the pair may be compared: new attempted and neither side stale."""
    return (new.isNotNull() & ~F.coalesce(old["is_stale"], F.lit(False))
            & ~F.coalesce(new["is_stale"], F.lit(False)))


def feature_changes(paired: DataFrame, feature: str) -> Column:
    old, new = F.col(f"prev_{feature}"), F.col(feature)
    return F.when(stale_guard(old, new), DIFFS[feature](old, new)).otherwise(
        F.array().cast("array<struct<seq:int,kind:string,detail:string,message:string>>"))


def change_events(snaps: DataFrame, key: str = "company", ts: str = "snapshot_ts",
                  features=snap.FEATURES) -> DataFrame:
    """Long table of change messages for every consecutive snapshot pair.

    The pairs cost the shuffles of ``with_previous``; the diffs are map-side.
    Only the columns of the features asked for are moved.
    """
    paired = snap.with_previous(snaps.select(key, ts, *features), key, ts, features).filter(F.col("compared_with").isNotNull())
    per = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("f_ord"),
                             feature_changes(paired, f).alias("evs")) for i, f in enumerate(features)])
    x = paired.select(key, F.col(ts).alias("detected_at"), "compared_with",
                      snap.stale_features(paired, features).alias("stale_features"), T.explode_kept(per).alias("p"))
    x = x.select(key, "detected_at", "compared_with", "stale_features", "p.feature", "p.f_ord",
                 T.explode_kept(F.col("p.evs"), pos=True).alias("pos", "e")).filter(F.col("e").isNotNull())
    return x.select(key, "detected_at", "compared_with", "stale_features", "feature", "f_ord", "pos",
                    F.col("e.seq").alias("seq"), F.col("e.kind").alias("kind"),
                    F.col("e.detail").alias("detail"), F.col("e.message").alias("message"))


def report_of_pairs(paired: DataFrame, key: str = "company", ts: str = "snapshot_ts", features=snap.FEATURES) -> DataFrame:
    """(company, detected_at, compared_with, changes, stale_features) of every pair, also of those without changes.

    ``changes`` lists (feature, message) in feature order. Nothing is shuffled.
    """
    def said(f: str) -> Column:
        return F.transform(feature_changes(paired, f), lambda e: F.struct(F.lit(f).alias("feature"), e["message"].alias("message")))
    return paired.select(key, F.col(ts).alias("detected_at"), "compared_with", F.concat(*[said(f) for f in features]).alias("changes"),
                         snap.stale_features(paired, features).alias("stale_features"))


def change_report(snaps: DataFrame, key: str = "company", ts: str = "snapshot_ts",
                  features=snap.FEATURES) -> DataFrame:
    """One report per (company, snapshot) with any change: messages by feature + stale features.

    A report holds the messages of one snapshot pair (bounded by features x
    kinds). The pairs cost the shuffle of ``with_previous``, the reports none.
    ``change_log`` keeps reports up to date without reading the history again.
    """
    paired = snap.with_previous(snaps.select(key, ts, *features), key, ts, features).filter(F.col("compared_with").isNotNull())
    rep = report_of_pairs(paired, key, ts, features)
    # the generator keeps the filter behind it from computing the changes a second time
    one = rep.select(key, "detected_at", "compared_with", T.explode_kept(F.array("changes")).alias("changes"), "stale_features")
    return one.filter(F.size("changes") > 0)


def change_report_json(report: DataFrame, key: str = "company") -> DataFrame:
    """JSON document per report: changes grouped by feature (only written when non-empty)."""
    feats = F.array_distinct(F.transform("changes", lambda c: c["feature"]))
    by_feature = F.map_from_arrays(feats, F.transform(feats, lambda f: F.transform(
        F.filter("changes", lambda c: c["feature"] == f), lambda c: c["message"])))
    doc = F.struct(F.col(key).alias("company"), F.col("detected_at").cast("string").alias("detected_at"),
                   F.col("compared_with").cast("string").alias("compared_with"),
                   by_feature.alias("changes"), F.col("stale_features").alias("stale_features"))
    return report.filter(F.size("changes") > 0).select(key, F.col("detected_at"), F.to_json(doc).alias("doc"))


def write_change_reports(report: DataFrame, path: str, key: str = "company") -> None:
    """One JSON line per report; the commit protocol makes the write atomic."""
    change_report_json(report, key).select("doc").write.mode("overwrite").text(path)
