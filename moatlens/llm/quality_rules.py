"""Quality rules with adaptive thresholds.

Each document gets counts (words, symbols, repeated lines and windows) and
four integer rates. Per language and source every rate is summarised in a
mergeable quantile sketch: counts of log-linear buckets with a relative error
of 1/32. Sketches merge by adding counts, so a group with few documents falls
back on its language's sketch and then on the whole table's, both made by
merging. Thresholds are quantile fences; documents join their group's.

Everything is a DataFrame expression. Defined cases: a null or blank text has
no words and fails the base rule; a null language or source is a group of its
own; repeated rows are judged alike, each; an empty table gives no rows; extra
columns pass through, own columns are prefixed ``qr_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moatlens.llm.common import WORD, let, lookup, words, written

N = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
#: Groups with fewer documents use the sketch of the next wider group.
MIN_GROUP = 50
#: rate: (lower fence too, least distance of a fence from the median).
#: Rates: symbols, repeated lines and repeated words per thousand, and word length in hundredths.
RULES = {"sym": (False, 150), "dup": (False, 400), "rep": (False, 200), "len": (True, 250)}
#: A fence stands FENCE times the distance from the median to the 90 % (10 %) quantile away from the median.
FENCE = 4


def covered_words(grams: Column, n: int = N) -> Column:
    """Words covered by windows (given by their hashes, in order) that occur more than once."""
    def starts(s: Column) -> Column:
        same = lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"])) | (
            (j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["h"] == x["h"]))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda x, j: F.when(j < F.size(p) - 1, F.least(F.lit(n), p[F.least(j + 1, F.size(p) - 1)] - x)).otherwise(n))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    ranked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(
        let(let(ranked, starts), covered))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds qr_n_words, qr_word_chars, qr_n_symbols, qr_n_lines, qr_n_dup_lines, qr_n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    grams = lambda w: F.when(F.size(w) < N, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - N), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(N)])))
    by_words = let(words(F.col(text_col)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        grams(w).alias("grams")))
    by_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.select("*", by_words.alias("qr_w"), by_lines.alias("qr_l"),
                      F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("qr_n_symbols"))
    # as a generator of one row: a filter on the counts isn't pushed below it, where it would count again for each use
    return out.select(*docs.columns, F.inline(F.array(F.struct(
        F.col("qr_w.n_words").alias("qr_n_words"), F.col("qr_w.word_chars").alias("qr_word_chars"), "qr_n_symbols",
        F.col("qr_l.n_lines").alias("qr_n_lines"), F.col("qr_l.n_dup_lines").alias("qr_n_dup_lines"),
        covered_words(F.col("qr_w.grams")).alias("qr_n_repeat_words")))))


def _floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / F.greatest(b, F.lit(1).cast("long"))).cast("long")


def rates() -> dict[str, Column]:
    n = F.col("qr_n_words")
    return {"sym": _floor_div(F.col("qr_n_symbols") * 1000, n),
            "dup": _floor_div(F.col("qr_n_dup_lines") * 1000, F.col("qr_n_lines")),
            "rep": _floor_div(F.col("qr_n_repeat_words") * 1000, n),
            "len": _floor_div(F.col("qr_word_chars") * 100, n)}


def bucket(v: Column) -> Column:
    """Log-linear bucket of a count: exact below 64, then 32 buckets to each doubling."""
    e = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(F.lit(32).cast("long") * e + F.floor(v / F.pow(F.lit(2.0), e)).cast("long"))


def bucket_value(b: Column) -> Column:
    """The least count of a bucket."""
    e = F.floor(b / 32).cast("long") - 1
    return F.when(b < 64, b).otherwise(((b - e * 32) * F.pow(F.lit(2.0), e)).cast("long"))


def sketches(scored: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts per group, rate and bucket, for (lang, source), lang and the whole table (level 0, 1, 3).

    Partial counts are made before the shuffle; documents below MIN_WORDS have no rates.
    """
    long = scored.where(F.col("qr_n_words") >= MIN_WORDS).select(
        F.col(lang_col).alias("qr_lang"), F.col(source_col).alias("qr_source"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), bucket(v).alias("b")) for k, v in rates().items()])).alias("x"))
    base = written(long.groupBy("qr_lang", "qr_source", "x.rule", "x.b").agg(F.count("*").alias("n")), "quality-sketch")
    merged = base.groupBy("qr_lang", "rule", "b").agg(F.sum("n").alias("n"))
    whole = merged.groupBy("rule", "b").agg(F.sum("n").alias("n"))
    null = F.lit(None).cast("string")
    cols = ["level", "qr_lang", "qr_source", "rule", "b", "n"]
    return (base.withColumn("level", F.lit(0)).select(cols)
            .unionByName(merged.withColumn("level", F.lit(1)).withColumn("qr_source", null).select(cols))
            .unionByName(whole.withColumn("level", F.lit(3)).withColumn("qr_source", null).withColumn("qr_lang", null).select(cols)))


def fences(sketch: DataFrame) -> DataFrame:
    """Per group and level: n and the fences of every rule, from the sketches' quantiles."""
    group = ["level", "qr_lang", "qr_source", "rule"]
    upto = Window.partitionBy(*group).orderBy("b")
    all_ = Window.partitionBy(*group)
    c = sketch.select("*", F.sum("n").over(upto).alias("cum"), F.sum("n").over(all_).alias("total"))
    q = lambda pct: bucket_value(F.min(F.when(F.col("cum") * 100 >= F.col("total") * pct, F.col("b"))))
    per_rule = c.groupBy(*group).agg(F.max("total").alias("n"), q(10).alias("q10"), q(50).alias("q50"), q(90).alias("q90"))
    spread = F.create_map(*[F.lit(x) for k, (_, least) in RULES.items() for x in (k, least)])[F.col("rule")]
    per_rule = per_rule.select(
        *group, "n", (F.col("q50") + F.greatest((F.col("q90") - F.col("q50")) * FENCE, spread)).cast("long").alias("hi"),
        (F.col("q50") - F.greatest((F.col("q50") - F.col("q10")) * FENCE, spread)).cast("long").alias("lo"))
    return per_rule.groupBy("level", "qr_lang", "qr_source").agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("rule") == k, F.col("hi"))).alias(f"{k}_hi") for k in RULES],
        *[F.max(F.when(F.col("rule") == k, F.col("lo"))).alias(f"{k}_lo") for k, (two, _) in RULES.items() if two])


def thresholds(scored: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per (lang, source) with the fences of the narrowest group of MIN_GROUP documents."""
    f = written(fences(sketches(scored, lang_col, source_col)), "quality-fences")
    vals = [c for c in f.columns if c.endswith(("_hi", "_lo"))]
    pack = F.struct(*vals)
    own = f.where("level = 0").select("qr_lang", "qr_source", "n", pack.alias("own"))
    lang = f.where("level = 1").select(F.col("qr_lang").alias("l"), F.col("n").alias("n1"), pack.alias("wide"))
    whole = f.where("level = 3").select(pack.alias("whole"), F.lit(1).alias("one"))
    j = own.join(lang, F.col("qr_lang").eqNullSafe(F.col("l")), "left").withColumn("one", F.lit(1)).join(whole, "one", "left")
    pick = F.when(F.col("n") >= MIN_GROUP, F.col("own")).when(F.col("n1") >= MIN_GROUP, F.col("wide")).otherwise(F.col("whole"))
    return j.select("qr_lang", "qr_source", pick.alias("p")).select("qr_lang", "qr_source", "p.*")


def judge(scored: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source",
          spread: str = "doc_id") -> DataFrame:
    """Adds qr_base_failed and qr_kept; ``limits`` is a written table of thresholds."""
    n = F.col("qr_n_words")
    base = (n < MIN_WORDS) | (F.col("qr_n_repeat_words") * 100 > n * MAX_REPEAT_PCT)
    j = lookup(scored.withColumn("qr_lang", F.col(lang_col)).withColumn("qr_source", F.col(source_col)), limits,
               ["qr_lang", "qr_source"], F.col(spread))
    out = F.lit(False)
    for k, rate in rates().items():
        out = out | F.coalesce(rate > F.col(f"{k}_hi"), F.lit(False))
        if RULES[k][0]:
            out = out | F.coalesce(rate < F.col(f"{k}_lo"), F.lit(False))
    return j.withColumn("qr_base_failed", base).withColumn("qr_kept", ~base & ~out).drop(
        "qr_lang", "qr_source", *[c for c in limits.columns if c.endswith(("_hi", "_lo"))])


def limits_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Written thresholds of a table of documents."""
    narrow = features(docs.select(lang_col, source_col, text_col), text_col).drop(text_col)
    return written(thresholds(narrow, lang_col, source_col), "quality-limits")


def keep(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their own columns; counts are made in the row, texts are not shuffled."""
    judged = judge(features(docs), limits_of(docs))
    return judged.where("qr_kept").select(*docs.columns)
