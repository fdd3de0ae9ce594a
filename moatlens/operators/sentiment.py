"""Polarity of texts and news-window sentiment per company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moatlens.functions import lexicons as L
from moatlens.functions import text as T
from moatlens.functions import valence as valence_data


def _edge_class() -> str:
    return "[" + "".join("\\" + c for c in valence_data.TOKEN_EDGE_PUNCT) + "]"


def words(text: Column) -> Column:
    """White-space tokens with edge punctuation removed, letters as they are."""
    e = _edge_class()
    return F.filter(F.transform(F.split(text, r"\s+", -1), lambda t: F.regexp_replace(t, f"^{e}+|{e}+$", "")), lambda t: t != "")


def _looked_up(word: Column, table) -> Column:
    """A word's value, or null; the set test spares all other words the walk through the map."""
    values = F.create_map(*[x for w, v in table for x in (F.lit(w), F.lit(float(v)))])
    return F.when(word.isin([w for w, _ in table]), F.try_element_at(values, word))


def _facts(word: Column, valence) -> Column:
    V = valence_data
    low = F.lower(word)
    bend = [(w, V.BOOST) for w in V.BOOSTERS] + [(w, -V.BOOST) for w in V.DAMPENERS]
    return F.struct(_looked_up(low, valence).alias("val"), F.coalesce(_looked_up(low, bend), F.lit(0.0)).alias("boost"),
                    (low.isin(V.NEGATIONS) | low.endswith("n't")).alias("neg"), word.rlike("^[A-Z]{2,}$").alias("up"), (low == "but").alias("but"))


def _said(tk: Column, t: Column, i: Column, louder: Column) -> Column:
    """What a word adds: its value bent by capitals and by the three words before it."""
    V = valence_data
    shout = lambda x: F.when(louder & x["up"], F.lit(V.CAPS)).otherwise(0.0)

    def bent_by(d: int) -> Column:
        x = F.get(tk, i - d)
        plain = x["val"].isNull()
        return F.struct(F.when(plain & x["neg"], F.lit(V.NEGATE)).otherwise(1.0).alias("n"),
                        F.when(plain & (x["boost"] != 0), (x["boost"] + shout(x)) * V.DISTANCE[d - 1]).otherwise(0.0).alias("b"))

    start = t["val"] + F.signum(t["val"]) * shout(t)
    return F.aggregate(F.array(*[bent_by(d) for d in (1, 2, 3)]), start, lambda v, x: x["n"] * (v + F.signum(v) * x["b"]))


def compound(text: Column, valence=valence_data.VALENCE, alpha: int = L.VADER_ALPHA) -> Column:
    """Sum s of what the words say, normalised to (-1, 1) by s / sqrt(s^2 + alpha).

    Rules: boosters and dampeners among the three words before a word of the
    table bend its value, less with distance; a negation there turns it; a word
    in capitals (two letters A-Z or more) counts more if not all words are; of
    a text with "but" the words before it count half, those after it one and a
    half times; exclamation marks (up to four) and repeated question marks add
    to the sum's size. A null text is empty, and an empty one says 0.

    One map-side pass: every word looks at its neighbours by index (no explode
    and no join of tokens).
    """
    V = valence_data
    text = F.coalesce(text, F.lit(""))

    def total(tk: Column) -> Column:
        louder = F.exists(tk, lambda t: t["up"]) & F.exists(tk, lambda t: ~t["up"])
        but = F.array_position(F.transform(tk, lambda t: t["but"]), True)

        def summed(facts: Column) -> Column:
            weight = lambda i: F.when((facts["but"] == 0) | (i + 1 == facts["but"]), 1.0).when(i + 1 < facts["but"], V.BEFORE_BUT).otherwise(V.AFTER_BUT)
            said = F.transform(tk, lambda t, i: F.when(t["val"].isNotNull(), _said(tk, t, i, facts["louder"]) * weight(i)).otherwise(0.0))
            return F.aggregate(said, F.lit(0.0), lambda a, x: a + x)

        return T.let(F.struct(louder.alias("louder"), but.alias("but")), summed)

    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    loud = F.least(count("!"), F.lit(V.EXCLAMATIONS)) * V.EXCLAMATION + F.when(count("?") > V.QUESTIONS, V.MANY_QUESTIONS).when(
        count("?") > 1, count("?") * V.QUESTION).otherwise(0.0)
    s = T.let(F.transform(words(text), lambda w: _facts(w, valence)), total)
    s = T.let(s, lambda x: x + F.signum(x) * loud)
    return T.let(s, lambda x: x / F.sqrt(x * x + F.lit(float(alpha))))


def polarity_mean(texts: DataFrame, key: str, text_col: str = "text", counted: bool = False) -> DataFrame:
    """Mean compound polarity per key (round 6) and sample size; ``counted`` adds how many texts say anything."""
    scored = texts.select(key, compound(F.col(text_col)).alias("c"))
    more = [F.count_if(F.col("c") != 0).alias("lines_with_polarity")] if counted else []
    return scored.groupBy(key).agg(F.round(F.avg("c"), 6).alias("compound_score"), F.count(F.lit(1)).alias("sample_size"), *more)


def news_window_sentiment(news: DataFrame, key: str, ts: str, score: Column, title: Column,
                          as_of: Column | None = None, lookback_days: int = L.NEWS_LOOKBACK_DAYS,
                          newest: int = L.NEWS_MAX_ARTICLES) -> DataFrame:
    """Mean sentiment of all articles of the last N days before ``as_of``, and of the ``newest`` of them.

    ``as_of`` defaults to the newest timestamp in the table (scalar subquery).
    The full mean is a partial aggregate; the newest articles come from a
    per-partition top-k before the shuffle, so a company with a flood of
    articles is no hot group. Sample headlines carry their scores.
    """
    if as_of is None:
        as_of = news.agg(F.max(ts)).scalar()
    win = news.filter((F.col(ts) <= as_of) & (F.col(ts) > as_of - F.make_interval(days=F.lit(lookback_days))))
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col("_id").desc())
    ranked = win.select(key, F.col(ts), score.alias("_score"), title.alias("_title"), F.col("_id")) \
        .withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= newest)
    whole = win.select(key, score.alias("_score")).groupBy(key).agg(
        F.count(F.lit(1)).alias("articles_analyzed"), F.round(F.avg("_score"), 4).alias("average_sentiment_compound"))
    agg = ranked.groupBy(key).agg(
        F.count(F.lit(1)).alias("newest_articles"),
        F.round(F.avg("_score"), 4).alias("newest_sentiment_compound"),
        F.array_sort(F.collect_list(F.struct("_rk", "_title", "_score"))).alias("_s"))  # at most ``newest`` rows
    return whole.join(agg, key).select(
        key, "articles_analyzed", "average_sentiment_compound", "newest_articles", "newest_sentiment_compound",
        (F.col("average_sentiment_compound") < L.NEGATIVE_SPIKE_BELOW).alias("negative_spike_detected"),
        (F.col("average_sentiment_compound") < L.NEGATIVE_SPIKE_BELOW).alias("law11_moat_flag"),
        F.transform(F.slice("_s", 1, L.NEWS_SAMPLE_HEADLINES),
                    lambda s: F.struct(s["_title"].alias("title"), s["_score"].alias("score"))).alias("sample_headlines"))
