"""Legal-entity lookup by contained or approximate name and leadership roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moatlens.functions import lexicons as L

_GRAM = 3
_SALTS = 8


def _grams(c, k):
    """Distinct substrings of length k (all of them when shorter texts)."""
    n = F.length(c)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))),
                                        lambda i: F.substring(c, i, k)))


def _fewer(c, edits: int):
    """All distinct strings that ``c`` becomes by taking out up to ``edits`` characters."""
    out = F.array(c)
    for _ in range(edits):
        less = F.flatten(F.transform(out, lambda x: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))))
        out = F.array_distinct(F.concat(out, less))
    return out


def nearest_names(queries: DataFrame, registry: DataFrame, q_col: str = "query", edits: int = 1) -> DataFrame:
    """(_q, lei, distance): per lower-cased query the name within ``edits`` edits, the least by (distance, lei).

    Two strings within k edits become equal by taking out at most k characters
    on each side, so both sides are joined on hashes of all such shorter
    strings and the edit distance is then computed exactly. No gram is common
    to many names here: only near names meet. Equal names and equal queries
    are one row first, and only names whose length some query is near are
    spelled out. A name of n characters has about n^k shorter ones, so ``edits``
    is meant to be 1 or 2. Null and empty queries and null names find nothing.
    """
    asked = queries.select(F.lower(F.col(q_col)).alias("_q")).where(F.length("_q") > 0).distinct()
    names = registry.select(F.lower("legal_name").alias("_name"), "lei").where(F.col("_name").isNotNull()).groupBy("_name").agg(F.min("lei").alias("lei"))
    sizes = asked.select(F.explode(F.sequence(F.length("_q") - edits, F.length("_q") + edits)).alias("_n")).distinct()
    near = names.join(sizes, F.length("_name") == F.col("_n"), "left_semi")
    keys = lambda c: F.explode(F.transform(_fewer(F.col(c), edits), lambda x: F.xxhash64(x))).alias("_key")
    met = asked.select("_q", keys("_q")).join(near.select("_name", "lei", keys("_name")), "_key")
    found = met.select("_q", "lei", F.levenshtein("_q", "_name").alias("distance")).where(F.col("distance") <= edits)
    best = found.groupBy("_q").agg(F.min(F.struct("distance", "lei")).alias("_b"))
    return best.select("_q", F.col("_b.lei").alias("lei"), F.col("_b.distance").alias("distance"))


def legal_entity_lookup(queries: DataFrame, registry: DataFrame, q_col: str = "query", edits: int = 0) -> DataFrame:
    """First registry record (by ``lei``) whose legal name contains the query, case-insensitive.

    With ``edits``, a query that no name contains takes the nearest name within
    so many edits (``nearest_names``), and ``distance`` says how many (0: contained).

    A containment join cannot be an equi-join, and neither side is assumed
    small. Both sides are blocked on character grams, and the containment is
    then checked exactly:

    - a query of up to ``_GRAM`` characters is itself a gram: its answer is the
      smallest ``lei`` of that gram, kept by the gram aggregate (no join of
      names);
    - a longer query joins the names that hold its rarest gram. Equal queries
      are asked once, and a gram shared by many queries is split over
      ``_SALTS`` tasks by name, so "inc" is no hot key;
    - an empty query matches every name: the first record.
    """
    reg = registry.select("lei", F.lower("legal_name").alias("_name"))
    asked = queries.select(F.lower(F.col(q_col)).alias("_q")).distinct()
    reg_grams = reg.select("lei", F.explode(F.flatten(F.array(*[_grams(F.col("_name"), k) for k in range(1, _GRAM + 1)]))).alias("gram"))
    freq = reg_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.min("lei").alias("first"))

    short = asked.filter((F.length("_q") > 0) & (F.length("_q") <= _GRAM)).join(freq, F.col("_q") == F.col("gram")) \
        .select("_q", F.col("first").alias("lei"))
    long = asked.filter(F.length("_q") > _GRAM).select("_q", F.explode(_grams(F.col("_q"), F.lit(_GRAM))).alias("gram"))
    best = long.join(freq, "gram", "left").groupBy("_q").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("b")).select("_q", "b.*").filter(F.col("df") > 0)
    best = best.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    names = reg.select("lei", "_name", F.pmod(F.hash("lei"), F.lit(_SALTS)).alias("_s"), F.explode(_grams(F.col("_name"), F.lit(_GRAM))).alias("gram"))
    hit = best.join(names, ["gram", "_s"]).filter(F.contains(F.col("_name"), F.col("_q")))
    found = hit.groupBy("_q").agg(F.min("lei").alias("lei"))

    empty = asked.filter(F.length("_q") == 0).select("_q", reg.agg(F.min("lei")).scalar().alias("lei"))
    matched = short.unionByName(found).unionByName(empty)
    if edits:
        near = nearest_names(asked, registry, "_q", edits).select("_q", F.col("lei").alias("_near"), "distance")
        matched = asked.join(matched, "_q", "left").join(near, "_q", "left").select(
            "_q", F.coalesce("lei", "_near").alias("lei"), F.when(F.col("lei").isNotNull(), 0).otherwise(F.col("distance")).alias("distance"))
    out = queries.select(q_col, F.lower(F.col(q_col)).alias("_q")).join(matched, "_q", "left").drop("_q")
    return out.join(registry, "lei", "left")


def identity_record(found: DataFrame, q_col: str = "query") -> DataFrame:
    """Corporate identity fields of a lookup; the address defaults to N/A."""
    addr = F.get("address_lines", F.lit(0)) if "address_lines" in found.columns else F.lit(None).cast("string")
    return found.select(
        q_col, F.col("legal_name").alias("official_legal_name"), F.col("lei").cast("string").alias("lei_code"),
        "jurisdiction", F.col("status").alias("entity_status"),
        F.when(F.col("lei").isNotNull(), F.coalesce(addr, F.lit(L.LEGAL_ADDRESS_DEFAULT))).alias("legal_address"),
        F.col("city"))


def leadership_rollup(bindings: DataFrame, key: str = "company") -> DataFrame:
    """First CEO, distinct founders (else "Not Found"), ticker of the first binding (else "-1").

    ``bindings(key, ord, ceo, founder, ticker)`` holds the rows of one
    knowledge-graph answer per company; founders are de-duplicated with a
    distinct aggregate before the per-company list is built.
    """
    founders = bindings.filter(F.col("founder").isNotNull()).select(key, "founder").distinct() \
        .groupBy(key).agg(F.array_sort(F.collect_list("founder")).alias("founders"))
    first = bindings.groupBy(key).agg(F.min_by(F.struct("ceo", "ticker"), F.col("ord")).alias("_f"))
    out = first.join(founders, key, "left")
    return out.select(
        key, F.col("_f.ceo").alias("ceo"),
        F.when(F.size(F.coalesce("founders", F.array())) > 0, F.array_join("founders", "|"))
         .otherwise(F.lit(L.NOT_FOUND)).alias("founders"),
        F.coalesce(F.col("_f.ticker"), F.lit(L.NO_TICKER)).alias("ticker"))
