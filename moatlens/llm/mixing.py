"""Mixing sources to target weights.

Tokens are summed per source, repetition rates follow from target shares, and
each document is emitted ``floor(rate)`` times plus one hash-seeded Bernoulli
copy with probability ``rate - floor(rate)``.

Defined cases: a null text or one without words has size 0 (it is still
emitted by its source's rate); a null source is a source of its own, last in
order; repeated rows are decided alike, by the hash of their id (of their text
where the id is null); an empty table gives an empty result; extra columns pass
through ``mix`` and never take part, its own columns are prefixed ``mix_``
(others of that prefix give way to them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moatlens.llm.common import lookup, n_words, written

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target words per source from (mix_source, mix_source_size).

    Sources in code point order (null last) take ``weights`` in turn and share
    the total; a target stops at ``cap`` times its source and the excess is
    shared again by weight. Closed form: in ascending order of cap / weight a
    source is capped while its cap is at most its share of what is left.
    The input has one row per source, so the ordered windows see few rows.
    """
    order = Window.orderBy(F.col("mix_source").isNull(), "mix_source")
    dec = "decimal(38,0)"
    w = sizes.withColumn("rn", F.row_number().over(order)).withColumn(
        "w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rn") - 1) % len(weights) + 1).cast(dec))
    w = w.withColumn("cap", F.col("mix_source_size").cast(dec) * cap)
    by_ratio = Window.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), "rn")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.select("*",
                 F.sum("mix_source_size").over(everything).cast(dec).alias("total"),
                 F.sum("w").over(everything).cast(dec).alias("all_w"),
                 F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(dec).alias("cap_before"),
                 F.coalesce(F.sum("w").over(before), F.lit(0)).cast(dec).alias("w_before"))
    capped = (F.col("cap") * (F.col("all_w") - F.col("w_before"))
              <= (F.col("total") - F.col("cap_before")) * F.col("w"))
    w = w.withColumn("capped", capped)
    w = w.select("*",
                 F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)).cast("double").alias("cap_sum"),
                 F.coalesce(F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything), F.lit(0)).cast("double").alias("free_w"))
    share = (F.col("total").cast("double") - F.col("cap_sum")) / F.nullif(F.col("free_w"), F.lit(0.0)) * F.col("w").cast("double")
    return w.select("mix_source", "mix_source_size",
                    F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("mix_target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Every document with mix_size, mix_source_size, mix_target, mix_rate and mix_copies."""
    sized = docs.withColumn("mix_size", n_words(F.col(text_col)))
    per_source = sized.groupBy(F.col(source_col).alias("mix_source")).agg(
        F.sum("mix_size").alias("mix_source_size"))
    plan = written(targets(per_source, weights, cap), "mix-targets")
    seeded = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")))
    u = F.conv(F.substring(F.md5(seeded), 1, 13), 16, 10).cast("double") / float(1 << 52)
    out = lookup(sized.withColumn("mix_source", F.col(source_col)), plan, ["mix_source"], F.col(id_col))
    rate = F.coalesce(F.col("mix_target") / F.nullif(F.col("mix_source_size"), F.lit(0)), F.lit(0.0))
    out = out.withColumn("mix_rate", rate)
    copies = F.floor("mix_rate") + F.when(u < F.col("mix_rate") - F.floor("mix_rate"), 1).otherwise(0)
    return out.withColumn("mix_copies", copies.cast("long")).drop("mix_source")


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy."""
    own = [c for c in mixed.columns if c.startswith("mix_")]
    return mixed.where("mix_copies > 0").withColumn(
        "mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).drop(*own, "mix_copy")
