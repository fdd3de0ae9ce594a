"""Patent counts and technology density by classification prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moatlens.functions import lexicons as L


def patent_counts(patents: DataFrame, key: str = "company", shown: int = L.PATENT_CAP) -> DataFrame:
    """Granted and pending counts per company, and both as a report that shows at most ``shown``."""
    granted, pending = F.count_if(F.col("status") == "granted"), F.count_if(F.col("status") == "pending")
    return patents.groupBy(key).agg(granted.cast("bigint").alias("active_patent_count"), pending.cast("bigint").alias("pending_applications")) \
        .select("*", F.least("active_patent_count", F.lit(shown)).cast("bigint").alias("shown_active"),
                F.least("pending_applications", F.lit(shown)).cast("bigint").alias("shown_pending"))


def cpc_density(granted: DataFrame, key: str = "company", order=("patent_ord",), first_grants: int | None = None,
                top: int = L.CPC_TOP_N, prefix_chars: int = L.CPC_PREFIX_CHARS) -> DataFrame:
    """The ``top`` most common classification prefixes of a company's grants; ties by first appearance.

    ``granted(key, *order, codes ARRAY<STRING>)``. All grants count unless
    ``first_grants`` limits them (a rank filter, top-k before the shuffle).
    Prefixes are counted by a partial aggregate, so a company with very many
    grants is no hot group.
    """
    if first_grants is not None:
        w = Window.partitionBy(key).orderBy(*order)
        granted = granted.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= first_grants)
    codes = granted.select(key, *order, F.posexplode("codes").alias("_ci", "code")).filter(
        F.col("code").isNotNull() & (F.col("code") != ""))
    per = codes.groupBy(key, F.substring("code", 1, prefix_chars).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*order, "_ci")).alias("_first"))
    w2 = Window.partitionBy(key).orderBy(F.col("n").desc(), F.col("_first"))
    return per.withColumn("density_rank", F.row_number().over(w2)).filter(F.col("density_rank") <= top) \
        .select(key, "density_rank", "prefix", F.col("n").cast("bigint").alias("n_patents"))
