"""Industry peers and peer comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moatlens.functions import lexicons as L


def industry_peers(directory: DataFrame, n: int = L.MAX_COMPETITORS) -> DataFrame:
    """First ``n`` other companies of the same industry code, in directory order.

    ``directory(dir_ord, company_name, sic, ticker)``. Only the first n+1
    entries of each industry can be anybody's peer, so they are kept with a
    rank filter (per-partition top-k before the shuffle) and joined back on
    the industry code: O(companies x (n+1)) rows, never all pairs of a
    crowded industry.
    """
    eligible = directory.filter(F.col("ticker").isNotNull() & (F.col("ticker") != ""))
    w = Window.partitionBy("sic").orderBy("dir_ord")
    head = eligible.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n + 1).select(
        "sic", F.col("dir_ord").alias("peer_ord"), F.col("ticker").alias("peer_ticker"),
        F.col("company_name").alias("peer_name"))
    pairs = eligible.select("sic", "ticker").join(head, "sic").filter(
        F.upper(F.col("peer_ticker")) != F.upper(F.col("ticker")))
    w2 = Window.partitionBy("ticker").orderBy("peer_ord")
    return pairs.withColumn("peer_rank", F.row_number().over(w2)).filter(F.col("peer_rank") <= n).select(
        "ticker", "sic", "peer_rank", F.upper("peer_ticker").alias("peer_ticker"), "peer_name")


def peer_comparison(peers: DataFrame, margins: DataFrame) -> DataFrame:
    """Peers with their operating margin and R&D ratio (null when unknown)."""
    m = margins.select(F.upper("ticker").alias("peer_ticker"), "operating_margin", "rd_to_revenue_ratio")
    return peers.join(m, "peer_ticker", "left").select(
        "ticker", "peer_rank", "peer_ticker", F.col("peer_name").alias("company_name"),
        "operating_margin", "rd_to_revenue_ratio")
