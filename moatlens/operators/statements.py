"""Financial statement lines: unpivot, label lookup, DuPont and margin ratios.

Input is a long table ``statement_lines(ticker, statement, line_no, label,
period, value)``. Every metric of a (ticker, period) comes out of one
aggregate (one shuffle on ticker, map-side partial aggregation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moatlens.functions import lexicons as L
from moatlens.functions import text as T

# metric -> (statement, label pattern)
METRICS = {
    "revenue": ("income", L.LABEL_REVENUE),
    "net_income": ("income", L.LABEL_NET_INCOME),
    "total_assets": ("balance", L.LABEL_TOTAL_ASSETS),
    "total_equity": ("balance", L.LABEL_EQUITY),
    "operating_income": ("income", L.LABEL_OPERATING_INCOME),
    "rnd": ("income", L.LABEL_RND),
    "intangible": ("balance", L.LABEL_INTANGIBLE),
    "ppe": ("balance", L.LABEL_PPE),
    "capex": ("cashflow", L.LABEL_CAPEX),
    "free_cash_flow": ("cashflow", L.LABEL_FREE_CASH_FLOW),
}


def is_period_column(name: str) -> bool:
    """A column that looks like a fiscal period date (YYYY-MM-DD)."""
    return len(name) == 10 and name[4] == "-" and name[7] == "-"


def unpivot_statement(wide: DataFrame, ids=("ticker", "statement", "line_no", "label")) -> DataFrame:
    """Wide statement (one column per period) to long rows; other columns ignored."""
    periods = [c for c in wide.columns if is_period_column(c)]
    return wide.unpivot(list(ids), periods, "period", "value")


def unpivot_cells(lines: DataFrame, ids=("ticker", "statement", "line_no", "label"), cells: str = "cells") -> DataFrame:
    """Ragged statements to long rows: every line brings its own period columns, as a map from column name to value.

    Statements with different periods lie in one table, and no column name is
    known beforehand. Keys that don't look like a period are ignored; a period
    without a value keeps its null. Lines without any period give no rows.
    """
    period = F.col("period")
    dated = (F.length(period) == 10) & (F.substring(period, 5, 1) == "-") & (F.substring(period, 8, 1) == "-")
    return lines.select(*ids, F.explode(cells).alias("period", "value")).filter(dated)


def clean_num(c: Column) -> Column:
    """NaN / +-inf / unparsable become null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def safe_div(n: Column, d: Column, digits: int = L.RATIO_DIGITS) -> Column:
    return F.when(n.isNotNull() & d.isNotNull() & (d != 0), F.round(n / d, digits))


def _match(metric: str) -> Column:
    stmt, pat = METRICS[metric]
    return F.col("label").rlike(T.rx(pat, ignore_case=True)) & (F.col("statement") == stmt)


def label_lookup(lines: DataFrame, metrics, keys=("ticker", "period")) -> DataFrame:
    """Per key, the value of the first line (statement order) whose label matches.

    A null value on that first line stays null (no fall-through); ``has_<m>``
    tells whether any line matched at all; ``in_statements`` whether the key
    has income or balance lines. One aggregate, partial on the map side.
    """
    aggs = []
    for m in metrics:
        order = F.when(_match(m), F.col("line_no"))
        aggs.append(F.min_by(clean_num(F.col("value")), order).alias(m))
        aggs.append(F.min(order).isNotNull().alias(f"has_{m}"))
    aggs.append(F.bool_or(F.col("statement").isin("income", "balance")).alias("in_statements"))
    return lines.groupBy(*keys).agg(*aggs)


def _newest_periods(per_period: DataFrame, n: int, key: str = "ticker") -> DataFrame:
    """Keep the newest ``n`` periods of each ticker of an already aggregated (small) table."""
    w = Window.partitionBy(key).orderBy(F.col("period").desc())
    return per_period.withColumn("period_rank", F.row_number().over(w)).filter(F.col("period_rank") <= n)


def period_select(lines: DataFrame, n: int = L.MAX_PERIODS, key: str = "ticker") -> DataFrame:
    """Newest ``n`` distinct periods of the income and balance statements."""
    p = lines.filter(F.col("statement").isin("income", "balance")).select(key, "period").distinct()
    return _newest_periods(p, n, key)


def dupont(lines: DataFrame, n_periods: int = L.MAX_PERIODS) -> DataFrame:
    """DuPont ratios per selected period; ROE = product of the rounded ratios.

    Metrics are aggregated for every (ticker, period) first; the newest-period
    choice then runs on that small result instead of re-joining the lines.
    """
    vals = _newest_periods(
        label_lookup(lines, ["revenue", "net_income", "total_assets", "total_equity"]).filter("in_statements"), n_periods)
    pm = safe_div(F.col("net_income"), F.col("revenue"))
    at = safe_div(F.col("revenue"), F.col("total_assets"))
    fl = safe_div(F.col("total_assets"), F.col("total_equity"))
    out = vals.select("ticker", "period", "revenue", "net_income", "total_assets", "total_equity",
                      pm.alias("profit_margin"), at.alias("asset_turnover"), fl.alias("financial_leverage"))
    nz = lambda c: F.col(c).isNotNull() & (F.col(c) != 0)
    roe = F.when(nz("profit_margin") & nz("asset_turnover") & nz("financial_leverage"),
                 F.round(F.col("profit_margin") * F.col("asset_turnover") * F.col("financial_leverage"), L.RATIO_DIGITS))
    return out.withColumn("roe", roe)


def latest_financials(lines: DataFrame, companies: DataFrame) -> DataFrame:
    """Headline ``name (CIK id)`` plus revenue and assets of the newest period."""
    d = dupont(lines)
    agg = d.groupBy("ticker").agg(
        F.max_by(F.struct("period", "revenue", "total_assets"), F.col("period")).alias("l"),
        F.count(F.lit(1)).alias("n_periods"))
    out = companies.join(agg, "ticker", "left")
    has = F.coalesce(F.col("n_periods"), F.lit(0)) > 0
    return out.select(
        "ticker", F.format_string("%s (CIK %s)", F.col("name"), F.col("cik")).alias("headline"),
        F.col("l.period").alias("period"), F.col("l.revenue").alias("revenue_usd"),
        F.col("l.total_assets").alias("total_assets_usd"),
        F.coalesce(F.col("n_periods"), F.lit(0)).cast("bigint").alias("n_periods"),
        F.when(has, "success").otherwise("error").alias("status"),
        F.when(~has, F.lit("financials_present_but_no_period_data_extracted")).alias("error_message"))


def asset_intensity(lines: DataFrame) -> DataFrame:
    """PP&E/assets, operating margin and R&D/revenue, 4 digits, null unless both sides non-zero."""
    v = label_lookup(lines, ["ppe", "total_assets", "operating_income", "revenue", "rnd"])

    def r(a, b):
        return F.when(F.col(a).isNotNull() & (F.col(a) != 0) & F.col(b).isNotNull() & (F.col(b) != 0),
                      F.round(F.col(a) / F.col(b), L.INTENSITY_DIGITS))
    return v.select("ticker", "period", F.col("total_assets").alias("total_assets_usd"),
                    r("ppe", "total_assets").alias("fixed_asset_intensity"),
                    r("operating_income", "revenue").alias("operating_margin"),
                    r("rnd", "revenue").alias("rd_to_revenue_ratio"))


def newest_lookup(lines: DataFrame, statement: str, metrics) -> DataFrame:
    """``label_lookup`` of each ticker's newest period of one statement (chosen on the aggregated rows).

    Statements may end on different dates; another statement's newer date
    doesn't count.
    """
    return _newest_periods(label_lookup(lines.filter(F.col("statement") == statement), metrics), 1)


def newest_metrics(lines: DataFrame) -> DataFrame:
    """Per ticker the newest income, balance and cash-flow metrics as structs, and the number of periods.

    One aggregate over the lines for all metrics, then one over its few rows.
    """
    v = label_lookup(lines, list(METRICS), keys=("ticker", "statement", "period"))
    own = {"income": ["revenue", "net_income", "operating_income", "has_operating_income", "rnd"],
           "balance": ["total_assets", "total_equity", "intangible", "ppe"], "cashflow": ["capex", "free_cash_flow"]}
    return v.groupBy("ticker").agg(
        *[F.max_by(F.struct("period", *cols), F.when(F.col("statement") == st, F.col("period"))).alias(st) for st, cols in own.items()],
        F.count_distinct(F.when(F.col("statement").isin("income", "balance"), F.col("period"))).alias("n_periods"))


def margins_of(income: str = "income") -> tuple[Column, Column]:
    """Operating margin and R&D share of an income struct of ``newest_metrics``."""
    c = lambda n: F.col(f"{income}.{n}")
    op = F.when(c("has_operating_income"), c("operating_income")).otherwise(c("net_income"))
    return safe_div(op, c("revenue")), safe_div(c("rnd"), c("revenue"))


def company_margins(lines: DataFrame) -> DataFrame:
    """Operating margin and R&D/revenue of the newest income period.

    Operating income is the "Operating Income" line when one exists (even if
    its value is null), else net income; ``is_fallback`` marks the latter.
    """
    v = newest_lookup(lines, "income", ["revenue", "net_income", "operating_income", "rnd"])
    op = F.when(F.col("has_operating_income"), F.col("operating_income")).otherwise(F.col("net_income"))
    return v.select("ticker", "period",
                    safe_div(op, F.col("revenue")).alias("operating_margin"),
                    safe_div(F.col("rnd"), F.col("revenue")).alias("rd_to_revenue_ratio"),
                    (~F.col("has_operating_income")).alias("is_fallback"))


def balance_items(lines: DataFrame) -> DataFrame:
    v = newest_lookup(lines, "balance", ["intangible", "ppe"])
    return v.select("ticker", "period", F.col("intangible").alias("intangible_assets_usd"), F.col("ppe").alias("ppe_usd"))


def capital_needs(lines: DataFrame) -> DataFrame:
    v = newest_lookup(lines, "cashflow", ["capex", "free_cash_flow"])
    return v.select("ticker", "period", F.col("capex").alias("capex_usd"), F.col("free_cash_flow").alias("free_cash_flow_usd"))


def segment_revenue(lines: DataFrame) -> DataFrame:
    """Revenue lines of the newest income period split into geographic and product segments.

    The newest period comes from a per-ticker max (partial aggregate); only the
    few revenue lines are joined to it.
    """
    income = lines.filter(F.col("statement") == "income")
    newest = income.groupBy("ticker").agg(F.max("period").alias("period"))
    rows = income.filter(F.col("label").rlike(T.rx(L.LABEL_SEGMENT_REVENUE, True)))
    rows = rows.join(newest, ["ticker", "period"], "left_semi")
    rows = rows.select("ticker", "period", "line_no", T.strip(F.col("label")).alias("segment"),
                       clean_num(F.col("value")).alias("revenue_usd")).filter(F.col("revenue_usd").isNotNull())
    low = F.lower(F.col("segment"))
    kind = (F.when(T.any_sub(low, T.lit_array(L.GEO_SEGMENT_WORDS)), "geographic")
            .when(T.any_sub(low, T.lit_array(L.PRODUCT_SEGMENT_WORDS)), "product"))
    return rows.withColumn("kind", kind).filter(F.col("kind").isNotNull())
