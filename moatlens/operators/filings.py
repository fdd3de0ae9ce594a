"""Regulatory filings: newest-n selection, sections, events, insiders, pay, ESG text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moatlens.functions import lexicons as L
from moatlens.functions import text as T
from moatlens.operators.statements import clean_num


def filings_head(filings: DataFrame, n_by_form: dict | None = None, no_amendments=("10-K",),
                 key: str = "ticker") -> DataFrame:
    """Newest n filings per (ticker, form), all of a form whose n is None; amended filings dropped for ``no_amendments`` forms.

    The rank filter uses one literal bound (the largest n) so Spark plans a
    per-partition top-k before the shuffle; the per-form n is applied after.
    """
    n_by_form = n_by_form or L.FILING_HEAD_N
    f = filings.filter(F.col("form").isin(list(n_by_form)))
    if no_amendments and "amended" in f.columns:
        f = f.filter(~(F.col("form").isin(list(no_amendments)) & F.coalesce(F.col("amended"), F.lit(False))))
    w = Window.partitionBy(key, "form").orderBy(F.col("filed_date").desc(), F.col("filing_id").desc())
    ranked = f.withColumn("filing_rank", F.row_number().over(w))
    if None not in n_by_form.values():
        ranked = ranked.filter(F.col("filing_rank") <= max(n_by_form.values()))
    limit = F.create_map(*[x for k, v in n_by_form.items() for x in (F.lit(k), F.lit(v).cast("int"))])[F.col("form")]
    return ranked.filter(limit.isNull() | (F.col("filing_rank") <= limit))


def newest_text(docs: DataFrame, key: str, order: str, text_col: str) -> DataFrame:
    """Newest document per key: the newest order per key is found without the texts, then joined back.

    Of several documents of the newest order the smallest text counts.
    """
    newest = docs.groupBy(key).agg(F.max(order).alias(order))
    rows = docs.join(newest, [key, order], "left_semi").select(key, order, text_col)
    return rows.groupBy(key, order).agg(F.min(text_col).alias(text_col))


def sections(docs: DataFrame, items: dict[str, int], key: str = "ticker", item_col: str = "item", text_col: str = "text",
             order: str = "doc_id") -> DataFrame:
    """Named items (with their order) of the newest filing that has them: (key, section_ord, item, text).

    For filings whose items are rows already; ``filing_items`` cuts whole texts.
    """
    ord_ = F.create_map(*[F.lit(x) for k, v in items.items() for x in (k, v)])[F.col(item_col)]
    named = docs.filter(F.col(item_col).isin(list(items)))
    newest = named.groupBy(key, item_col).agg(F.max(order).alias(order))
    rows = named.join(newest, [key, item_col, order], "left_semi").groupBy(key, item_col, order).agg(F.min(text_col).alias(text_col))
    return rows.select(key, ord_.alias("section_ord"), F.col(item_col).alias("item"), order, text_col)


#: A line that begins an item: its number with a letter maybe, and a full stop or colon.
ITEM_HEADING = r"[ \t]*item[ \t]+([0-9]{1,2}[a-c]?)[.:]"


def item_texts(body: Column, items) -> Column:
    """The text of every named item of a filing, heading included; null for an item it hasn't got.

    The body is cut where a line begins with an item's heading. A table of
    contents lists the headings too: of an item's pieces the longest counts,
    of equally long ones the first. One pass over the text.
    """
    pieces = F.split(body, rf"(?imd)(?=^{ITEM_HEADING})", -1)
    named = F.transform(pieces, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("at"), F.upper(
        F.regexp_extract(p, rf"(?id)\A{ITEM_HEADING}", 1)).alias("number"), p.alias("piece")))
    longest = lambda item: F.array_max(F.filter(named, lambda p: p["number"] == item.upper().removeprefix("ITEM ")))["piece"]
    return F.array(*[T.strip(longest(item)) for item in items])


def filing_items(filings: DataFrame, items: dict[str, int], key: str = "ticker", body_col: str = "body", order: str = "filing_id") -> DataFrame:
    """(key, section_ord, item, order, text): the named items of every company's newest filing, cut from its body.

    Only newest filings are cut. An item that the newest filing hasn't got has a null text.
    """
    newest = newest_text(filings, key, order, body_col)
    texts = newest.select(key, order, T.explode_kept(item_texts(F.col(body_col), list(items)), pos=True).alias("i", "text"))
    at = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("i"))
    return texts.select(key, at(items.values()).alias("section_ord"), at(items).alias("item"), order, "text")


def truncate_text(c: Column, limit: int = L.MAX_TEXT_CHARS) -> Column:
    return T.truncate(c, limit, L.TRUNCATION_SUFFIX)


def material_events(head_8k: DataFrame) -> DataFrame:
    """Description: items joined by '; ', else the header's items, else filing description, else the form; cut to 1000.

    ``header_items`` is optional, and like ``items`` a string or an array.
    """
    def said(name: str) -> Column:
        kind = dict(head_8k.dtypes).get(name, "void")
        return F.nullif(F.array_join(name, "; ") if kind.startswith("array") else F.col(name) if kind != "void" else F.lit(None).cast("string"), F.lit(""))
    desc = F.coalesce(said("items"), said("header_items"), said("description"), F.col("form"))
    return head_8k.select("ticker", "filing_id", "filed_date", F.col("form").alias("form_type"),
                          F.substring(desc, 1, L.MAX_EVENT_CHARS).alias("description"), desc.alias("full_description"))


def insider_transactions(head: DataFrame, txns: DataFrame) -> DataFrame:
    """Transaction rows of the newest ownership filings (forms 4, 3, 5).

    ``txns`` holds one row per reported transaction; when it has a ``kind``
    column, a filing's ``transactions`` rows win, else its non-derivative rows
    then its derivative rows are used.
    """
    own = head.filter(F.col("form").isin(L.INSIDER_FORMS))
    t = txns
    if "kind" in t.columns:
        # per-filing flag by a (map-side partial) aggregate + join, not a window:
        # a filing with a huge transaction list is split by AQE's skew join
        flag = t.groupBy("filing_id").agg(F.bool_or(F.col("kind") == "transactions").alias("_has_tx"))
        t = t.join(flag, "filing_id").filter((F.col("kind") == "transactions") | ~F.col("_has_tx")).drop("_has_tx")
    j = own.join(t, "filing_id")
    codes = F.create_map(*[x for k, v in L.INSIDER_CODES for x in (F.lit(k), F.lit(v))])
    code = F.col("code")
    first_truthy = lambda a, b: F.when(a.isNotNull() & (a != 0), a).otherwise(b)
    price = F.col("price_per_share") if "price_per_share" in t.columns else F.col("price")
    tprice = F.col("transaction_price_per_share") if "transaction_price_per_share" in t.columns else F.lit(None).cast("double")
    form_ord = F.array_position(T.lit_array(L.INSIDER_FORMS), F.col("form"))
    return j.select(
        "ticker", "form", form_ord.alias("form_ord"), "filing_id", "filed_date", "line_no",
        F.coalesce(F.col("insider_name"), F.lit(L.UNKNOWN_NAME)).alias("insider_name"),
        (F.col("officer_title") if "officer_title" in t.columns else F.lit(None).cast("string")).alias("title"),
        F.when(code.isNull(), F.lit(L.UNKNOWN_NAME)).otherwise(F.coalesce(codes[code], code)).alias("transaction_type"),
        clean_num(first_truthy(F.col("transaction_shares"), F.col("shares"))).alias("shares"),
        clean_num(first_truthy(tprice, price)).alias("price_per_share"),
    )


def insider_summary(tx: DataFrame) -> DataFrame:
    """Per insider: net shares (bought minus sold), and shares and traded value pivoted by kind of transaction.

    Sums are decimals, so they don't depend on the order of tasks.
    """
    codes = dict(L.INSIDER_CODES)
    buy, sell = F.col("transaction_type") == codes["P"], F.col("transaction_type") == codes["S"]
    shares = F.col("shares").cast("decimal(30,6)")
    value = (shares * F.col("price_per_share").cast("decimal(20,6)")).cast("decimal(38,6)")
    total = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0)).cast("double")
    return tx.groupBy("ticker", "insider_name").agg(
        F.count(F.lit(1)).alias("n_transactions"),
        total(buy, shares).alias("bought_shares"), total(sell, shares).alias("sold_shares"),
        total(~buy & ~sell, shares).alias("other_shares"),
        (total(buy, shares) - total(sell, shares)).alias("net_shares"),
        total(buy, value).alias("bought_value"), total(sell, value).alias("sold_value"))


def executive_pay(head_proxy: DataFrame, comp_rows: DataFrame) -> DataFrame:
    """Rows of the first available compensation table of each of the newest proxies."""
    prio = F.array_position(T.lit_array(L.COMP_TABLES), F.col("source_table"))
    rows = comp_rows.withColumn("_prio", prio).filter(F.col("_prio") > 0)
    best = rows.groupBy("filing_id").agg(F.min("_prio").alias("_prio"))  # partial aggregate, skew-safe
    rows = rows.join(best, ["filing_id", "_prio"], "left_semi")
    j = head_proxy.filter(F.col("form") == "DEF 14A").join(rows, "filing_id")
    return j.select("ticker", "filing_id", "row_no",
                    F.substring(F.col("filed_date").cast("string"), 1, 4).alias("year"),
                    F.coalesce(F.col("name"), F.lit(L.UNKNOWN_NAME)).alias("name"),
                    F.col("title"), clean_num(F.col("total")).alias("total_compensation_usd"))


def esg_paragraphs(tenk_sections: DataFrame, proxy: DataFrame | None = None, key: str = "ticker") -> DataFrame:
    """ESG paragraphs: sections (in order) of the newest 10-K, then of the newest proxy.

    ``tenk_sections(key, section_ord, text)``; ``proxy(key, text)``. A paragraph
    is one line holding any term; paragraphs are stripped, joined by newline,
    null when none, cut to 5000 chars. A section without a text counts as empty.
    """
    def paras(text, terms):
        return F.transform(F.filter(T.lines(text), lambda p: T.any_sub(F.lower(p), T.lit_array(terms))), T.strip)

    own = paras(F.coalesce("text", F.lit("")), L.ESG_TERMS_10K)
    k = tenk_sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section_ord", own.alias("p")))).alias("_s"))
    k = k.select(key, F.flatten(F.transform("_s", lambda s: s["p"])).alias("parts"))
    if proxy is not None:
        p = proxy.select(key, paras(F.col("text"), L.ESG_TERMS_PROXY).alias("pp"))
        k = k.join(p, key, "full").select(
            key, F.concat(F.coalesce("parts", F.array().cast("array<string>")),
                          F.coalesce("pp", F.array().cast("array<string>"))).alias("parts"))
    return k.select(key, F.size("parts").cast("bigint").alias("n_paragraphs"),
                    F.when(F.size("parts") > 0, truncate_text(F.array_join("parts", "\n"))).alias("esg_text"),
                    F.when(F.size("parts") > 0, F.array_join("parts", "\n")).alias("esg_full_text"))
