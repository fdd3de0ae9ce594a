"""Page acceptance and line-level helpers shared by the extractors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moatlens.functions import lexicons as L
from moatlens.functions import text as T


def spread(df: DataFrame, partitions: int | None = None, key: str = "page_id") -> DataFrame:
    """Hash-partition pages by id into ``partitions``, if given.

    Text extraction is CPU-bound per page; pages landed as a few big
    unsplittable files run on a few tasks unless the caller spreads them, at
    the cost of shuffling the texts once.
    """
    return df if partitions is None else df.repartition(partitions, key)


def page_gate(df: DataFrame, text_col: str = "markdown", success_col: str | None = "success",
              error_col: str | None = "error_message", error_chars: int | None = L.PAGE_ERROR_CHARS) -> DataFrame:
    """A fetched page is accepted iff fetched, non-empty and >= 500 chars.

    Rejected pages get ``reject_reason`` = first line of the error, cut to
    ``error_chars`` characters (None: whole), or the default reason when there
    is no error text.
    """
    md = F.col(text_col)
    ok = md.isNotNull() & (F.length(md) >= L.MIN_PAGE_CHARS)
    if success_col and success_col in df.columns:
        ok = F.coalesce(F.col(success_col), F.lit(False)) & ok
    err = F.col(error_col) if error_col and error_col in df.columns else F.lit(None).cast("string")
    reason = T.first(F.split(F.coalesce(err, F.lit(L.PAGE_ERROR_DEFAULT)), "\n", -1))
    reason = reason if error_chars is None else F.substring(reason, 1, error_chars)
    return df.select("*", ok.alias("accepted"), F.when(~ok, reason).alias("reject_reason"))


def clean_heading(line: Column) -> Column:
    return F.regexp_replace(T.strip(line), T.rx(L.HEADING_PREFIX_PATTERN), "")


def headings(md: Column, pattern: str, lines: Column | None = None) -> Column:
    """Cleaned text of the lines matching a heading pattern (unstripped line).

    ``lines`` may carry the page's already split lines.
    """
    ls = T.lines(md) if lines is None else lines
    return F.transform(F.filter(ls, lambda l: l.rlike(T.rx(pattern))), clean_heading)


def review_lines(md: Column) -> Column:
    """Stripped lines longer than 25 chars without link/navigation syntax."""
    return F.transform(
        F.filter(T.lines(md), lambda l: (F.length(T.strip(l)) > L.REVIEW_LINE_MIN_CHARS)
                 & ~l.rlike(T.rx(L.NAV_PATTERN))),
        T.strip)
