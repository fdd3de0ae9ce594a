"""Column recipes shared by the extractors.

All recipes are built-in Spark SQL expressions (higher-order array functions
over literal lexicons), so one pass over a page computes everything and no
Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regex flags giving Python ``re`` semantics on str patterns:
# U = unicode classes (\s, \w, \b, \d), d = only \n ends a line, i/u = unicode
# case folding.
_FLAGS = "(?Ud)"
_FLAGS_CI = "(?iuUd)"


def rx(pattern: str, ignore_case: bool = False) -> str:
    """Spark (Java) pattern with Python-like semantics."""
    return (_FLAGS_CI if ignore_case else _FLAGS) + pattern


def lit_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lexicon(classes: Sequence[tuple[str, Sequence[str]]], lower: bool = False) -> Column:
    """Ordered lexicon as ARRAY<STRUCT<name STRING, ord INT, kws ARRAY<STRING>>>."""
    return F.array(*[
        F.struct(
            F.lit(name).alias("name"),
            F.lit(i).alias("ord"),
            lit_array([k.lower() if lower else k for k in kws]).alias("kws"),
        )
        for i, (name, kws) in enumerate(classes)
    ])


#: The characters Python's ``str.strip`` removes.
WHITE_SPACE = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(c: Column) -> Column:
    """Python ``str.strip()``; linear, also with long white space inside."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``, also within conditions and lambdas."""
    return F.transform(F.array(value), body)[0]


def lines(c: Column) -> Column:
    """``text.split('\\n')``; trailing empty pieces kept."""
    return F.split(c, "\n", -1)


def count_sub(text: Column, kw: Column, text_len: Column | None = None) -> Column:
    """Non-overlapping occurrences of literal ``kw`` in ``text`` (``str.count``).

    ``text_len`` may carry a precomputed ``length(text)`` column so that many
    keywords do not each recount the text.
    """
    n = F.length(text) if text_len is None else text_len
    # most keywords are absent from a page: a plain search first avoids
    # building the replaced copy of the text for them
    return F.when(F.contains(text, kw),
                  F.floor((n - F.length(F.replace(text, kw, F.lit("")))) / F.length(kw)).cast("bigint")
                  ).otherwise(F.lit(0).cast("bigint"))


def sum_counts(text: Column, kws: Column, text_len: Column | None = None) -> Column:
    """Sum of ``count_sub`` over an array of keywords."""
    return F.aggregate(kws, F.lit(0).cast("bigint"), lambda acc, k: acc + count_sub(text, k, text_len))


def any_sub(text: Column, kws: Column) -> Column:
    """Any keyword is a substring (no word boundaries)."""
    return F.exists(kws, lambda k: F.contains(text, k))


def classes_present(text: Column, lex: Column) -> Column:
    """Names of the classes with any keyword present, lexicon order."""
    return F.transform(F.filter(lex, lambda c: any_sub(text, c["kws"])), lambda c: c["name"])


def ranked(scored: Column, keep=None, top: int | None = None) -> Column:
    """Stable descending rank of ARRAY<STRUCT<name, ord, score>>.

    Returns ARRAY<STRUCT<neg, ord, name, score>> sorted by (score desc, ord asc),
    optionally filtered by ``keep(score)`` and cut to ``top``.
    """
    arr = F.transform(scored, lambda s: F.struct(
        (-s["score"]).alias("neg"), s["ord"].alias("ord"), s["name"].alias("name"),
        s["score"].alias("score")))
    if keep is not None:
        arr = F.filter(arr, lambda s: keep(s["score"]))
    arr = F.array_sort(arr)
    if top is not None:
        arr = F.slice(arr, 1, top)
    return arr


def names(arr: Column) -> Column:
    return F.transform(arr, lambda s: s["name"])


def name_scores(arr: Column, sep: str = "|") -> Column:
    """Render ranked (name, score) pairs as ``name:score|...``."""
    return F.array_join(
        F.transform(arr, lambda s: F.concat(s["name"], F.lit(":"), s["score"].cast("string"))), sep)


def findall(text: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    """``re.findall``: group 0 for group-less patterns, 1 for one-group patterns."""
    return F.regexp_extract_all(text, F.lit(rx(pattern, ignore_case)), F.lit(group))


def first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def truncate(c: Column, limit: int, suffix: str) -> Column:
    """Cut to ``limit`` characters and append ``suffix`` when longer."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(suffix))).otherwise(c)


def join(arr: Column, sep: str = "|") -> Column:
    return F.array_join(arr, sep)


def explode_kept(arr: Column, pos: bool = False):
    """``explode`` / ``posexplode`` written as the outer form.

    A plain explode makes Catalyst infer ``size(arr) > 0`` and push it below
    the projection (and any repartition) that computes ``arr``, evaluating an
    expensive array twice. The outer form infers nothing; callers drop the
    null row of an empty array with ``filter(<element>.isNotNull())`` (array
    elements here are never null).
    """
    return F.posexplode_outer(arr) if pos else F.explode_outer(arr)
