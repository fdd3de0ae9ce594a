"""Small generators of DuckDB SQL text for the oracles.

The oracles restate each rule in plain SQL (list functions, unnest, group by)
so they check the Spark operators from a second formulation.
"""

from __future__ import annotations

from moatlens.plans.registry import ci, q


def findall(col: str, pattern: str, group: int = 0, ignore_case: bool = False) -> str:
    pat = ci(pattern) if ignore_case else q(pattern)
    return f"regexp_extract_all({col}, {pat}, {group})"


def dedupe(expr: str) -> str:
    """Order-preserving de-duplication of a list expression."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def joined(expr: str, sep: str = "|") -> str:
    return f"array_to_string({expr}, {q(sep)})"


def any_sub(text: str, kws) -> str:
    return "(" + " or ".join(f"contains({text}, {q(k)})" for k in kws) + ")"


def classes(text: str, lex) -> str:
    """Names of classes with any keyword present, lexicon order."""
    items = ", ".join(f"case when {any_sub(text, kws)} then {q(name)} end" for name, kws in lex)
    return f"list_filter([{items}], lambda x: x is not null)"


def count_sub(text: str, kw: str) -> str:
    return f"((length({text}) - length(replace({text}, {q(kw)}, ''))) // {len(kw)})"


def sum_counts(text: str, kws) -> str:
    return "(" + " + ".join(count_sub(text, k) for k in kws) + ")"


def lexicon_values(lex, lower: bool = False) -> str:
    """``(values (name, ord, kw, kw_ord), ...)`` rows of a lexicon."""
    rows = []
    for i, (name, kws) in enumerate(lex):
        for j, k in enumerate(kws):
            rows.append(f"({q(name)}, {i}, {q(k.lower() if lower else k)}, {j})")
    return "(values " + ", ".join(rows) + ")"


def strip(col: str) -> str:
    return f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"


def lines(col: str) -> str:
    return f"string_split({col}, chr(10))"


def scored_list(lex, score_of) -> str:
    """``[{'neg','ord','name','score'}...]`` for a lexicon; ``score_of(kws)`` gives SQL."""
    items = []
    for i, (name, kws) in enumerate(lex):
        s = score_of(kws)
        items.append(f"{{'neg': -({s}), 'ord': {i}, 'name': {q(name)}, 'score': ({s})}}")
    return "[" + ", ".join(items) + "]"


def ranked(lex, score_of, keep: str, top: int | None = None) -> str:
    """Stable descending rank of a scored lexicon as a list of structs."""
    lst = f"list_sort(list_filter({scored_list(lex, score_of)}, lambda s: s.score {keep}))"
    return f"list_slice({lst}, 1, {top})" if top else lst


def names_of(expr: str) -> str:
    return f"list_transform({expr}, lambda s: s.name)"


def name_scores(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda s: s.name || ':' || cast(s.score as varchar)), '|')"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"
