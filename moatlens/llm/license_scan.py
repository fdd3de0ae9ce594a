"""License scan.

Templates are cut into words; hashes of all ``GRAM``-word sequences are
winnowed (the least of every ``WINNOW`` neighbours is kept) into an inverted
index hash -> (template, position). A document's own winnowed hashes that the
index knows point to templates and offsets; hits of one template on nearby
diagonals make one candidate. Each candidate is aligned with the template in a
band of ``BAND`` diagonals to each side; the longest common subsequence inside
the band gives matched words, coverage of the template and the matched spans
of the original text. After a match its words are taken out and the band is
aligned again while hits are left, so close repeats are each reported. Pieces
below the coverage bound are joined with the next piece of the same template
before they are judged: a notice may be interrupted by ``GAP`` foreign words.

Licences differ by few words, so coverage alone doesn't tell them apart: each
telling word of a template (a name in ``TELLING`` or a number) must be matched;
a template of fewer than ``FULL_BELOW`` words without any must be there whole; and
where one or a few words stand between matched ones, none of these may be a
telling word the template lacks there ("Attribution-ShareAlike" isn't
"Attribution"), unless it is named as a choice ("BSD or MIT").

The index is sent to the tasks. It is bounded by ``MAX_POSTINGS``; more
templates are scanned in several rounds, each with its own index.

A template of fewer than GRAM words is found only as a whole text. Words are runs of letters and digits (of any script), compared in lower case.
Any run of ``GRAM + WINNOW - 1`` words shared with a template is found.
Defined cases: null and blank texts match nothing; a template without words is
ignored; equal templates are reported each; repeated rows match alike; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, WINNOW = 3, 2
BAND = 8
MIN_COVERAGE = 0.8
MAX_POSTINGS = 2_000_000
#: Diagonals that one candidate may span.
SPREAD = 2 * BAND
#: Foreign words that may interrupt a notice, or as many as it has itself if that is more.
GAP = 64
#: Templates of fewer words, none of them telling, are found whole only.
FULL_BELOW = 20
#: Words that may take a telling word's place between two matched words.
BETWEEN = 3
#: Names and variants of licences; numbers tell too.
TELLING = frozenset("affero agpl apache apsl artistic boost bsd by cc cc0 cddl commercial derivatives eclipse epl gfdl gnu gpl isc lesser lgpl library mit mozilla mpl "
                    "nc nd noderivatives noderivs noncommercial sa share sharealike unlicense zlib".split())
_WORD = re.compile(r"[^\W_]+")
_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(31)

#: Notices looked for; fixed values, from the public texts of the licences.
TEMPLATES = (
    ("Apache-2.0 line", "Licensed under the Apache License, Version 2.0."),
    ("MIT line", "Released under the MIT License."),
    ("GPL-3.0 line", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0 line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0 line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Apache-2.0 notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
     "See the License for the specific language governing permissions and limitations under the License."),
    ("MIT grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
     "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
     "copyright notice and this permission notice appear in all copies."),
    ("BSD conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
     "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
     "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
     "Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0 notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
     "You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-2.0 line", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0 notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
     "Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1 notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
     "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0 notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
     "Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0 notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
     "Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD line", "Released under the BSD License."),
    ("CC-BY-4.0 short line", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0 short line", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0 line", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0 long line", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0 line", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC0-1.0 notice", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the "
     "public domain worldwide. This software is distributed without any warranty."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
     "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0 line", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0 notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
     "https://www.eclipse.org/legal/epl-2.0/"),
)


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str]) -> np.ndarray:
    """Hash of the GRAM words from each position on; one hash of all words if there are fewer."""
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    n = min(GRAM, len(h))
    x = h[:len(h) - n + 1]
    for k in range(1, n):
        x = (x ^ (x >> _S)) * _A + h[k:len(h) - n + 1 + k]
    x = (x ^ (x >> _S)) * _B
    return x ^ (x >> _S)


def winnowed(x: np.ndarray) -> np.ndarray:
    """Positions of the least hash (the last of equal ones) of every WINNOW neighbours."""
    if len(x) <= WINNOW:
        return np.array([len(x) - 1 - int(x[::-1].argmin())]) if len(x) else np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(x, WINNOW)[:, ::-1]
    return np.unique(np.arange(len(view)) + WINNOW - 1 - view.argmin(1))


class Index:
    """Postings (hash, template, position) sorted by hash."""

    def __init__(self, templates: list[tuple[int, list[str]]]):
        self.words = dict(templates)
        # a short template's neighbours inside a text are unknown: it keeps every hash
        rows = [(x[p], t, p) for t, w in templates if w for x in [grams(w)] for p in (range(len(x)) if len(x) <= WINNOW else winnowed(x))]
        rows.sort()
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.at = np.array([r[2] for r in rows], np.int64)

    def hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, diagonal, position) of the document's hashes that the index knows."""
        x = grams(words)
        keep = winnowed(x)
        lo, hi = np.searchsorted(self.hash, x[keep], "left"), np.searchsorted(self.hash, x[keep], "right")
        n = hi - lo
        at = np.repeat(keep, n)
        post = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.template[post], at - self.at[post], at


def align(template: list[str], words: list[str], diagonal: int) -> list[tuple[int, int]]:
    """(template word, document word) pairs of a longest common subsequence with |document - template - diagonal| <= BAND."""
    width = 2 * BAND + 1
    best = np.zeros((len(template) + 1, width + 2), np.int32)  # column d + 1 stands for diagonal - BAND + d
    same = np.zeros((len(template), width), bool)
    for i, w in enumerate(template):
        for d in range(width):
            j = i + diagonal - BAND + d
            same[i, d] = 0 <= j < len(words) and words[j] == w
        up = best[i, 2:]  # the template word stays unmatched: same document word, next diagonal
        row = np.maximum(best[i, 1:-1] + same[i], up[:width])
        best[i + 1, 1:-1] = np.maximum.accumulate(row)  # a document word stays unmatched
    # the earliest end, and from there the latest words: an occurrence isn't mixed with the next
    out, i, d = [], len(template), width - 1
    while i and d >= 0:
        here = best[i, d + 1]
        if out and same[i - 1, d] and best[i - 1, d + 1] + 1 == here:
            out.append((i - 1, i - 1 + diagonal - BAND + d))
            i -= 1
        elif d and best[i, d] == here:
            d -= 1
        elif d + 1 < width and best[i - 1, d + 2] == here:
            i, d = i - 1, d + 1
        elif same[i - 1, d] and best[i - 1, d + 1] + 1 == here:
            out.append((i - 1, i - 1 + diagonal - BAND + d))
            i -= 1
        else:
            i -= 1
    return out[::-1]


def matches(text: str, index: Index, min_coverage: float = MIN_COVERAGE) -> list[dict]:
    """Templates found in a text: matched words, coverage, first and last character and matched spans."""
    found = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text)]
    if not found:
        return []
    words = [w.lower() for w, _, _ in found]
    template, diagonal, at = index.hits(words)
    out = []
    for t in np.unique(template):
        mine = template == t
        out += _occurrences(int(t), index.words[int(t)], words, diagonal[mine], at[mine], found, min_coverage)
    return out


def _telling(word: str) -> bool:
    return word in TELLING or word.isdecimal()


def _told(pairs: list[tuple[int, int]], wanted: list[str], words: list[str]) -> bool:
    """Whether an alignment holds the template's telling words and isn't another licence's text."""
    have = {wanted[i] for i, _ in pairs}
    if any(_telling(w) and w not in have for w in wanted):
        return False
    for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False):
        between = words[j + 1:m]
        if 0 < len(between) <= BETWEEN and not {"or", "and"} & set(between):
            skipped = wanted[i + 1:k]
            if any(_telling(w) and w not in skipped for w in between):
                return False
    return True


def _occurrences(t: int, wanted: list[str], words: list[str], diagonal: np.ndarray, at: np.ndarray, found: list[tuple[str, int, int]], min_coverage: float) -> list[dict]:
    """Occurrences of one template; the words of one are taken out before the next is looked for."""
    out, partial, left = [], [], list(words)
    free = np.ones(len(words), bool)
    d = np.unique(diagonal)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(d) > SPREAD) + 1, [len(d)]))

    least = len(wanted) if len(wanted) < FULL_BELOW and not any(map(_telling, wanted)) else min_coverage * len(wanted)

    def take(pairs: list[tuple[int, int]]) -> bool:
        if not pairs or len(pairs) < least:
            return False
        if _told(pairs, wanted, words):
            out.append(_report(t, pairs, len(wanted), found))
        for _, j in pairs:  # another licence's words are taken out too
            left[j], free[j] = "", False
        return True

    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        for s in range(d[a], d[b - 1] + 1, SPREAD + 1):  # a wide run of diagonals is covered by several bands
            here = (diagonal >= s) & (diagonal <= s + SPREAD)
            while (here & free[at]).any():
                part = diagonal[here & free[at]]
                pairs = align(wanted, left, int((part.min() + part.max()) // 2))
                if not take(pairs):
                    partial.append(pairs)
                    break
    # an interrupted notice: its pieces lie in several bands
    chain: list[tuple[int, int]] = []
    for pairs in sorted(filter(None, partial), key=lambda q: (q[0][1], q[-1][1])):
        pairs = [x for x in pairs if free[x[1]]]
        near = chain and pairs and pairs[0][1] - chain[-1][1] <= max(GAP, len(wanted))
        joined = _joined(chain, pairs, len(wanted)) if near else pairs
        chain = [] if take(joined) else joined
    return out


def _joined(a: list[tuple[int, int]], b: list[tuple[int, int]], total: int) -> list[tuple[int, int]]:
    """The most pairs of ``a`` for the template's words up to some place, and of ``b`` from there on."""
    best = max(a, b, key=len)
    for k in range(total + 1):
        head = [x for x in a if x[0] < k]
        tail = [x for x in b if x[0] >= k and (not head or x[1] > head[-1][1])]
        if len(head) + len(tail) > len(best):
            best = head + tail
    return best


def _report(t: int, pairs: list[tuple[int, int]], total: int, found: list[tuple[str, int, int]]) -> dict:
    spans, last = [], None
    for _, j in pairs:
        if last is not None and j == last + 1:
            spans[-1][1] = found[j][2]
        else:
            spans.append([found[j][1], found[j][2]])
        last = j
    return {"template_id": t, "matched_words": len(pairs), "template_words": total, "coverage": len(pairs) / total,
            "start": spans[0][0], "end": spans[-1][1], "spans": [{"start": a, "end": b} for a, b in spans]}


MATCH = "template_id long, matched_words int, template_words int, coverage double, start long, end long, spans array<struct<start:long,end:long>>"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | tuple = TEMPLATES, id_col: str = "doc_id", text_col: str = "text",
         min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, template_id, template, matched_words, template_words, coverage, start, end, spans), a row per match; offsets in characters."""
    spark = docs.sparkSession
    rounds: list[list[tuple[int, list[str]]]] = [[]]
    size = 0
    for t, (_, text) in enumerate(templates):
        words = tokens(text)
        if size + len(words) > MAX_POSTINGS and rounds[-1]:
            rounds.append([])
            size = 0
        rounds[-1].append((t, words))
        size += len(words)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def one(part: list[tuple[int, list[str]]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value)
            for b in batches:
                ids, got = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    for m in matches(t.as_py() or "", index, min_coverage):
                        ids.append(i)
                        got.append(m)
                if got:
                    schema = pa.struct([("template_id", pa.int64()), ("matched_words", pa.int32()), ("template_words", pa.int32()), ("coverage", pa.float64()),
                                        ("start", pa.int64()), ("end", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
                    m = pa.array(got, schema)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *m.flatten()], names=["doc_id", *[f.name for f in schema]])

        return rows.mapInArrow(run, f"doc_id long, {MATCH}")

    out = reduce(DataFrame.unionByName, [one(r) for r in rounds])
    names = F.create_map(*[F.lit(x) for t, (name, _) in enumerate(templates) for x in (t, name)]) if templates else F.create_map().cast("map<bigint,string>")
    return out.withColumn("template", names[F.col("template_id").cast("int")] if templates else F.lit(None).cast("string")).select(
        "doc_id", "template_id", "template", "matched_words", "template_words", "coverage", "start", "end", "spans")
