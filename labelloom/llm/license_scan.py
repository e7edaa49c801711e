"""Licenses in texts by patience alignment with templates.

Text and template are aligned on the words that are unique in both: the longest increasing subsequence of those
anchors is kept, and the gaps between them are aligned in the same way. The share of the template's words that find
a partner close together is its coverage. Where a text has copies next to each other, the stretch of each comes from
the best local chain of equal words; a find is taken out and the rest of the text is searched again.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Notices of common licenses, by their SPDX names.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "proprietary-notice": "All rights reserved.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy,"
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission"
        " notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable"
        " law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES"
        " OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions"
        " and limitations under the License."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and"
        " the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
}
COVERAGE = 0.8  # share of a template's words that make a find
SPREAD = 1.5  # words of the text over which they may lie, in template lengths
GAP = 8  # skipped words that a chain takes for one more equal word
WIDE_GAP = 128  # the same for what is left, so that a few words before a long insertion count as well

_TOKEN = re.compile(r"[^\W_]+")


def longest_increasing(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence with increasing second numbers of pairs sorted by their distinct first numbers."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        tails[at : at + 1] = [j]
        ends[at : at + 1] = [i]
        back[i] = ends[at - 1] if at else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Matched positions of two word lists, increasing in both.

    Equal words at both ends of a gap are matched first; then the words that are unique in both sides of the gap are
    the anchors. A gap without any is left unmatched.
    """
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        i, k, j, n = work.pop()
        while i < k and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < n and a[k - 1] == b[n - 1]:
            k, n = k - 1, n - 1
            out.append((k, n))
        if i == k or j == n:
            continue
        in_a, in_b = Counter(a[i:k]), Counter(b[j:n])
        at = {w: p for p, w in enumerate(b[j:n], j) if in_b[w] == 1}
        anchors = [(p, at[w]) for p, w in enumerate(a[i:k], i) if in_a[w] == 1 and w in at]
        if not anchors:
            continue
        for p, q in longest_increasing(anchors):
            work.append((i, p, j, q))
            out.append((p, q))
            i, j = p + 1, q + 1
        work.append((i, k, j, n))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, _TOKEN.findall(text.lower())
        self.vocabulary = frozenset(self.words)
        self.least = -(-len(self.words) * COVERAGE // 1)  # matched words of a find
        self.least_distinct = len(self.vocabulary) - (len(self.words) - self.least)
        self.window = int(len(self.words) * SPREAD)
        self.places: dict[str, list[int]] = {}
        for p, w in enumerate(self.words):
            self.places.setdefault(w, []).append(p)


def _regions(words: Sequence[str], lo: int, hi: int, t: Template) -> list[tuple[int, int]]:
    """Stretches of ``words[lo:hi]`` made of windows with as many different words of the template as a find has at least."""
    hits = [i for i in range(lo, hi) if words[i] in t.vocabulary]
    out, counts, first = [], Counter(), 0
    for at in hits:
        counts[words[at]] += 1
        while at - hits[first] >= t.window:
            w = words[hits[first]]
            counts[w] -= 1
            if not counts[w]:
                del counts[w]
            first += 1
        if len(counts) >= t.least_distinct:
            if out and hits[first] < out[-1][1]:
                out[-1] = (out[-1][0], at + 1)
            else:
                out.append((hits[first], at + 1))
    return out


def _chains(words: Sequence[str], lo: int, hi: int, t: Template, gap: int) -> list[tuple[int, int]]:
    """``(first word, last word + 1)`` of the best chains of equal words that may be finds, one for each last word, best first.

    A chain increases in text and template; an equal word counts ``gap``, a word of either that it skips takes one off.
    Score and start are one number, so that of equal chains the one that starts last is kept.
    """
    n, one = len(t.words), 1 << 32
    least = gap * t.least - (t.window - t.least) - (n - t.least)
    skipped = np.arange(n + 1, dtype=np.int64) * one
    best = np.zeros(n + 1, dtype=np.int64)  # by the number of template words that are passed
    found, before = [], lo
    for i in range(lo, hi):
        if words[i] not in t.places:
            continue
        if i - before > 1:
            best -= (i - before - 1) * one
        # all partners are taken from before this word: it has one in a chain
        top = 0
        made = [(p, max(int(best[p]), i) + gap * one) for p in t.places[words[i]]]
        best -= one
        for p, score in made:
            np.maximum(best[p + 1 :], score - skipped[: n - p], out=best[p + 1 :])
            top = max(top, score)
        before = i
        if top // one >= least:
            found.append((top // one, top % one, i + 1))
    return [(start, end) for _, start, end in sorted(found, key=lambda x: (-x[0], x[1]))]


def _aligned(words: Sequence[str], lo: int, hi: int, t: Template) -> tuple[int, int, int]:
    """``(matched words, first, last + 1)`` of the window that has most of the words that patience alignment matches."""
    matched = [i + lo for i, _ in patience(words[lo:hi], t.words)]
    best, first = (0, 0, 0), 0
    for last, i in enumerate(matched):
        while i - matched[first] >= t.window:
            first += 1
        best = max(best, (last - first + 1, -matched[first], i), key=lambda x: x[:2])
    return best[0], -best[1], best[2] + 1


def find_licenses(words: Sequence[str], templates: Sequence[Template]) -> list[tuple[int, int, str, float]]:
    """``(first word, last word + 1, name, coverage)`` of every find, sorted; finds of a template do not overlap."""
    out, present = [], set(words)
    for t in templates:
        if len(t.vocabulary & present) < t.least_distinct:
            continue
        work = [(0, len(words), GAP)]
        while work:
            begin, stop, gap = work.pop()
            for lo, hi in _regions(words, begin, stop, t):
                taken, finds = bytearray(hi - lo), []
                for start, end in _chains(words, lo, hi, t, gap):
                    if 1 in taken[start - lo : end - lo]:
                        continue
                    n, start, end = _aligned(words, start, end, t)
                    if n >= t.least:
                        taken[start - lo : end - lo] = b"\x01" * (end - start)
                        finds.append((start, end, t.name, n / len(t.words)))
                out += finds
                if finds:
                    ends = sorted(f[:2] for f in finds)
                    work += [(x, y, gap) for x, y in zip([lo, *(e for _, e in ends)], [*(b for b, _ in ends), hi])]
                elif gap == GAP:
                    work.append((lo, hi, WIDE_GAP))
    return sorted(out)


def scan_licenses(df: DataFrame, templates: Mapping[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_licenses, licenses, best, coverage, spans`` of every row.

    ``licenses`` has the names of the finds in order of place, ``spans`` the same with start and end in code points,
    ``best`` the name with the highest coverage (the first at ties) and its ``coverage``; without a find they are
    empty, null and 0. Null is the empty text. Keys may be null and rows repeated; an empty table gives no rows; other
    columns are not read. A task holds a batch of texts.
    """
    known = [Template(n, t) for n, t in (TEMPLATES if templates is None else templates).items()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for given in batch.column(1).to_pylist():
                # lower-casing may change lengths, so places are taken from the words as they stand
                spots = list(_TOKEN.finditer(given or ""))
                finds = find_licenses([m[0].lower() for m in spots], known) if spots else []
                best = max(finds, key=lambda f: f[3], default=(0, 0, None, 0.0))
                names = ",".join(f[2] for f in finds)
                spans = ",".join(f"{f[2]}:{spots[f[0]].start()}:{spots[f[1] - 1].end()}" for f in finds)
                out.append((len(finds), names, best[2], best[3], spans))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [key, "n_licenses", "licenses", "best", "coverage", "spans"])

    given = df.select(F.col(key), F.col(text).cast("string").alias("__text"))
    schema = f"`{key}` {given.dtypes[0][1]}, n_licenses long, licenses string, best string, coverage double, spans string"
    return given.mapInArrow(rows, schema)
