"""License scans by patience alignment.

A license template and a stretch of a document are aligned on the words unique
to both: of these the longest increasing subsequence anchors the alignment,
and each gap between anchors is aligned the same way. The share of the
template's words that are aligned is its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from agoralens.llm.common import arrow_ready

# Notices by license.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "all-rights-reserved": "All rights reserved.",
}

#: Least coverage of a find.
COVERAGE = 0.8

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words_of(text: str) -> list[str]:
    """Lower-case words of ASCII letters and digits; version numbers stay whole."""
    return _WORD.findall(text.lower())


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of equal words in both, increasing in both."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        unique = [(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        anchors = _increasing(unique)
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        work += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that increases in the second place (the first increases already)."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        before[k] = piles[at - 1] if at else -1
        tops[at : at + 1], piles[at : at + 1] = [b], [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def finds(words: list[str], template: list[str], coverage: float) -> list[tuple[int, int, float]]:
    """(first word, end, coverage) of stretches that cover the template, from left to right without overlap.

    A stretch begins at a word of the template and is at most as long as the
    template and half of it; only those with enough of its words are aligned.
    """
    need, known = Counter(template), set(template)
    places = [k for k, w in enumerate(words) if w in known]
    least, longest = coverage * len(template), len(template) + len(template) // 2
    out, skip, right = [], -1, 0
    inside: Counter[str] = Counter()
    common = 0
    for left, start in enumerate(places):
        while right < len(places) and places[right] < start + longest:
            w = words[places[right]]
            inside[w] += 1
            common += inside[w] <= need[w]
            right += 1
        if start > skip and common >= least:
            found = aligned(template, words[start : start + longest])
            if found and found[0][1] == 0 and len(found) >= least:
                end = start + found[-1][1] + 1
                out.append((start, end, len(found) / len(template)))
                skip = end - 1
        w = words[start]
        common -= inside[w] <= need[w]
        inside[w] -= 1
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, first_word, end_word, coverage of every notice found.

    `docs` needs doc_id and text; other columns are ignored. Null and empty
    texts, and those without a notice, give no row; repeated rows are scanned
    each. `templates` is a bounded list of the caller's.
    """
    arrow_ready(docs.sparkSession)
    schema = "doc_id bigint, license string, first_word int, end_word int, coverage double"
    parsed = {name: words_of(t) for name, t in sorted(templates.items())}
    parsed = {name: t for name, t in parsed.items() if t}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text or "")
                held = set(words)
                for name, t in parsed.items():
                    if sum(w in held for w in t) >= coverage * len(t):
                        rows += [(i, name, *f) for f in finds(words, t, coverage)]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64())
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
