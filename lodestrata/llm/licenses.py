"""License scans (operator 10).

Template texts are cut into five-word shingles (a shorter text is one shingle). Documents are read as overlapping windows whose length follows
the templates' own: a template of m shingles belongs to the class of the least power of two w >= m, with windows of w shingles every
max(1, w/4). Each window gets ``HASHES`` min-hashes, every one a band of one row; a window retrieves the templates with which it shares a band.

Why that suffices: where a text holds at least 0.8 of a template's shingles, some window starts within w/8 of it and has a Jaccard similarity of
at least 0.36 with the template (0.8 * m / (w + 0.2 * m) for m just above w/2, before and after edges of w/8 are cut), so the chance that none of 32 bands agrees is below (1 - 0.36) ** 32 = 7e-7.
Windows of one shingle retrieve by that shingle itself, without chance. Retrieved templates are verified exactly, word by word: the shingles of the
template that occur in the window and its margins (half a window to either side), as a share of the template's; 0.8 or more is a match.
So a template is found if 0.8 of it stands within twice its class's length; one that is torn apart by longer insertions isn't one occurrence.

Templates (notices, short texts, and the whole texts of ``license_texts``) are of bounded size (a parameter), and broadcast. Texts are read whole, in chunks that overlap by the longest window and margins.

Defined results: null and empty texts match nothing; overlapping matches of one template in a document are one span; repeated rows each have their matches.
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import flat_map

SHINGLE, CONTAINED, HASHES, SEED = 5, 0.8, 32, 7
#: Words that are handled at once, and documents' words that are gathered up to it.
CHUNK = 1 << 17

#: License notices and short texts (fixed values).
NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MIT notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS.""",
    "BSD conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of
source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution.""",
}

def full_texts() -> dict[str, str]:
    """The whole texts of common licenses, from the files of this package."""
    folder = Path(__file__).with_name("license_texts")
    return {f"{f.stem} text": f.read_text("utf-8") for f in sorted(folder.glob("*.txt"))}


TEMPLATES = NOTICES | full_texts()
_PUNCTUATION = re.compile(rb"[!-,/:-@\[-`{-~]+")
_odd = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    """Lower-case words (A-Z); ASCII punctuation but for point and hyphen separates them, and points at their ends go."""
    found = _PUNCTUATION.sub(b" ", text.encode("utf-8", "surrogatepass").lower()).split()
    return [w for x in found if (w := x.strip(b".-"))]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def hashes(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return mixed(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words; none if there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _odd + h[k : k + n]
    return mixed(out)


class Index:
    """Templates' bands by class and width of shingle."""

    def __init__(self, templates: dict[str, str]):
        rng = np.random.default_rng(SEED)
        self.multipliers = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.names, self.sets, self.grams = list(templates), [], []
        self.classes: dict[tuple[int, int], list[int]] = {}
        for i, name in enumerate(self.names):
            tokens = words(templates[name])
            h = hashes(tokens)
            width = min(SHINGLE, len(h))
            found = shingles(h, width)
            self.sets.append(np.unique(found))
            self.grams.append(set(zip(*(tokens[k:] for k in range(width)), strict=False)))
            self.classes.setdefault((width, 1 << max(0, len(found) - 1).bit_length()), []).append(i)
        self.bands = {}
        for (width, w), members in self.classes.items():
            if w == 1:
                self.bands[width, w] = [{int(self.sets[i][0]): [i] for i in members}]
                continue
            tables = []
            for m in self.multipliers:
                rows: dict[int, list[int]] = {}
                for i in members:
                    rows.setdefault(int((self.sets[i] * m).min()), []).append(i)
                tables.append(rows)
            self.bands[width, w] = tables
        self.keys = {c: [np.array(sorted(t), np.uint64) for t in tables] for c, tables in self.bands.items()}
        self.margin = 2 * max((w for _, w in self.classes), default=1) + SHINGLE

    def candidates(self, s: np.ndarray, width: int) -> set[tuple[int, int, int]]:
        """(window's length, its first shingle, template) that share a band. Minima over the short steps of small windows are reused for the longer ones."""
        out: set[tuple[int, int, int]] = set()
        sizes = sorted(w for v, w in self.classes if v == width)
        for k, m in enumerate(self.multipliers):
            x, step = s * m, 1
            for w in sizes:
                if w == 1:
                    if not k:
                        self._look_up(out, s, width, w, 1, 0)
                    continue
                longer = max(1, w // 4)
                if longer > step:
                    x, step = np.minimum.reduceat(x, np.arange(0, len(x), longer // step)), longer
                span = min(w // step, len(x))
                low = x[: len(x) - span + 1].copy()
                for j in range(1, span):
                    np.minimum(low, x[j : len(x) - span + 1 + j], out=low)
                self._look_up(out, low, width, w, step, k)
        return out

    def _look_up(self, out: set, low: np.ndarray, width: int, w: int, step: int, band: int) -> None:
        table, keys = self.bands[width, w][band], self.keys[width, w][band]
        if len(keys) <= 4:
            hit = np.zeros(len(low), bool)
            for key in keys:
                hit |= low == key
            at = np.flatnonzero(hit)
        else:
            at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, low), len(keys) - 1)] == low)
        for a in at.tolist():
            out.update((w, a * step, i) for i in table[int(low[a])])

    def matches(self, h: np.ndarray, starts: np.ndarray, tokens: list[bytes] | None = None) -> list[tuple[int, int, int, float]]:
        """Word hashes -> (template, first word, end, containment) of every verified window, by text; ``starts``: of the texts; ``tokens``: the words, which then decide."""
        out = []
        for width in {v for v, _ in self.classes}:
            s = shingles(h, width)
            if not len(s):
                continue
            for w, at, i in self.candidates(s, width):
                begin, end = max(0, at - w // 2), at + w + w // 2
                first, last = (int(np.searchsorted(starts, x, "right")) for x in (begin, end - 1))
                edges = [begin, *starts[first:last].tolist(), end]
                for a, b in zip(edges, edges[1:], strict=False):
                    inside = np.isin(s[a:b], self.sets[i])
                    share = len(np.unique(s[a:b][inside])) / len(self.sets[i])
                    if share < CONTAINED:
                        continue
                    where = np.flatnonzero(inside)
                    if tokens is not None:
                        same = [(k, g) for k in where.tolist() if (g := tuple(tokens[a + k : a + k + width])) in self.grams[i]]
                        share, where = len({g for _, g in same}) / len(self.grams[i]), [k for k, _ in same]
                        if share < CONTAINED:
                            continue
                    out.append((i, a + int(where[0]), a + int(where[-1]) + width, share))
        return out


def scan_words(index: Index, h: np.ndarray, starts: np.ndarray = np.zeros(1, np.int64), tokens: list[bytes] | None = None) -> list[tuple[int, int, int, float]]:  # noqa: B008
    """All spans in the word hashes of one or more texts, chunk by chunk; overlapping ones of a template in a text are joined, with the best share."""
    found, at = [], 0
    while True:
        part = h[at : at + CHUNK + index.margin]
        found += [(int(np.searchsorted(starts, at + a, "right")), i, at + a, at + b, share) for i, a, b, share in index.matches(part, starts - at, None if tokens is None else tokens[at : at + len(part)])]
        at += CHUNK
        if at >= len(h):
            break
    spans: list[list] = []
    for k, i, a, b, share in sorted(found):
        if spans and spans[-1][:2] == [k, i] and a < spans[-1][3]:
            spans[-1][3], spans[-1][4] = max(b, spans[-1][3]), max(share, spans[-1][4])
        else:
            spans.append([k, i, a, b, share])
    return [tuple(x[1:]) for x in spans]


FOUND = [T.StructField("license", T.StringType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("containment", T.DoubleType())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per document and span: ``keep``, ``license start_word end_word containment`` (words as ``words`` counts them)."""
    rows = docs.select(*keep, text)
    held = docs.sparkSession.sparkContext.broadcast(dict(TEMPLATES if templates is None else templates))
    gap = [b"\n"] * SHINGLE

    def make():
        index = Index(held.value)

        def flush(group, parts):
            """Several texts in one pass, parted by words that occur nowhere, so that no shingle reaches across."""
            joined = [x for p in parts for x in (*p, *gap)]
            starts = np.cumsum([0, *(len(p) + len(gap) for p in parts[:-1])])
            for i, a, b, share in scan_words(index, hashes(joined), starts, joined):
                k = int(np.searchsorted(starts, a, "right")) - 1
                yield (*group[k], index.names[i], a - int(starts[k]), b - int(starts[k]), share)

        def work(batch):
            group, parts, size = [], [], 0
            for row in zip(*(batch[c] for c in keep), batch[text], strict=True):
                found = words(row[-1] or "")
                if not found:
                    continue
                group.append(row[:-1])
                parts.append(found)
                size += len(found)
                if size >= CHUNK:
                    yield from flush(group, parts)
                    group, parts, size = [], [], 0
            if group:
                yield from flush(group, parts)

        return work

    return flat_map(rows, T.StructType([*(rows.schema[c] for c in keep), *FOUND]), make)
