"""License scan: winnowed fingerprints in an inverted index pick candidates, banded alignment measures them.

Templates and texts are lower-cased and cut into words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. Of each template, the hashes of its
3-word grams are winnowed: the least of each 3 neighbours stays. The index maps these fingerprints to templates and places, and words to
the templates that have them. A text is looked up gram by gram, in one vectorised pass; a hit's diagonal (its place in the text less that
in the template) says where its template would stand, give or take the band. Edits can hit every fingerprint of a notice, so a
text's words are counted too: wherever as many of a template's words as must match, each no oftener than the template has it, stand
within its length and the band, it is a candidate as well. Candidates of one template that overlap are one region, and regions with too
few of its words are dropped. Each region is aligned once, over all its diagonals: global in the template, free ends in the text, for
every end at once. Of the alignments that cover enough, the best stay that don't overlap. What aligns is reported as coverage, the
share of the template's words that match, and as the span from the first to the last matching word.

A text costs a pass for its hits, and its regions, which are its words at most, a pass for each template that they may hold: time is
linear in the text, whatever it repeats, at some 100 bytes of memory for each of its words. Templates are a stated list; those of
BLOCK_WORDS words together are broadcast at a time, and texts are scanned once for each such block, without a shuffle.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .textops import ALNUM, Words, flat, grams, pieces, ranges, segments, sliding_min

#: Words of a gram, and neighbours of which winnowing keeps the least.
GRAM, WINNOW = 3, 3
#: Words around a template's place that may belong to it (for short templates a quarter of theirs), and the least share of its words
#: that must match.
BAND, LEAST_COVERAGE = 8, 0.8
#: Words of the templates that are looked for at a time; a longer template is alone.
BLOCK_WORDS = 1_000_000
#: Words of regions that are aligned together; a longer region is alone.
TOGETHER = 1 << 14
#: License and rights notices, fixed values.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT line": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "CC-BY-SA-4.0 notice": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def _words(text: str) -> Words:
    data = np.frombuffer(text.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), ALNUM, lower=True)


class Index:
    """The inverted index of templates: `print` (sorted hashes), `template` and `place` of each, and the templates' word hashes.

    `vocabulary` (sorted) has their words, with the templates of each, `owned`, and how often these have it, `cap`, `count` of them
    from `first`; `need` is how many words of a template must match.
    """

    def __init__(self, templates: Mapping[str, str], least: float = LEAST_COVERAGE):
        names = [(n, _words(t).hashes()) for n, t in templates.items()]
        self.names, self.words = [n for n, h in names if len(h)], [h for _, h in names if len(h)]
        self.size = np.array([len(h) for h in self.words], np.int64)
        self.need = np.array([next(m for m in range(1, len(h) + 1) if m / len(h) >= least) for h in self.words], np.int64)
        self.band = np.array([min(BAND, max(1, len(h) // 4)) for h in self.words], np.int64)
        self.reach = self.size + 2 * self.band
        prints, owner, place = [], [], []
        for i, h in enumerate(self.words):
            g = grams(h, GRAM)
            if len(g) > WINNOW:
                low = sliding_min(g, WINNOW)
                keep = np.zeros(len(g), bool)
                for k in range(WINNOW):
                    keep[k : k + len(low)] |= g[k : k + len(low)] == low
                at = np.flatnonzero(keep)
            else:
                at = np.arange(len(g))
            prints.append(g[at])
            owner.append(np.full(len(at), i))
            place.append(at)
        self.print = np.concatenate(prints or [np.zeros(0, np.uint64)])
        order = np.argsort(self.print, kind="stable")
        self.print = self.print[order]
        self.template = np.concatenate(owner or [np.zeros(0, np.int64)])[order]
        self.place = np.concatenate(place or [np.zeros(0, np.int64)])[order]
        every = np.concatenate(self.words or [np.zeros(0, np.uint64)])
        order = np.lexsort((np.repeat(np.arange(len(self.words)), self.size), every))
        word, own = every[order], np.repeat(np.arange(len(self.words)), self.size)[order]
        start = segments(word, own)
        self.owned, self.cap = own[start], np.diff(np.append(start, len(word)))
        self.vocabulary, self.first = np.unique(word[start], return_index=True)
        self.count = np.diff(np.append(self.first, len(start)))

    def hits(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(template, place in the text, word, how often the template has it) of each word that a template has, by template and place.

        Only of templates of which the row has enough words, each no oftener than the template.
        """
        if not len(self.vocabulary) or not len(h):
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        code = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[code] == h)
        code, row = code[at], words.row[at]
        # What each row has of each word, and then of each template.
        wide, most = len(self.vocabulary), len(self.words)
        known, n = np.unique(row * wide + code, return_counts=True)
        c = known % wide
        posting = ranges(self.first[c], self.count[c])
        pair, where = np.unique(np.repeat(known // wide, self.count[c]) * most + self.owned[posting], return_inverse=True)
        enough = pair[np.bincount(where, np.minimum(np.repeat(n, self.count[c]), self.cap[posting]), minlength=len(pair)) >= self.need[pair % most]]
        if not len(enough):
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        some = np.zeros(int(row[-1]) + 1, bool)
        some[enough // most] = True
        own = some[row]
        at, code, row = at[own], code[own], row[own]
        posting = ranges(self.first[code], self.count[code])
        key = np.repeat(row, self.count[code]) * most + self.owned[posting]
        own = np.flatnonzero(enough[np.minimum(np.searchsorted(enough, key), len(enough) - 1)] == key)
        t = self.owned[posting[own]]
        own = own[np.argsort(t, kind="stable")]
        return self.owned[posting[own]], np.repeat(at, self.count[code])[own], np.repeat(code, self.count[code])[own], self.cap[posting[own]]

    def regions(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, begin, end): stretches of the text's words, each in one row, where a template may stand; those of one don't overlap."""
        t, at, code, cap = self.hits(words, h)
        if not len(t):
            return t, t, t
        spans = [self._counted(words, t, at, code, cap), self._printed(words, h)]
        k, begin, end = (np.concatenate([s[i] for s in spans]) for i in range(3))
        if not len(k):
            return k, begin, end
        order = np.lexsort((end, begin, k))
        k, begin, end = k[order], begin[order], end[order]
        wide = len(h) + 1
        last = np.maximum.accumulate(k * wide + end)
        start = np.flatnonzero(np.append(True, (k * wide + begin)[1:] >= last[:-1]))
        k, begin, end = k[start], begin[start], np.maximum.reduceat(end, start)
        # Words of each region that the template has, no oftener than it has them.
        inside = np.searchsorted(k * wide + begin, t * wide + at, side="right") - 1
        own = np.flatnonzero((inside >= 0) & (k[inside] == t) & (at < end[inside]))
        order = own[np.lexsort((code[own], inside[own]))]
        run = segments(inside[order], code[order])
        some = np.minimum(np.diff(np.append(run, len(order))), cap[order[run]]) if len(order) else np.zeros(0, np.int64)
        keep = np.bincount(inside[order[run]], some, minlength=len(k)) >= self.need[k] if len(order) else np.zeros(len(k), bool)
        return k[keep], begin[keep], end[keep]

    def _printed(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where templates would stand by the fingerprints that the text has."""
        g = grams(h, GRAM)
        low, high = np.searchsorted(self.print, g), np.searchsorted(self.print, g, side="right")
        at = np.flatnonzero((high > low) & (words.row[GRAM - 1 :] == words.row[: len(g)])) if len(g) else np.zeros(0, np.int64)
        posting = ranges(low[at], (high - low)[at])
        at = np.repeat(at, (high - low)[at])
        t = self.template[posting]
        begin = at - self.place[posting] - self.band[t]
        row = words.row[at]
        return t, np.maximum(begin, words.first[row]), np.minimum(begin + self.reach[t], words.first[row + 1])

    def _counted(self, words: Words, t: np.ndarray, at: np.ndarray, code: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where `reach` words of the text hold as many of a template's words as must match, each no oftener than the template has it.

        A word counts for the windows that begin behind the place where the text had it `cap` times before, up to its own place.
        """
        order = np.lexsort((at, code, t))
        run = segments(t[order], code[order])
        nth = np.arange(len(order)) - np.repeat(run, np.diff(np.append(run, len(order))))
        before = np.full(len(order), -1)
        far = np.flatnonzero(nth >= cap[order])
        before[order[far]] = at[order[far - cap[order[far]]]]
        low = np.maximum(np.maximum(before, at - self.reach[t]), words.first[words.row[at]] - 1) + 1
        # Along each template, how many words windows count changes at these places.
        k, place, step = np.concatenate([t, t]), np.concatenate([low, at + 1]), np.repeat([1, -1], len(t))
        order = np.lexsort((place, k))
        k, place = k[order], place[order]
        depth = np.cumsum(step[order])
        last = np.flatnonzero(np.append((k[1:] != k[:-1]) | (place[1:] != place[:-1]), True))[:-1]
        own = last[(depth[last] >= self.need[k[last]]) & (k[last] == k[last + 1])]
        begin, row = place[own], words.row[place[own]] if len(own) else place[own]
        return k[own], begin, np.minimum(place[own + 1] - 1 + self.reach[k[own]], words.first[row + 1])


def align(template: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matched words, and the first and last matched word (end exclusive), of the best alignment that ends at each place of the text.

    The template is aligned whole; match 1, mismatch and gap -1 each; the text's words before are free. A step prefers the diagonal,
    then to skip a word of the template.
    """
    m = len(text)
    best, matched, first, last = np.zeros(m + 1, np.int32), np.zeros(m + 1, np.int32), np.full(m + 1, -1, np.int32), np.zeros(m + 1, np.int32)
    along = np.arange(m + 1, dtype=np.int32)
    for word in template:
        same = text == word
        across = best[:-1] + np.where(same, 1, -1).astype(np.int32)
        now = best - 1
        take = np.append(False, across >= now[1:])
        now[1:] = np.maximum(now[1:], across)
        hit = np.append(False, same) & take
        source = along - take
        matched = matched[source]
        first = np.where(hit & (matched == 0), along - 1, first[source])
        last = np.where(hit, along, last[source])
        matched += hit
        # Skipped text words: a running maximum along the text, less 1 for each; from where it was reached the rest follows.
        reach = np.maximum.accumulate(now + along)
        origin = np.maximum.accumulate(np.where(now + along == reach, along, 0))
        best, matched, first, last = reach - along, matched[origin], first[origin], last[origin]
    return matched, first, last


def apart(spans: np.ndarray) -> list[tuple[int, int, int]]:
    """Of (matched, first, last) those that don't overlap a better one: with more words matched, then earlier, then shorter."""
    kept: list[tuple[int, int]] = []
    out = []
    for matched, first, last in spans[np.lexsort((spans[:, 2], spans[:, 1], -spans[:, 0]))].tolist():
        k = bisect_left(kept, (first, last))
        if (k == 0 or kept[k - 1][1] <= first) and (k == len(kept) or kept[k][0] >= last):
            kept.insert(k, (first, last))
            out.append((matched, first, last))
    return out


def occurrences(index: Index, words: Words, h: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, template, matched, first, last) of some texts' words: alignments that cover enough, the best of those that overlap."""
    found = []
    template, begin, end = index.regions(words, h)
    size = end - begin + 2 * index.size[template] + 1
    # Regions of one template go together, some TOGETHER words at a time.
    group = segments(template, (np.cumsum(size) - size) // TOGETHER)
    for a, b in zip(group, np.append(group[1:], len(template))):
        k = int(template[a])
        own = index.words[k]
        # Behind each region stand so many words that are in no template that no alignment gains by crossing them.
        offset = np.cumsum(size[a:b]) - size[a:b]
        text = np.full(int(size[a:b].sum()), next(x for x in range(len(own) + 1) if x not in own), np.uint64)
        text[ranges(offset, (end - begin)[a:b])] = h[ranges(begin[a:b], (end - begin)[a:b])]
        matched, first, last = align(own, text)
        for o, x, y in zip(offset.tolist(), begin[a:b].tolist(), end[a:b].tolist()):
            spans = np.stack([c[o + 1 : o + 1 + y - x] for c in (matched, first, last)], axis=1).astype(np.int64)
            spans = np.unique(spans[(spans[:, 0] >= index.need[k]) & (spans[:, 1] >= o)], axis=0)
            found += [(int(words.row[x]), k, m, x - o + i, x - o + j) for m, i, j in apart(spans)]
    return sorted(found)


def _scan(docs: DataFrame, text: str, templates: Mapping[str, str], least: float, schema: str, rest: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates, least))  # bounded by BLOCK_WORDS, or one template

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            data, offs = flat(batch.column(text))
            rows, found = [], []
            for a, b in pieces(offs):
                base = offs[a]
                words = Words(data[base : offs[b]], offs[a : b + 1], ALNUM, lower=True)
                before, raw, shown = -1, b"", None
                for row, t, matched, first, last in occurrences(index, words, words.hashes()):
                    if row != before:
                        before, raw = row, data[offs[a + row] : offs[a + row + 1]]
                        # Characters before each byte.
                        shown = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                        start = int(offs[a + row] - base)
                    begin, end = int(words.start[first]) - start, int(words.end[last - 1]) - start
                    rows.append(a + row)
                    found.append((index.names[t], matched / len(index.words[t]), int(shown[begin]), int(shown[end]), raw[begin:end].tobytes().decode()))
            columns = [batch.column(c).take(pa.array(rows, pa.int64())) for c in rest]
            types = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            columns += [pa.array([f[i] for f in found], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "template", "coverage", "begin", "end", "matched"])

    return docs.mapInArrow(run, schema)


def scan_licenses(docs: DataFrame, text: str = "text", templates: Mapping[str, str] = TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    """A row for each occurrence of a template: the documents' columns but the text, template, coverage, begin, end, matched.

    coverage is the share of the template's words that match, at least `least`; begin and end are character offsets, from the
    first to behind the last matching word; matched is that text. Of overlapping occurrences of one template the best stays,
    the first of equals. A null or empty text has none, nor has a template without words; texts may be of any length and repeat
    what they like; repeated rows are reported each; an empty table gives an empty result. Columns of the new names are replaced.
    """
    new = ("template", "coverage", "begin", "end", "matched")
    docs = docs.drop(*new)
    rest = [c for c in docs.columns if c != text]
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "template string", "coverage double", "begin long", "end long", "matched string"])
    blocks: list[dict[str, str]] = [{}]
    size = 0
    for name, template in templates.items():
        n = len(_words(template))
        if blocks[-1] and size + n > BLOCK_WORDS:
            blocks.append({})
            size = 0
        blocks[-1][name] = template
        size += n
    out = None
    for block in blocks:
        own = _scan(docs, text, block, least, schema, rest)
        out = own if out is None else out.unionByName(own)
    return out


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in documents, with coverage and character spans."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
